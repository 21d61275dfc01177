"""Characters, URLs, tokenizers: micro cases and agreement of the JVM form with the character scan."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingmill.functions import chars, cyrillic
from lingmill.functions.ngrams import ngrams, previous, segments
from lingmill.functions.register import register
from lingmill.functions.tokenize import normalize_term, simple_tokens, tokens
from lingmill.functions.urls import UrlRules, find_urls, mask, url_at, url_of, url_spans
from tests.exact import tokens_exact

RULES = UrlRules(frozenset("COM NET ORG RU UK CO DE MD".split()))

CASES = {
    "foo, bar": "FOO BAR", "12 x": "X", "x 12": "X 12", "5": "5", "12\tx": "12 X", "12, x": "12 X", "12.5 x": "X", "1-2 3–4 z": "Z", "-a b": "B", ", -a b": "A B",
    "a, 12 b": "A B", "don't": "DON'T", "e-mail": "E-MAIL", "a_b": "A_B", "x.y": "X.Y", "foo/bar": "FOO BAR", "C++ rocks": "ROCKS", "ёлка": "ЕЛКА", "Straße": "STRAßE",
    "😀 hi": "HI", "see www.a.com now": "SEE NOW", "me@x.com hi": "HI", "und.34@mail7.example.com ok": "OK", "http://a.b/c?d=1, x": "X", "foo.com:80/x": "80 X",
    "a.com,b.com z": "Z", "(foo.co.uk) z": "Z", "a..com": "A..COM", "ed2k:foo": "ED2K FOO", "xhttp://a b": "XHTTP A B", "": "", "  ": "", "...": "",
}


@pytest.mark.parametrize("text", CASES)
def test_exact_tokens(text):
    assert " ".join(tokens_exact(text, RULES)) == CASES[text]


def test_native_tokens_agree(spark):
    rows = list(enumerate([*CASES, None, "a\0b", "x" * 100_000 + " y"]))
    df = spark.createDataFrame(rows, "id int, text string").select("id", "text", tokens(F.col("text"), RULES).alias("t"))
    for r in df.collect():
        assert r["t"] == (None if r["text"] is None else tokens_exact(r["text"], RULES)), r["text"]


ALPHABET = "ab Ж1.,:;-–—'\"()/\\@ \n\t_&°ё«…ß€"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=20, max_size=20))
def test_native_tokens_agree_on_any_text(spark, texts):
    rules = UrlRules(frozenset({"AB", "BA"}), frozenset({"AB"}))
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("text", tokens(F.col("text"), rules).alias("t")).collect()
    for r in got:
        assert r["t"] == tokens_exact(r["text"], rules), r["text"]


def test_url_spans():
    find = lambda t: [t[a:b] for a, b in find_urls(t, RULES)]
    assert find("a.com,b.com z") == ["a.com", "a.com,b.com"]
    assert find("see http://a.b/c?d=1, x") == ["http://a.b/c?d=1"]
    assert find("(foo.co.uk) z") == ["foo.co.uk"]
    assert find("www.x.y end") == ["www.x.y"]
    assert find("no urls. here: at all") == []
    assert find("x.com") == ["x.com"] and find("") == [] and find(".com") == []
    assert mask("a x.com b", [(2, 7)]) == f"a {chars.SPLIT_MARK} b"
    assert mask("abcdef", [(0, 3), (1, 5)]) == f"{chars.SPLIT_MARK}f"


def test_url_of_a_place():
    t = "see www.x.y and a.com, http://q.de/z"
    at = lambda i: (lambda s: s and t[s[0] : s[1]])(url_of(t, i, RULES))
    assert at(7) == "www.x.y" and at(t.index("a.com") + 1) == "a.com" and at(t.index(":")) == at(len(t) - 1) == "http://q.de/z"
    assert at(0) is None and at(t.index(",")) is None and url_of(t, 99, RULES) is None and url_of(t, -1, RULES) is None
    long = "a.com," * 50_000
    assert len(find_urls(long, RULES)) == 50_000 and find_urls(long, RULES)[-1] == (0, len(long) - 1)  # in one pass


def test_url_columns(spark):
    df = spark.createDataFrame([("go to x.com now", 7), ("none", 1), (None, None)], "text string, p int")
    rows = df.select(url_spans(F.col("text"), RULES).alias("u"), url_spans(F.col("text"), RULES, False).alias("v"), url_at(F.col("text"), F.col("p"), RULES).alias("a")).collect()
    assert [tuple(x) for x in rows[0]["u"]] == [(6, 5, "x.com")] and rows[0]["v"][0]["value"] is None and tuple(rows[0]["a"]) == (6, 5, "x.com")
    assert rows[1]["u"] == [] and rows[1]["a"] is None and rows[2]["u"] is None


def test_rules_from_xml(tmp_path, spark):
    p = tmp_path / "u.xml"
    p.write_text("<r><first-level-domains><_>com</_><x>Рф</x></first-level-domains><uri-schemes><_>http</_></uri-schemes></r>", encoding="utf-8")
    r = UrlRules.from_xml(str(p))
    assert r.domains == {"COM", "РФ"} and r.schemes == {"HTTP"}
    own = UrlRules.default(spark)
    # the resource's lists, by number and digest of the sorted words
    digest = lambda words: hashlib.sha256(" ".join(sorted(words)).encode()).hexdigest()[:16]
    assert {"DE", "COM", "MUSEUM", "SU", "NATO", "РУ"} <= own.domains and not {"AX", "BL", "ME", "RS", "TL"} & own.domains
    assert (len(own.domains), digest(own.domains)) == (272, "b15724b3102dc537") and (len(own.schemes), digest(own.schemes)) == (51, "df25afb982a468f2")


def test_simple_tokenizer(spark):
    df = spark.createDataFrame([("a1b  -x- foo7 \x01bar 5",)], "text string")
    assert df.select(simple_tokens(F.col("text"))).first()[0] == ["A1B", None, "FOO", "BAR", None]
    assert df.select(normalize_term(F.lit("«Слово»"))).first()[0] == "СЛОВО"


def test_cyrillic_gate(spark):
    df = spark.createDataFrame([("1234",), ("abcdefghij",), ("abcdeяя",)], "t string")
    assert [r[0] for r in df.select(cyrillic.has_cyrillic_letters(F.col("t"), 20)).collect()] == [True, False, True]
    assert [r[0] for r in df.select(cyrillic.cyrillic_percent(F.col("t"))).collect()] == [None, 0, 28]
    assert df.select(cyrillic.has_cyrillic_letters(F.lit("x"), 0)).first()[0] is True


def test_display(spark):
    row = spark.range(1).select(chars.cut(F.lit("abcdef"), 3), chars.squeeze(F.lit("a \t\n b")), chars.display_size(F.lit(2048)), chars.equals_from(F.lit("abc"), 1, F.lit("bc")), chars.word_form(F.lit("a"), F.lit(None).cast("string"))).first()
    assert tuple(row) == ("abc...", "a b", "2.00 KB", True, "a")


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(ngrams(F.col("t"), 4)).collect()] == [[], [], []]
    assert df.select(previous(F.col("t"))).first()[0] == [None, "a", "b"]
    keep = lambda t: t != "b"
    assert df.select(segments(F.col("t"), keep, "reset")).first()[0] == [["a"], ["c"]]
    assert df.select(segments(F.col("t"), keep, "bridge")).first()[0] == [["a", "c"]]


def test_sql_functions(spark):
    register(spark, RULES)
    assert spark.sql("SELECT tokenize('foo, x.com bar')").first()[0] == ["FOO", "BAR"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM words('foo bar')").collect()] == [(0, "FOO"), (1, "BAR")]
    assert [r["value"] for r in spark.sql("SELECT * FROM extract_urls('see x.com')").collect()] == ["x.com"]
