"""Training-data operators: round trips, brute force, held-out accuracy, and the defined results for odd input."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingmill.llm import distinct, langlabel, mixing, mojibake, packing, queries, reading, skeleton, split, termfreq, tokens
from lingmill.llm.message import message, prose

ODD = [None, "", " ", "\n", "a", "ж" * 50_000, "x y. " * 20_000, "😀" * 9_000, "a\0b", "same", "same"]


def odd(spark):
    rows = [(i, t, "c", 1, "p") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, class string, tokens int, piece string")


# 1


def joined(pieces, overlap):
    return pieces[0] + "".join(p[overlap:] for p in pieces[1:])


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n!é́", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_split_round_trip(text, limit, overlap):
    cuts = split.cut_text(text, limit, overlap)
    pieces = [text[a:b] for a, b in cuts]
    assert joined(pieces, overlap) == text and all(len(p) <= limit for p in pieces)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(cuts, cuts[1:], strict=False))


def test_split_cuts_where_the_topic_changes():
    one, two = "the cat eats fish. a fish swims near the cat. ", "stars burn hydrogen gas. hot gas lights distant stars. "
    text = one * 6 + two * 6
    (_, cut), *_ = split.cut_text(text, int(len(text) * 0.75), 0)
    assert cut == len(one * 6)


def test_split_column(spark):
    rows = split.split_texts(odd(spark), limit=1000, overlap=100).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece_no"])):
        by[r["doc_id"]].append(r)
    assert set(by) == {i for i, t in enumerate(ODD) if t is not None}
    for i, ps in by.items():
        assert joined([p["piece"] for p in ps], 100) == ODD[i] and {p["n_pieces"] for p in ps} == {len(ps)}
        assert all(len(p["piece"]) <= 1000 and p["piece"] == ODD[i][p["start"] : p["end"]] for p in ps)
    assert split.split_texts(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_texts(odd(spark), limit=100, overlap=60)


# 2


def test_skeleton():
    t = skeleton.prototypes()
    same = [("paypal", "раураl"), ("é", "é"), ("a b", "a b"), ("file", "ﬁle"), ("ABC", "ＡＢＣ"), ("ab", "a​b"), ("ab", "a­b"), ("K", "K"), ("Ï", "Ї"), ("Ōo", "Ōο")]
    for a, b in same:
        assert skeleton.skeleton(a, t) == skeleton.skeleton(b, t), (a, b)
    same = [("Ү", "Y"), ("ү", "y"), ("Ӏ", "l"), ("ν", "v"), ("ρ", "p"), ("α", "a"), ("ι", "i"), ("ɡ", "g"), ("ɑ", "a"), ("ı", "i"), ("ց", "g"), ("Ꭺ", "A"), ("𝐀", "A"), ("𝛂", "a"), ("ꓮ", "A"), ("Ⲟ", "O"), ("ә", "ə")]
    same += [("￥", "¥"), ("￠", "¢"), ("ｶﾞ", "ガ"), ("ﾊﾟﾝ", "パン"), ("ﾡ", "ᄀ"), ("Ⅳ", "IV"), ("Ａｂ１！", "Ab1!"), ("a\U000e0100", "a"), ("a\u180b", "a")]
    for a, b in same:
        assert skeleton.skeleton(a, t) == skeleton.skeleton(b, t), (a, b)
    assert skeleton.skeleton("\u0600", t) == "\u0600"  # a format character that a reader sees
    assert all(skeleton.skeleton(skeleton.skeleton(chr(c), t), t) == skeleton.skeleton(chr(c), t) for c in t)
    for a, b in [("a", "A"), ("e", "é"), ("x2", "x²"), ("a.", "a!"), ("'", "’"), ("-", "–"), ("n", "п"), ("ab", "a b"), ("K", "к"), ("3", "З")]:
        assert skeleton.skeleton(a, t) != skeleton.skeleton(b, t), (a, b)


def test_lookalike_pairs(spark):
    rows = [(1, "abc", "EN"), (2, "аbc", "EN"), (3, "abc", "EN"), (4, "аbc", "RU"), (5, "x", None), (6, "ｘ", None), (7, None, "EN"), (8, "", "EN"), (9, "​", "EN"), (10, "Abc", "EN")]
    df = spark.createDataFrame(rows, "id long, text string, language string").withColumn("form", F.lit(1)).withColumn("skel", F.lit(2))
    pairs = lambda within: sorted(map(tuple, skeleton.lookalike_pairs(df, "id", "text", within).collect()))
    assert pairs(["language"]) == [(1, 2), (2, 3), (5, 6), (8, 9)]
    assert pairs(None) == [(1, 2), (1, 4), (2, 3), (3, 4), (5, 6), (8, 9)]
    assert skeleton.lookalike_pairs(df.limit(0), "id").count() == 0
    assert skeleton.with_skeleton(odd(spark)).count() == len(ODD)


def test_lookalike_pairs_brute_force(spark):
    rng, t = random.Random(5), skeleton.prototypes()
    texts = ["".join(rng.choice("aа bо o​") for _ in range(3)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {tuple(r) for r in skeleton.lookalike_pairs(df, "id", rows_per_task=3).collect()} == {tuple(r) for r in skeleton.lookalike_pairs(df, "id").collect()}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if texts[i] != texts[j] and skeleton.skeleton(texts[i], t) == skeleton.skeleton(texts[j], t)}
    assert {tuple(r) for r in skeleton.lookalike_pairs(df, "id").collect()} == want and want


# 4, 5: small languages of their own

SENTENCES = {
    "EN": ["The small parser reads every broken link after a restart.", "This old server keeps the missing key in the table.", "Our queue writes the wrong file before the next run."],
    "DE": ["Der kleine Leser prüft jede ungültige Verbindung nach dem Neustart.", "Die alte Prüfung schreibt den größten Eintrag über die Schnittstelle.", "Unsere Warteschlange löscht die überzählige Datei vor dem nächsten Lauf."],
    "RU": ["Новая проверка хранит потерянный ключ в верхней таблице.", "Старый сервер читает каждую пустую строку после перезапуска.", "Наша очередь удаляет неверный файл перед следующим запуском."],
    "FR": ["Le petit lecteur vérifie chaque ligne vide après un redémarrage.", "La vieille mémoire écrit le dernier élément à cause du délai.", "Notre serveur répète la première clé dans le tableau supérieur."],
}
SAMPLES = [(lang, s) for lang, ss in SENTENCES.items() for s in ss * 3]
KNOWN = {"EN": "English", "DE": "German", "RU": "Russian", "FR": "French", "BE": "Belarusian"}


def test_labels(spark):
    cases = {"en": "EN", " DE ": "DE", "german": "DE", "deu": "DE", "en-XX": "EN", "ru_RU": "RU", "French": "FR", "und": None, "??": None, "": None, None: None, "n/a": None, "unknown": None, "sw": "SW", "cze": "CS"}
    rows = spark.createDataFrame([(x,) for x in cases], "l string").select("l", langlabel.label_code(F.col("l"), KNOWN).alias("c")).collect()
    assert {r["l"]: r["c"] for r in rows} == cases


def test_prose():
    text = "commit " + "a" * 40 + "\nAuthor: X <x@y.z>\nDate:   now\n\nfix: Title is here\n\nOne wrapped\nsentence ends. Two!\n\n- item (x)\n# Head\n│ └── src\nReviewed-by: Y <y@z>\n"
    assert prose(text, True).sentences == ["Title is here", "One wrapped sentence ends.", "Two!"]
    for machine in ("Merge branch 'x' into y", "Bump a from 1.0 to 1.1", 'Revert "x"', "0123456789 ci-runner[bot] 2024-01-01\nDone it all over again."):
        assert prose(machine, True).machine, machine
    # a mark counts wherever it stands in a message
    for pad in ("", "Word. " * 20, "Word. " * 200):
        assert prose(f"Title\n\n{pad}\nThis [skip ci] ends.", True).machine and prose(f"Title\n\n{pad}It was generated by a script.", True).machine
        assert not prose(f"Title\n\n{pad}It skips the check.", True).machine
    for human in ("Automatic retries now honour the limit", "Author: Bot Tester <x@y.z>\n\nTitle of a change", "Release the lock in time"):
        assert not prose(human, True).machine, human
    # fragments are looked at, and known as such
    p = prose("The title trails off…\n\nA whole one. And then it\n\nends …\n", True)
    assert p.sentences == ["The title trails off…", "A whole one.", "And then it", "ends …"] and p.whole == [False, True, False, False]
    assert prose("One is whole. The other one trails …", False).whole == [True, False]
    assert prose("", True).sentences == [] and prose("A b. / C d.", False).sentences == ["A b.", "C d."]


def test_languages(spark):
    en, de, ru = SENTENCES["EN"], SENTENCES["DE"], SENTENCES["RU"]
    rows = [(0, en[0], "en"), (1, de[1], "EN"), (2, f"{en[0]} {ru[1]} {en[1]}", "en"), (3, "wip", "de"), (4, None, None), (5, ru[2], None), (6, "Merge branch 'x' into y", "de"), (7, "", "en"), (8, de[0].encode().decode("cp1252"), "en")]
    df = spark.createDataFrame(rows, "id long, text string, label string").withColumn("commit", F.lit(True))
    learned = [mojibake.Transformation("cp1252", "utf-8")]
    got = langlabel.label_cases(langlabel.identify(df, SAMPLES, learned), "label", KNOWN)
    out = {r["id"]: (r["case"], r["languages"]) for r in got.collect()}
    assert out == {0: (None, ["EN"]), 1: ("wrong", ["DE"]), 2: ("mixed", ["EN", "RU"]), 3: (None, []), 4: (None, []), 5: ("missing", ["RU"]), 6: (None, []), 7: (None, []), 8: ("wrong", ["DE"])}
    assert [x["sentences"] for x in langlabel.identify(df.filter("id = 2"), SAMPLES).first()["langs"]] == [1, 1, 1]
    assert langlabel.identify(df.limit(0), SAMPLES).count() == 0 and langlabel.identify(odd(spark).withColumn("commit", F.lit(False)), SAMPLES).count() == len(ODD)


def test_language_without_a_clear_sentence(spark):
    ident = langlabel.Identifier(SAMPLES, margin=2.0)  # no sentence is ever clear
    de, ru = SENTENCES["DE"], SENTENCES["RU"]
    (one,), (two,), none, machine = ident.stretches([de[0], f"{ru[0]} {ru[1]}", "wip", "Merge branch 'x' into y"], [False, False, False, True])
    assert (one[0], one[2], one[4]) == ("DE", 1, False) and (two[0], two[2]) == ("RU", 2) and 0 < one[1] <= 1 and none == machine == []
    # clear sentences decide alone
    assert [(x[0], x[4]) for x in langlabel.Identifier(SAMPLES).stretches([f"{SENTENCES['EN'][0]} {ru[0]}"], [False])[0]] == [("EN", True), ("RU", True)]
    rows = [(0, "en", [("DE", 0.4, 1, 0, False)]), (1, None, [("DE", 0.4, 1, 0, False)]), (2, "en", [("DE", 0.9, 1, 0, True)]), (3, "en", [("DE", 0.9, 0, 2, True)])]
    df = spark.createDataFrame(rows, "id int, label string, langs array<struct<language:string,confidence:double,sentences:int,fragments:int,clear:boolean>>")
    assert {r["id"]: r["case"] for r in langlabel.label_cases(df, "label", KNOWN).collect()} == {0: None, 1: "missing", 2: "wrong", 3: None}


def test_profiles_hold_out():
    rng = random.Random(2)
    train = [(lang, s) for lang, ss in SENTENCES.items() for s in ss]
    p = langlabel.Profiles().fit(train)
    tests = []
    for lang, ss in SENTENCES.items():
        words = [w for s in ss for w in s.rstrip(".").lower().split()]
        tests += [(lang, rng.sample(words, 6)) for _ in range(30)]
    best = p.cosines([w for _, w in tests]).argmax(axis=1)
    assert np.mean([p.codes[b] == lang for b, (lang, _) in zip(best, tests, strict=True)]) > 0.97
    # the cosine of the text's own vector, also where words repeat, with any memory
    small = langlabel.Profiles(memory=4).fit(train)
    for words in (tests[0][1], ["the"] * 5, ["the"] * 50 + ["die"], ["die"] * 200, ["a" * 12_000, "der", "der"], tests[5][1] * 9):
        v = sum(p.bundle(w).astype(float) for w in words)
        for q in (p, small):
            assert np.allclose(p.proto @ v / np.linalg.norm(v), q.cosines([words])[0], atol=1e-4) and abs(q.cosines([words])).max() <= 1


def garbled_corpus():
    rng, rows = random.Random(4), []
    ways = [mojibake.Transformation("cp1252", "utf-8"), mojibake.Transformation("cp866", "cp1251"), mojibake.Transformation("mac-roman", "utf-8"), mojibake.Transformation("cp1252", "utf-8", 2)]
    clean = [s for ss in SENTENCES.values() for s in ss]
    for i in range(400):
        s = f"{rng.choice(clean)} {rng.choice(clean)} [{i // 2:09d}]"
        rows.append((2 * i, s, None))
        if i % 4 == 0:
            t = ways[(i // 4) % len(ways)]
            g = t.apply(s)
            if g and g != s and not (t.right == "cp1251" and not any("а" <= c <= "я" for c in s)):
                rows.append((2 * i + 1, g, s))
    return rows


def test_encodings(spark):
    rows = garbled_corpus()
    df = spark.createDataFrame(rows, "id long, text string, origin string")
    clean = [s for _, s in SAMPLES]
    learned = mojibake.learn(df, clean)
    assert {("cp1252", "utf-8", 1), ("mac-roman", "utf-8", 1)} <= {(t.wrong, t.right, t.times) for t in learned}
    got = mojibake.with_repair(df, learned, clean).select("id", "text", "origin", "repair.*").collect()
    known = {(t.wrong, t.right, t.times) for t in learned}
    found = {r["id"] for r in got if r["garbled"]}
    assert not [r["text"] for r in got if r["garbled"] and r["origin"] is None]
    want = {r["id"] for r in got if r["origin"] is not None}
    assert len(found & want) >= 0.9 * len(want), (len(found & want), len(want), known)
    exact = [r["restored"] == r["origin"] for r in got if r["origin"] is not None and r["garbled"]]
    assert np.mean(exact) > 0.9


def test_encodings_odd(spark):
    clean = [s for _, s in SAMPLES]
    learned = [mojibake.Transformation("cp1252", "utf-8"), mojibake.Transformation("cp1252", "cp1250")]
    rows = [(0, "├── src │ ½ × 3 µs “quoted” – €5 © 🚀"), (1, "Verbindung pr�ft"), (2, None), (3, ""), (4, "prÃ¼ft jede Ã¼berzÃ¤hlige"), (5, "Le lecteur vérifie à nouveau"), (6, "plain")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("garbled", F.lit(1))
    got = {r["id"]: r["repair"] for r in mojibake.with_repair(df, learned, clean).collect()}
    assert {i for i, r in got.items() if r and r["garbled"]} == {1, 4} and got[1]["lost"] and got[2] is None
    assert got[4]["restored"] == "prüft jede überzählige" and got[0]["restored"] == rows[0][1]
    assert mojibake.learn(df.limit(0), clean) == [] and mojibake.learn(df, []) == []
    assert mojibake.with_repair(odd(spark), learned, clean).count() == len(ODD)


def test_clean_samples_of_any_number(spark, tmp_path):
    """What teaches clean text stands behind 10,000 other samples."""
    known = [(i, "EN", "see the log") for i in range(10_000)] + [(10_000 + i, lang, s) for i, (lang, s) in enumerate(SAMPLES)] + [(20_000, None, "no"), (20_001, "EN", None)]
    docs = garbled_corpus()
    for name, rows, schema in (
        ("lang_samples", known, "sample_id long, language string, text string"),
        ("documents", [r[:2] for r in docs], "doc_id long, text string"),
        ("requests", [(1, "plain"), (2, None)], "req_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    model = mojibake.CharModel.fit_column(queries.labelled_samples(spark, str(tmp_path)))
    assert model == mojibake.CharModel.fit([t for _, lang, t in known if lang and t]) and model.uni["п"] > 0
    got = {r["row_id"]: r["restored"] for r in queries.p5_repaired(spark, str(tmp_path)).collect()}
    want = {i: origin for i, _, origin in docs if origin is not None}
    assert set(got) == set(want) and np.mean([got[i] == want[i] for i in got]) > 0.95
    assert mojibake.CharModel.fit_column(queries.labelled_samples(spark, str(tmp_path)).limit(0)) == mojibake.CharModel()


def test_evidence_is_summed_over_a_text():
    clean = ["Náš klíč kontroluje soubor.", "Noční úloha vrací spojení.", "Klíč čte náš soubor."]
    r = mojibake.Repairer([mojibake.Transformation("cp1252", "cp1250")], mojibake.CharModel.fit([s for s in clean for _ in range(20)]))
    one, two = (s.encode("cp1250").decode("cp1252") for s in clean[:2])
    for s in (one, two):
        assert r.text(s) == (s, False, False)  # one garbled word is too little by itself
    assert r.text(f"{one} {two}")[:2] == (" ".join(clean[:2]), True)
    assert r.text(f"{one} {one}")[1] is False  # the same word again is no more evidence
    assert r.text(" ".join(clean))[1] is False


# 6, 7


def test_term_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["HOT"] * 5 + [f"v{i}" for i in range(30)] + [None, " ", ""]), rng.choice(["g", "h", None]), f"d{rng.randint(0, 9)}", rng.randint(0, 2), rng.choice([1, 2, 3, 0, None, -1])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "value string, grp string, doc string, portion int, count int").withColumn("total", F.lit(7))
    kept = {r for r in rows if r[0] and r[0].strip() and r[4] and r[4] >= 1}
    total, docs = Counter(), defaultdict(set)
    for v, g, d, _, c in kept:
        total[v] += c
        docs[v].add((g, d))
    want = {(v, total[v], len(docs[v])) for v in total}
    for heavy in (None, [], ["HOT", "v1"], list(total)):
        assert {tuple(r) for r in termfreq.term_counts(df, heavy).collect()} == want
    assert termfreq.heavy_terms(termfreq.counting_rows(df), share=0.1) == ["HOT"]
    assert set(termfreq.heavy_terms(termfreq.counting_rows(df))) == set(total) == set(termfreq.heavy_terms(termfreq.counting_rows(df), share=0.001))
    n = len({(g, d) for _, g, d, _, _ in kept})
    bands = {r["value"]: r["bands"] for r in termfreq.term_bands(df).collect()}
    assert bands == {v: ["rare"] * (total[v] <= 2) + ["common"] * (len(docs[v]) > n / 2) for v in total}
    assert termfreq.term_bands(df.limit(0)).count() == 0


def test_term_scores(spark):
    rows = [("EN", "stop", 5.0), ("DE", "stop", 5.0), ("EN", "own", 2.0), ("EN", "own", 2.0), ("DE", "rare", 1.0), ("DE", "null", None), (None, "x", 1.0), ("EN", None, 1.0), ("FR", "zero", 0.0), ("EN", "nan", float("nan"))]
    df = spark.createDataFrame(rows, "language string, text string, weight double").withColumn("score", F.lit(1)).withColumn("record", F.lit(1))
    s = distinct.term_scores(df, "language", "text", "weight")
    got = {(r["language"], r["text"]): r for r in s.collect()}
    assert got["EN", "own"]["weight"] == 4 and got["EN", "own"]["score"] > 0 > got["EN", "stop"]["score"]
    assert got["FR", "zero"]["score"] == 0 and got["DE", "null"]["score"] == 0 and len(got) == 7
    assert {(r["language"], r["text"]) for r in distinct.top_terms(s, "language", "text", 1).collect()} == {("EN", "own"), ("DE", "stop"), ("FR", "zero")}
    assert got["DE", "rare"]["score"] == 0 and got["EN", "own"]["n_records"] == 1  # one row; two rows of one record
    assert distinct.term_scores(df, "language", "text", "weight", min_df=1).filter("text = 'rare'").first()["score"] > 0
    assert {r["text"] for r in distinct.term_scores(df, "language", "text", "weight", min_df=3).filter("score <> 0").collect()} == set()
    assert distinct.term_scores(df.limit(0), "language", "text", "weight").count() == 0


# 8, 9, 10


def test_tokens(spark):
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    for t in ("", "Hello world", "ж" * 100, "word\n" * 50_000 + "  tail"):
        assert tokens.count_tokens(t, enc) == len(enc.encode_ordinary(t))
    # the shapes at which chunks would be cut, on both sides of any length of a run
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice(["  ", "\n", "\t", " ", "\x85", "\u3000", "a", "B1", "}", "…", "ж", "    ", "\x1c", "\u200b"]) for _ in range(rng.randint(0, 30)))
        assert {tokens.count_tokens(t, enc, run) for run in (1, 2, 3, 5, 1000)} == {len(enc.encode_ordinary(t))}, t
    t = "    \n    }\n\nx…" * 17_400
    assert tokens.count_tokens(t, enc) == len(enc.encode_ordinary(t))
    assert tokens.count_tokens(f"x{' ' * 2_000_000}y", enc) == tokens.count_tokens("x", enc) + tokens.count_tokens(" " * 1_999_999, enc) + tokens.count_tokens(" y", enc)
    got = odd(spark).select("doc_id", tokens.token_count(F.col("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(ODD)}


def test_sum_of_squares_rule():
    rng, cap = random.Random(8), 20
    s, gaps = packing.SumOfSquares(cap), {}
    for _ in range(400):
        size = rng.randint(1, cap)
        cost = lambda g: sum(n * n for k, n in Counter(g.values()).items() if 0 < k < cap)
        options = [cost({**gaps, b: left - size}) for b, left in gaps.items() if left >= size] + [cost({**gaps, "new": cap - size})]
        box = s.place(size)
        gaps[box] = gaps.get(box, cap) - size
        assert gaps[box] >= 0 and cost(gaps) == min(options)


def test_pack(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 60) for _ in range(3000)] + [0, None, 250, 100, 300]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, tokens int, container int")
    out = packing.pack(df, "doc_id", "tokens", 100, items_per_task=1000)
    rows = out.collect()
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["tokens"]
    assert dict(got) == {i: n or 0 for i, n in enumerate(sizes)}
    used = [r["used"] for r in packing.containers(out).collect()]
    assert max(used) <= 100 and sum(used) / (100 * len(used)) > 0.97
    parts = Counter(r["doc_id"] for r in rows)
    assert all(parts[i] == 1 for i, n in enumerate(sizes) if (n or 0) <= 100) and parts[3002] == 3 and parts[3003] == 1
    assert {r["container"] for r in rows if not r["tokens"]} == {None} and packing.pack(df.limit(0), "doc_id", "tokens", 100).count() == 0


def exact(parts):
    return {f"s{i}": Fraction(n, sum(parts)) for i, n in enumerate(parts)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_pfair_deviation(parts):
    weights = exact(parts)
    period = mixing.period_of(weights)
    table = mixing.pfair(weights, 2 * period)
    assert sorted(x for xs in table.values() for x in xs) == list(range(2 * period))
    for s, slots in table.items():
        for t in range(2 * period + 1):
            assert abs(sum(x < t for x in slots) - t * weights[s]) < 1
        one = mixing.pfair(weights, period)[s]
        assert slots == [mixing.slot_of(i, one, period) for i in range(len(slots))]


def test_pfair_over_a_whole_stream():
    # 10**12 tokens in blocks of 65,536: the slot of any block comes from the exact period, and stays within a block
    targets = [("a", 0.3375, 1), ("b", 0.0125, 1), ("c", 0.25, 1), ("d", 0.4, 1)]
    total, block = 10**12, 65_536
    weights = mixing.exact_weights(targets, {s: round(total * w) for s, w, _ in targets}, total)
    assert weights["b"] == Fraction(1, 80) and mixing.period_of(weights) == 80
    table = mixing.pfair(weights, 80)
    for s, w in weights.items():
        last = int(total * w) // block
        for i in [*range(200), *random.Random(1).sample(range(last), 2000), last - 1, last]:
            slot = mixing.slot_of(i, table[s], 80)
            assert i // w <= slot < -(-(i + 1) // w)  # released and not overdue: less than one block off, before and after
    # weights that are no short decimals: the whole stream is laid out
    odd = exact([999_983, 314_159, 27, 1])
    for s, slots in mixing.pfair(odd, 5000).items():
        assert all(i // odd[s] <= x < -(-(i + 1) // odd[s]) for i, x in enumerate(slots))


def test_mix(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", "other", None]), rng.randint(1, 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int").withColumn("copy", F.lit(1))
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 2), ("small", 0.25, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets, "doc_id", "source", "tokens", rows_per_bucket=300)
    got = out.collect()
    assert max(abs(r["actual_share"] - r["target_share"]) for r in mixing.shares(out, targets).collect()) < 0.01
    copies = Counter(r["doc_id"] for r in got)
    cap = {"big": 1, "mid": 2, "small": 4}
    source = {i: s for i, s, _ in rows}
    assert all(n <= cap[source[i]] for i, n in copies.items()) and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    run, total = Counter(), 0
    for r in sorted(got, key=lambda r: (r["slot"], r["place"])):
        run[r["source"]] += r["tokens"]
        total += r["tokens"]
        if total > 5000:
            assert abs(run["small"] / total - 0.25) < 0.06
    assert mixing.mix(df.limit(0), targets, "doc_id", "source", "tokens").count() == 0
    # a given total, a source that can't give its share, weights without a short period
    few = mixing.mix(df, targets, "doc_id", "source", "tokens", total=60_000, most_slots=2000).collect()
    assert Counter(r["source"] for r in few).keys() == {"big", "mid", "small"} and len({(r["doc_id"], r["copy"]) for r in few}) == len(few)
    own = [(r["slot"], r["place"]) for r in few if r["source"] == "mid"]
    assert len(set(own)) == len(own)
    assert mixing.plan([("a", 0.5, 1), ("b", 0.5, 3)], {"a": 100, "b": 20}) == (120, {"a": 60, "b": 60})
    assert mixing.plan([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 100}) == (100, {"a": 100})


def test_reading_levels(spark):
    easy = ["The cat sat. It ran off. We saw it go. I am sad."] * 30
    hard = ["The administrative representation of undocumented reconciliation strategies necessitates considerable deliberation regarding authentication, initialisation and intermediate validation responsibilities throughout."] * 30
    df = spark.createDataFrame(list(enumerate(easy + hard)), "doc_id long, text string").withColumn("level", F.lit(9))
    model = reading.train(df, [("EN", t) for t in easy[:1] + hard[:1]], commit=False)
    got = {r["doc_id"]: r for r in reading.reading_levels(df, model, commit=False).collect()}
    assert all(got[i]["level"] == 1 and got[30 + i]["level"] == 5 and got[i]["formula"] < got[59]["formula"] for i in range(30))
    assert reading.level_of(reading.formula(["The cat sat.", "It ran off."])) == 1 and [reading.level_of(x) for x in (29.9, 30, 45, 59, 60)] == [1, 2, 3, 4, 5]
    # a corpus of easy texts is easy: levels are absolute, and one that no text has is never given
    one = reading.train(df.filter("doc_id < 30"), [], commit=False)
    assert {r["level"] for r in reading.reading_levels(df, one, commit=False).collect()} == {1}
    empty = reading.LevelModel.fit([], [])
    assert [r["level"] for r in reading.reading_levels(df.limit(3), empty, commit=False).collect()] == [None] * 3
    o = {r["doc_id"]: r for r in reading.reading_levels(odd(spark), model).collect()}
    assert len(o) == len(ODD) and all(o[i]["level"] is None for i in range(4)) and reading.reading_levels(df.limit(0), model).count() == 0


def test_reading_levels_learn_from_all_texts(spark):
    # a text that makes up most of the rows, and 25,000 others: more than any sample would hold
    n = 25_000
    word = F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(word, F.lit(" runs on.")).alias("text"))
    df = df.union(spark.range(n).select(F.col("id") + n, F.lit("Same old text.")))
    rows = reading.measured(df, [], commit=False).cache()
    model = reading.train_measured(rows, [], vocabulary=2 * n)
    assert model.vocabulary["other"]["same"] == model.vocabulary["other"]["runs"] == n and len(model.vocabulary["other"]) == n + 5
    assert sum(model.texts.values()) == 2 * n
    assert reading.levels_measured(rows, model).filter("level is null").count() == 0
    # the driver's fit and Spark's agree
    some = df.limit(500)
    one, two = reading.train(some, [], commit=False), reading.LevelModel.fit([[r["text"]] for r in some.collect()], [])
    assert (one.texts, one.words, one.totals, one.vocabulary) == (two.texts, two.words, two.totals, two.vocabulary)


def test_message_column(spark):
    df = spark.createDataFrame([("a\ndiff --git x\nb",), ("no hunks",), (None,), ("diff --git x",)], "t string")
    assert [r[0] for r in df.select(message(F.col("t"))).collect()] == ["a\n", "no hunks", None, ""]
