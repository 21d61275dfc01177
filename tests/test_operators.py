"""Training, models, detection against hand-made cases and brute force."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lingmill.config import CUTS, BuilderConfig, ConverterConfig, DetectorConfig, EngineConfig, RussianConfig, ServiceConfig, TrainConfig
from lingmill.operators import detect as D
from lingmill.operators import model as M
from lingmill.operators import russian as R
from lingmill.operators import train as T
from lingmill.plans.engine import Engine, build_models
from lingmill.sources import model_files as MF
from lingmill.sources.model_text import read_lines


def counts(spark, rows):
    return spark.createDataFrame([("g", d, n, w, c) for d, n, w, c in rows], "grp string, doc string, n tinyint, ngram string, cnt bigint")


def docs(spark, rows):
    return spark.createDataFrame([("g", d, t.split()) for d, t in rows], "grp string, doc string, tokens array<string>")


def test_cut_example(spark):
    c = counts(spark, [("d", 1, "A", 50), ("d", 1, "B", 30), ("d", 1, "C", 15), ("d", 1, "D", 5)])
    assert {r["ngram"] for r in T.cut_counts(c, 1).collect()} == {"A", "B", "C"}
    assert {r["ngram"] for r in T.cut_counts(c, 2).collect()} == {"A"}
    assert T.cut_counts(c, 0).count() == 4
    assert T.cut_counts(c.limit(0), 1).count() == 0


def test_cut_against_sorting(spark):
    import random

    rng = random.Random(3)
    rows = [(f"d{i % 3}", n, f"{rng.choice('abc')}{rng.choice('xyz')}{k}", rng.choice([1, 1, 1, 2, 3, 9])) for i in range(3) for n in (1, 2, 3, 4) for k in range(60)]
    rows = list({(d, n, w): (d, n, w, c) for d, n, w, c in rows}.values())
    for cut in (1, 2):
        want = set()
        for key in {(d, n) for d, n, _, _ in rows}:
            mine = sorted([(w, c) for d, n, w, c in rows if (d, n) == key], key=lambda x: (-x[1], x[0]))
            total, run = sum(c for _, c in mine), 0
            for w, c in mine:
                run += c
                if run * 100 > CUTS[cut][key[1]] * total:
                    break
                want.add((*key, w))
        assert {(r["doc"], r["n"], r["ngram"]) for r in T.cut_counts(counts(spark, rows), cut).collect()} == want


def test_weights(spark):
    c = T.count_ngrams(docs(spark, [("d1", "A A B"), ("d2", "B C")]), 1)
    w = {(r["doc"], r["ngram"]): r["weight"] for r in T.tfidf(c).collect()}
    assert w == {("d1", "A"): pytest.approx(math.log(2)), ("d2", "C"): pytest.approx(math.log(2) / 2)}
    one = {r["ngram"]: r["weight"] for r in T.tfidf_one_dimension(c, 4, "d1").collect()}
    assert one == {"A": pytest.approx(math.log(4)), "B": pytest.approx(math.log(2) / 2)}
    b = {(r["doc"], r["ngram"]): r["weight"] for r in T.bm25(c).collect()}
    assert b["d1", "A"] == pytest.approx(6 / (2 * (0.25 + 0.75 * 3 / 2.5) + 2) * math.log(1.5 / 1.5))
    r = {(x["doc"], x["ngram"]): (x["weight"], x["absent"]) for x in T.residual_idf(c).collect()}
    assert r["d1", "A"] == (pytest.approx(math.log(2) + math.log(1 - math.exp(-1))), pytest.approx(math.log(2)))
    assert T.train(docs(spark, [("d1", "A A B")])).count() == 0  # one document: nothing weighs


def test_counting(spark):
    d = docs(spark, [("d", "a b a b"), ("d", "a"), ("e", "")])
    c = {(r["n"], r["ngram"]): r["cnt"] for r in T.count_ngrams(d, 2).filter("doc = 'd'").collect()}
    assert c == {(1, "a"): 3, (1, "b"): 2, (2, "a b"): 2, (2, "b a"): 1}
    skip = T.count_ngrams(docs(spark, [("d", "a ж b")]), 2, F.lit(True), "reset")
    assert {r["ngram"] for r in skip.collect()} == {"a", "b"}
    assert "a b" in {r["ngram"] for r in T.count_ngrams(docs(spark, [("d", "a ж b")]), 2, F.lit(True), "bridge").collect()}
    part = counts(spark, [("d", 1, "A", 1), ("d", 1, "B", 2)])
    assert {r["ngram"]: r["cnt"] for r in T.merge_counts(part, part).collect()} == {"A": 2, "B": 4}


def grams(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("block", [2, 10_000])
def test_ngrams_over_lines(spark, block, monkeypatch):
    """Against files read as one text; lines that are empty, short, long; two documents; any blocks."""
    import random

    monkeypatch.setattr(T.join_lines, "__defaults__", (block,))
    rng, rows, files = random.Random(7), [], {}
    for doc in ("d", "e", None):
        for no in range(1, 40):
            words = [rng.choice("abcdж") for _ in range(rng.choice([0, 0, 1, 1, 2, 5]))]
            rows.append(("g", doc, no * 3, words))
            files.setdefault(doc, []).extend(words)
    df = spark.createDataFrame(rows, "grp string, doc string, no long, tokens array<string>").orderBy(F.rand(1))
    got = Counter({(r["doc"], r["n"], r["ngram"]): r["cnt"] for r in T.count_ngrams(df, 4, line_col="no").collect()})
    assert got == Counter((doc, n, g) for doc, ws in files.items() for n in (1, 2, 3, 4) for g in grams(ws, n))
    for gap in ("bridge", "reset"):
        got = Counter({(r["doc"], r["n"], r["ngram"]): r["cnt"] for r in T.count_ngrams(df, 3, F.lit(True), gap, "no").collect()})
        want = Counter()
        for doc, ws in files.items():
            parts = [[w for w in ws if w != "ж"]] if gap == "bridge" else [p.split() for p in " ".join(ws).split("ж")]
            want.update((doc, n, g) for p in parts for n in (1, 2, 3) for g in grams(p, n))
        assert got == want, gap
    assert T.count_ngrams(df.limit(0), 2, line_col="no").count() == 0
    texts = spark.createDataFrame([("k", 2, "c d\r\ne"), ("k", 1, "a\n\nb"), ("k", 3, None)], "doc string, id long, text string")
    assert [r["text"] for r in T.split_lines(texts, ["doc"], "id").orderBy("line_no").collect()] == ["a", "", "b", "c d", "e"]


def test_lines_of_files_in_many_splits(spark, tmp_path):
    want = {}
    for name, n in (("one.txt", 3000), ("two.txt", 1), ("three.txt", 700)):
        lines = [f"{name} {i} {'x' * (i % 50)}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        want |= {(name, i + 1): t for i, t in enumerate(lines)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r["file_name"].rsplit("/", 1)[1], r["line_no"]): r["line_text"] for r in rows} == want and len(rows) == len(want)


def test_text_model_files(spark, tmp_path):
    rows = [("g", "en.txt", "FOO", 0.5), ("g", "en.txt", "BAR", 0.25), ("g", "en.txt", "NONE", 0.0), ("h", "a.b c", "FOO", 1e-7)]
    m = spark.createDataFrame(rows, "grp string, doc string, ngram string, weight double")
    files = MF.write_text_model(m, str(tmp_path), rows_per_file=10)
    assert [f.removeprefix(str(tmp_path)) for f in files] == ["/g/en-(ngram_2-cut_1).txt", "/h/a-(ngram_2-cut_1).b c"]
    first, *rest = open(files[0], encoding="utf-8").read().splitlines()
    assert first == "#\t'en.txt' (ngram_2-cut_1)" and sorted(rest) == ["BAR\t0.25", "FOO\t0.5"]
    back = MF.read_text_model(spark, {"EN": files[0], "X": files[1]})
    assert {(r["ngram"], r["lang"], round(r["weight"], 9)) for r in back.collect()} == {("FOO", "EN", 0.5), ("BAR", "EN", 0.25), ("FOO", "X", 1e-7)}
    many = MF.write_text_model(m, str(tmp_path / "many"), 1, 2, rows_per_file=1)
    assert len(many) == 3 and all(open(f, encoding="utf-8").readline().startswith("#") for f in many) and MF.read_text_model(spark, {"EN": many}).count() == 3
    assert MF.write_text_model(m.limit(0), str(tmp_path / "none")) == []
    ids = {"EN": 1, "X": 2}
    binary = MF.convert_text_to_binary(spark, {"EN": files[0], "X": files[1]}, ids, f"file://{tmp_path}/bin")
    assert M.compare(back, MF.read_binary_model(spark, binary, ids)).count() == 0


def test_build_from_settings(spark, tmp_path):
    for group, doc, text in (("latin", "en.txt", "the cat sat\non the mat ж\n"), ("latin", "fr.txt", "le chat est\nla\n"), ("slavic", "ru.txt", "кот на\nкоте"), ("slavic", "bg.txt", "котка")):
        (tmp_path / "in" / group).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / group / doc).write_text(text, encoding="utf-8")
    cfg = BuilderConfig(input_folder=str(tmp_path / "in"), groups=("latin", "slavic"), groups_without_cyrillic=("latin",), output_folder=str(tmp_path / "out"), train=TrainConfig(cut=0))
    files = build_models(spark, cfg)
    assert [f.removeprefix(str(tmp_path / "out")) for f in files] == ["/latin/en-(ngram_2-cut_0).txt", "/latin/fr-(ngram_2-cut_0).txt", "/slavic/bg-(ngram_2-cut_0).txt", "/slavic/ru-(ngram_2-cut_0).txt"]
    got = {r["ngram"] for r in MF.read_text_model(spark, {"EN": files[0]}).collect()}
    assert "SAT ON" in got and "Ж" not in got and "НА КОТЕ" in {r["ngram"] for r in MF.read_text_model(spark, {"RU": files[3]}).collect()}
    (tmp_path / "in" / "latin" / "empty.txt").write_text("\n", encoding="utf-8")
    with pytest.raises(ValueError, match="latin/empty.txt"):
        build_models(spark, cfg)


def test_scoring_strategy(spark):
    t = texts(spark, ["foo bar baz"])
    plain = D.detect(t, model(spark), "id", weigh=lambda w, hits, terms: w).first()["langs"]
    assert [(x["lang"], x["weight"]) for x in plain] == [("EN", pytest.approx(0.7)), ("DE", pytest.approx(0.1))]


def test_one_failing_setting_does_not_stop_the_others(spark):
    d = docs(spark, [("d1", "a b c a"), ("d2", "x y z x")])
    bad, errors = TrainConfig(), {}
    object.__setattr__(bad, "weighting", "none such")
    with pytest.warns(UserWarning, match="order 2"):
        got = T.train_all(d, [bad, TrainConfig(order=1)], errors)
    assert {(r["order"], r["cut"]) for r in got.select("order", "cut").distinct().collect()} == {(1, 1)} and list(errors) == [(2, 1)]
    with pytest.raises(KeyError), pytest.warns(UserWarning):
        T.train_all(d, [bad])


def test_order_and_empty(spark):
    c = counts(spark, [("d", 1, "B", 2), ("d", 1, "A", 2), ("d", 1, "C", 3)])
    assert [r["ngram"] for r in T.ordered(c).collect()] == ["C", "A", "B"] and [r["ngram"] for r in T.ordered(c, "desc").collect()] == ["C", "B", "A"]
    assert [r["ngram"] for r in T.most_frequent(c, 2).orderBy("rank").collect()] == ["C", "A"]
    d = spark.createDataFrame([("g", "d", ["a"]), ("g", "e", []), ("g", "f", None)], "grp string, doc string, tokens array<string>")
    assert {r["doc"] for r in T.empty_documents(d).collect()} == {"e", "f"}
    with pytest.raises(ValueError, match="g/"):
        T.require_words(d)


def test_all_models(spark):
    d = docs(spark, [("d1", "a b c a"), ("d2", "x y z x")])
    assert {(r["order"], r["cut"]) for r in T.train_all(d).select("order", "cut").distinct().collect()} == {(1, 1), (1, 2), (2, 1)} | {(2, 2)}


MODEL = [("FOO", "EN", 0.2), ("BAR", "EN", 0.1), ("BAR", "DE", 0.1), ("FOO BAR", "EN", 0.4)]


def model(spark, rows=MODEL):
    return spark.createDataFrame(rows, "ngram string, lang string, weight double")


def texts(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else t.upper().split()) for i, t in enumerate(rows)], "id int, text string, tokens array<string>")


def test_detect_example(spark):
    t = texts(spark, ["foo bar baz", "zzz", "", None])
    got = {r["id"]: r for r in D.detect(t, model(spark), "id").collect()}
    assert [tuple(x) for x in got[0]["langs"]] == [("EN", pytest.approx(0.7), 95)]
    assert got[1]["reason"] == "no weight" and got[2]["reason"] == got[3]["reason"] == "no terms"
    per = {r["lang"]: (r["weight_sum"], r["hits"]) for r in D.scores(t, model(spark), "id").filter("id = 0").collect()}
    assert per == {"EN": (pytest.approx(0.7), 3), "DE": (pytest.approx(0.1), 1)}
    assert D.detect(t.limit(0), model(spark), "id").count() == 0


def brute_force(words, table, config=None):
    """The ranked languages of one text, word by word."""
    sums, detected = {}, 0
    for i, w in enumerate(words):
        found = False
        for g in (w, f"{words[i - 1]} {w}" if i else None):
            for lang, weight in table.get(g, ()):
                acc = sums.setdefault(lang, [0.0, 0])
                acc[0], acc[1], found = acc[0] + weight, acc[1] + 1, True
        detected += found
    return D.decide(len(words), detected, [(lang, w, h) for lang, (w, h) in sums.items()], config or DetectorConfig())


@pytest.mark.parametrize("local", [True, False])
def test_detect_against_brute_force(spark, local):
    import random

    rng = random.Random(1)
    words = [f"W{i}" for i in range(12)] + ["ЖЁ", "É"]
    rows = [(rng.choice(words) if rng.random() < 0.6 else f"{rng.choice(words)} {rng.choice(words)}", rng.choice(["EN", "DE", "FR", "ES"]), rng.random()) for _ in range(60)]
    rows += rows[:10]  # the same n-gram and language twice counts twice
    ts = [" ".join(rng.choice([*words, "X", "Y"]) for _ in range(rng.randint(0, 20))) for _ in range(40)]
    t, m = texts(spark, ts), model(spark, rows)
    got = {r["id"]: [tuple(x) for x in r["langs"]] for r in D.detect(t, m, "id", local_bytes=D.LOCAL_BYTES if local else 0).collect()}
    table = {}
    for g, lang, w in rows:
        table.setdefault(g, []).append((lang, w))
    for i, s in enumerate(ts):
        assert got[i] == [(a, pytest.approx(w), p) for a, w, p in brute_force(s.split(), table)]
    per = {(r["id"], r["lang"]): (r["terms"], r["detected"], r["hits"]) for r in D.scores(t, m, "id", local_bytes=D.LOCAL_BYTES if local else 0).collect()}
    for i, s in enumerate(ts):
        ws = s.split()
        grams = [[w] + ([f"{ws[k - 1]} {w}"] if k else []) for k, w in enumerate(ws)]
        hits = Counter(lang for gs in grams for g in gs for lang, _ in table.get(g, ()))
        assert {lang for j, lang in per if j == i} == (set(hits) or {None})
        for lang in set(hits) or {None}:
            assert per[i, lang] == (len(ws), sum(any(g in table for g in gs) for gs in grams), hits.get(lang) if lang else None)


def test_local_model_of_any_size(spark):
    """Many n-grams, longer than a hash's words, found and not found; empty and too large models."""
    import numpy as np
    import pyarrow as pa

    from lingmill.functions import scan

    n = 200_000
    m = spark.range(n).select(F.concat(F.lit("N"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 1, F.concat(F.lit(" G"), F.col("id").cast("string"))).otherwise("")).alias("ngram"), F.lit("EN").alias("lang"), F.lit(1.0).alias("weight"))
    t = texts(spark, ["n0 n1 g1 n3 g4 n2", "g3 n3 g3 n199999 g199999", "x" * 70_000])
    got = {r["id"]: (r["terms"], r["detected"], r["hits"]) for r in D.scores(t, m, "id").collect()}
    assert got == {0: (6, 3, 3), 1: (5, 2, 2), 2: (1, 0, None)}
    keys, checks = scan.keys(scan.hashes(*scan.strings(pa.array([f"A{i} B{i % 7}" for i in range(300_000)]))))
    assert len(set(keys.tolist())) == 300_000 and len(np.unique(checks)) > 299_900
    with pytest.raises(ValueError, match="joining form"):
        D.LocalDetector(m, max_bytes=1000)
    assert [r["reason"] for r in D.detect(t, m.limit(0), "id").collect()] == ["no weight"] * 3


def test_thresholds(spark):
    rows = lambda ps: [(f"L{i}", "L" + str(i), p / 100) for i, p in enumerate(ps)]
    run = lambda ps: D.detect(texts(spark, [" ".join(f"L{i}" for i in range(len(ps)))]), model(spark, rows(ps)), "id").first()
    assert run([36, 33, 31])["reason"] == "three close languages"
    assert [x["percent"] for x in run([50, 30, 20])["langs"]] == [50, 30, 20]
    few = lambda n: D.detect(texts(spark, [" ".join(["FOO"] + ["X"] * (n - 1))]), model(spark), "id", config=DetectorConfig(min_percent_of_words=20)).first()["reason"]
    assert few(9) is None and few(10) == "few detected words"
    for bad in ({"min_percent": 101}, {"word_count": -1}):
        with pytest.raises(ValueError):
            DetectorConfig(**bad)
    with pytest.raises(ValueError):
        RussianConfig(threshold=2)
    with pytest.raises(ValueError):
        TrainConfig(order=7)
    assert TrainConfig(order=7, cut=9, strict=False) == TrainConfig(order=2, cut=1, strict=False)


def test_views(spark):
    d = D.detect(texts(spark, ["foo bar baz", "zzz"]), model(spark), "id")
    assert [tuple(r) for r in D.long_form(d, "id").collect()] == [(0, 1, "EN", pytest.approx(0.7), 95)]
    assert {r["id"]: r["lang"] for r in D.top(d, "id").collect()} == {0: "EN", 1: None}
    shown = {r["id"]: r for r in d.select("id", D.as_text(F.col("langs")).alias("t"), D.as_json(F.col("langs"), {"EN": "English"}).alias("j")).collect()}
    assert shown[0]["t"] == "EN, 95 %" and shown[1]["t"] == "[text language is not defined]"
    assert shown[0]["j"] == '{"langs":[{"l":"EN","n":"English","p":95}]}' and shown[1]["j"] == '{"langs":[]}'


def test_russian(spark):
    t = texts(spark, ["аа бб вв", "аа", "hello world", " "])
    got = {r["id"]: r for r in R.detect_ru(t, spark.createDataFrame([("АА",), ("ББ",), ("АА ББ",)], "ngram string"), "id").collect()}
    assert got[0]["weight"] == 1.5 and got[0]["is_russian"] and got[1]["weight"] == 0 and not got[1]["is_russian"]
    assert not got[2]["gate"] and got[2]["weight"] == 0 and got[3]["is_russian"] is None


def test_models(spark, tmp_path):
    m = model(spark, [*MODEL, MODEL[0]])
    assert M.record_count(m).first()["n"] == 3
    assert Counter(map(tuple, M.unnested(M.nested(m)).collect())) == Counter(map(tuple, m.collect()))
    assert M.compare(m, m).count() == 0
    assert {(r["ngram"], r["only_in"]) for r in M.compare(m, model(spark, [("NEW", "EN", 1.0), *MODEL])).collect()} == {("NEW", "second"), ("FOO", "both")}
    assert {r[0] for r in M.intersect(m, model(spark, MODEL[:1])).collect()} == {"FOO"} and M.difference(m, model(spark, MODEL[:1])).count() == 2
    assert M.union(m, m).count() == 10
    assert {r["ngram"] for r in M.from_long(spark.createDataFrame([(" ёж ", "RU", 1.0), (None, "RU", 1.0), ("x", None, 1.0)], "t string, l string, w double"), "t", "l", "w").collect()} == {"ЕЖ"}
    ids = {"EN": 1, "DE": 8}
    f32 = m.withColumn("weight", F.col("weight").cast("float").cast("double"))
    for size, many in ((25_000_000, None), (1, True)):
        folder = str(tmp_path / f"bin{size}")
        files = MF.write_binary_model(f32, ids, folder, part_bytes=size)
        assert (len(files) == 3) if many else files
        assert M.compare(f32, MF.read_binary_model(spark, folder, ids)).count() == 0
    with pytest.raises(ValueError):
        MF.write_binary_model(m.limit(0), ids, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        list(MF.decode_records(b"A\0"))
    assert list(MF.decode_records(MF.encode_record("Ж X", [(3, 0.5)]))) == [("Ж X", [(3, 0.5)])]
    MF.save_model(m, str(tmp_path / "pq"))
    assert M.compare(m, MF.load_model(spark, str(tmp_path / "pq"))).count() == 0


def test_engine_and_files(spark, tmp_path):
    (tmp_path / "en.txt").write_text("#\thead\nfoo\t0.2\nbar\t0.1\nfoo bar\t0.4\n", encoding="utf-8")
    (tmp_path / "de.txt").write_text("﻿# head\nbar\t1e-1\n", encoding="utf-8")
    e = Engine.create(spark, EngineConfig(model_path=str(tmp_path), model_format="text"), text_files={"EN": "en.txt", "DE": "de.txt"})
    df = spark.createDataFrame([(0, "Foo, bar baz")], "id int, text string")
    assert D.top(e.detect(df, "id"), "id").first()["lang"] == "EN"
    assert e.detect_ru(df, R.russian_vocabulary(e.model), "id").first()["is_russian"] is False
    (tmp_path / "bad.txt").write_text("foo\n", encoding="utf-8")
    with pytest.raises(Exception, match="wrong number of fields"):
        MF.read_text_model(spark, {"EN": str(tmp_path / "bad.txt")}).collect()
    with pytest.raises(Exception, match="wrong number of fields"):
        MF.read_text_model(spark, {"EN": str(tmp_path / "bad.txt")}, strict=False).collect()
    (tmp_path / "gaps.txt").write_text("\nfoo\t1\n \t\nbar\t2\n", encoding="utf-8")
    assert {r["ngram"] for r in MF.read_text_model(spark, {"EN": str(tmp_path / "gaps.txt")}, strict=False).collect()} == {"FOO", "BAR"}
    with pytest.raises(Exception, match="line 1: blank line"):
        MF.read_text_model(spark, {"EN": str(tmp_path / "gaps.txt")}).collect()
    both = MF.model_rejects(spark, {"EN": [str(tmp_path / "bad.txt"), str(tmp_path / "gaps.txt")]}).collect()
    assert {(r["file_name"].rsplit("/", 1)[1], r["line_no"], r["reason"]) for r in both} == {("bad.txt", 1, "wrong number of fields: 1"), ("gaps.txt", 1, "blank line"), ("gaps.txt", 3, "blank line")}
    assert MF.read_text_model(spark, {}).count() == 0
    (tmp_path / "c" / "german").mkdir(parents=True)
    (tmp_path / "c" / "german" / "a.txt").write_text("eins\nzwei", encoding="utf-8")
    assert [(r["grp"], r["doc"], r["line_no"], r["text"]) for r in MF.read_corpus(spark, str(tmp_path / "c")).orderBy("line_no").collect()] == [("german", "a.txt", 1, "eins"), ("german", "a.txt", 2, "zwei")]
    assert MF.read_texts(spark, str(tmp_path / "c"), max_chars=3).first()["text"] == "ein..."
    (tmp_path / "c" / "german" / "long.txt").write_text("x" * 10_000_001, encoding="utf-8")
    assert MF.read_texts(spark, str(tmp_path / "c"), "long.txt").select(F.length("text")).first()[0] == 10_000_001  # nothing is cut unasked
    assert [(r["doc"], r["bytes"]) for r in MF.corpus_files(spark, str(tmp_path / "c")).collect()] == [("long.txt", 10_000_001), ("a.txt", 9)]
    cfg = EngineConfig.from_mapping({"ML_THRESHOLD_PERCENT": "12", "RU_THRESHOLD": "0.4", "BINARY_MODEL_FOLDER": "x"})
    assert cfg.detector.min_percent == 12 and cfg.russian.threshold == 0.4 and cfg.model_format == "binary"
    cfg = EngineConfig.from_mapping({"LANGUAGE_MODELS_FOLDER": "m/", "EN": "en.txt", "RU-ML": "ru.txt", "RU-RU": "ru-only.txt", "DE": " "}, ["EN", "DE", "RU"])
    assert cfg.text_files == {"EN": "m/en.txt", "RU": "m/ru.txt"} and cfg.russian_file == "m/ru-only.txt" and cfg.model_format == "text"
    cfg = EngineConfig.from_mapping({"BINARY_MODEL_FOLDER": "b", "BINARY_MODEL_FILE_NAMES": "x-1.bin; x-2.bin;"})
    assert cfg.binary_files == ("b/x-1.bin", "b/x-2.bin")
    cfg = ConverterConfig.from_mapping({"OUTPUT_FILE_NAME": "o", "OUTPUT_FILE_SIZE_IN_BYTES": "12", "EN": "en.txt"}, ["EN"])
    assert (cfg.output_name, cfg.part_bytes, cfg.text_files) == ("o", 12, {"EN": "en.txt"})
    cfg = BuilderConfig.from_mapping({"NGARMS": "ngram_4", "CUT_THRESHOLD": "cut_2", "BUILD_MODE": "all_possible_models", "INPUT_FOLDERS_BY_LANGUAGE": "a;\n b ;"})
    assert (cfg.train.order, cfg.train.cut, cfg.all_models, cfg.groups) == (2, 2, True, ("a", "b"))
    assert ServiceConfig.from_mapping({"CONCURRENT_FACTORY_INSTANCE_COUNT": "7"}).instances == 7
    with pytest.raises(LookupError):
        BuilderConfig(input_encoding="no such thing")
    with pytest.raises(ValueError, match="ML_THRESHOLD_PERCENT"):
        DetectorConfig.from_mapping({"ML_THRESHOLD_PERCENT": "many"})


def test_stream(spark, tmp_path):
    from lingmill.streaming.detect import detect_stream, language_counts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, "foo bar baz"), (1, "zzz")], "id int, text string").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp")).write.parquet(src)
    local = D.LocalDetector(model(spark))
    stream = detect_stream(spark.readStream.schema("id int, text string, ts timestamp").parquet(src), local)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert {r["id"]: [x["lang"] for x in r["langs"]] for r in spark.read.parquet(out).collect()} == {0: ["EN"], 1: []}
    got = language_counts(detect_stream(spark.read.parquet(src), local), "ts")
    assert {(r["lang"], r["n"]) for r in got.collect()} == {("EN", 1), ("unknown", 1)}


def test_joined_detection_moves_each_ngram_once(spark):
    """What the joining form writes does not grow with the occurrences of n-grams."""
    import random
    from pathlib import Path
    from urllib.parse import urlparse

    from lingmill.session import checkpoint_dir

    rng = random.Random(2)
    words = [f"W{i}" for i in range(12)]
    ts = texts(spark, [" ".join(rng.choice(words) for _ in range(200)) for _ in range(2_000)])
    size = lambda: sum(p.stat().st_size for p in Path(urlparse(checkpoint_dir(spark)).path).rglob("*") if p.is_file())
    before = size()
    got = D.detect(ts, model(spark, [(w, lang, 0.5) for w in words for lang in ("EN", "DE", "FR")]), "id", local_bytes=0)
    assert got.count() == 2_000
    assert size() - before < 2_000_000


@pytest.mark.parametrize(("batch_words", "part_rows"), [(1, 1), (37, 5), (10**6, 10**6)])
def test_joined_detection_in_any_batches(spark, batch_words, part_rows):
    """Batches and parts of any size give the sums of the lookup; null words match nothing, and no n-gram reaches over them."""
    import random

    from lingmill.operators import joined

    rng = random.Random(3)
    words = [f"W{i}" for i in range(9)] + ["ЖЁ", "É"]
    rows = [(rng.choice(words) if rng.random() < 0.5 else f"{rng.choice(words)} {rng.choice(words)}", rng.choice(["EN", "DE", "FR"]), rng.random()) for _ in range(80)]
    ts = [[rng.choice([*words, "X"]) for _ in range(rng.randint(0, 30))] for _ in range(60)] + [None, [], ["W1"] * 300]
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(ts)], "id string, tokens array<string>")
    cells = M.merged(model(spark, rows))
    read = lambda d: {r["id"]: (r["terms"], r["detected"], {x["lang"]: (pytest.approx(x["weight_sum"]), x["hits"]) for x in r["x"]}) for r in d.collect()}
    got = read(joined.scored(t, cells, cells.count(), "id", "tokens", batch_words, part_rows))
    local = t.select("id", D.LocalDetector(model(spark, rows)).scored(F.col("tokens")).alias("s")).select("id", "s.*")
    assert len(got) == len(ts) and got == read(local)
    gaps = spark.createDataFrame([(1, ["W1", None, "W2", "W2"]), (2, [None])], "id int, tokens array<string>")
    one = M.merged(model(spark, [("W1", "EN", 1.0), ("W1 W2", "EN", 1.0), ("W2 W2", "DE", 2.0), ("", "EN", 1.0), (" W2", "EN", 1.0), (None, "EN", 1.0), ("W2", None, 0.5)]))
    assert read(joined.scored(gaps, one, 7, "id", "tokens", batch_words, part_rows)) == {1: (4, 3, {"EN": (1.0, 1), "DE": (2.0, 1), None: (1.0, 2)}), 2: (1, 0, {})}
