"""Registered queries over small tables of their own."""

import pytest

from tests.exact import tokens_exact
from lingmill.functions.urls import UrlRules
from lingmill.plans.queries import QUERIES

SAMPLES = [(1, "EN", "the small server reads the file"), (2, "DE", "der kleine dienst liest die datei")]
REQUESTS = [(1, "der dienst https://www.example.org/the/small/server liest"), (2, "www.example.org"), (3, "the file, see me@example.org now"), (4, None), (5, "the server"), (6, "и www.example.org а the file")]
RESPONSES = [(1, 1, 1, "DE", 0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("lang_samples", SAMPLES, "sample_id long, language string, text string"),
        ("requests", REQUESTS, "req_id long, text string"),
        ("responses", RESPONSES, "resp_id long, req_id long, rank_no int, l string, logged_at int"),
        ("languages", [("EN", "English"), ("DE", "German")], "code string, name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_requests_without_urls(spark, tables):
    run = lambda name: QUERIES[name](spark, tables).collect()
    words = {i: tokens_exact(t, UrlRules.default(spark)) for i, t in REQUESTS if t is not None}
    assert words[1] == ["DER", "DIENST", "LIEST"] and words[2] == []
    assert {r["req_id"]: r["words"].split("|") if r["words"] else [] for r in run("tokens_requests")} == words
    assert {r["req_id"]: r["terms"] for r in run("lang_scores")} == {i: len(w) for i, w in words.items()} | {4: 0}
    assert {r["req_id"] for r in run("empty_documents")} == {2, 4}
    best = {1: ("DE", 100), 2: (None, None), 3: ("EN", 100), 4: (None, None), 5: ("EN", 100), 6: ("EN", 100)}
    for name in ("detect_top", "detect_local", "detect_joined", "detect_engine", "detect_shipped"):
        assert {r["req_id"]: (r["lang"], r["percent"]) for r in run(name)} == best, name
    assert {(r["req_id"], r["lang"]) for r in run("detect_long")} == {(i, lang) for i, (lang, _) in best.items() if lang}
    assert {(r["reason"], r["n"]) for r in run("detect_unknown_reason")} == {(None, 4), ("no terms", 2)}
    assert {r["req_id"]: "DE" in r["shown"] for r in run("detect_json")}[1] and not [r for r in run("detect_json") if r["req_id"] == 1 and "EN" in r["shown"]]
    assert {(r["label"], r["lang"]): r["n"] for r in run("confusion_matrix")} == {("DE", "DE"): 1, (None, None): 2, (None, "EN"): 3}
    assert not {w for r in run("skip_cyrillic_counts") for w in r["ngram"].split()} & {"HTTPS", "WWW", "EXAMPLE", "ORG"}
    assert len(run("ru_score")) == len(REQUESTS)
