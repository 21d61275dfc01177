"""Queries of the problems, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm import distinct, langlabel, mixing, mojibake, packing, reading, skeleton, split, termfreq, tokens
from lingmill.llm.message import message
from lingmill.session import blank, cut_lineage, spread, table

#: At most so many labelled samples are read on the driver (the table is fixed, of 390 rows).
MAX_SAMPLES = 10_000


def labelled_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lang_samples").filter("language is not null and text is not null")


def samples(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    rows = labelled_samples(spark, d).orderBy("sample_id").limit(MAX_SAMPLES).collect()
    return [(r["language"], r["text"]) for r in rows]


def codes(spark: SparkSession, d: str) -> dict[str, str]:
    return {r["code"]: r["name"] for r in table(spark, d, "languages").limit(1000).collect()}


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, text) of documents and requests."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text")
    reqs = table(spark, d, "requests").select(F.lit("requests").alias("tbl"), F.col("req_id").alias("row_id"), "text")
    return spread(docs).unionByName(spread(reqs))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_texts(spread(table(spark, d, "documents")))
    return pieces.filter("n_pieces > 1 and piece_no = 0").select("doc_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(spread(table(spark, d, "documents")))


#: (table, id, columns in which rows must agree) of the tables with texts that may look the same
LOOKALIKES = (("documents", "doc_id", None), ("requests", "req_id", None), ("model_pairs", "pair_id", ["language"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [skeleton.lookalike_pairs(spread(table(spark, d, name)), id_col, "text", within).select(F.lit(name).alias("tbl"), "id_a", "id_b") for name, id_col, within in LOOKALIKES]
    return reduce(DataFrame.unionByName, parts)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, class, form): the class and the form of every row with a text."""
    parts = [skeleton.lookalike_classes(spread(table(spark, d, name)), id_col, "text", within).select(F.lit(name).alias("tbl"), F.col(id_col).alias("id"), "class", "form") for name, id_col, within in LOOKALIKES]
    return reduce(DataFrame.unionByName, parts)


def p4_langs(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, label, langs): the stretches of every document's message and every request."""
    docs = spread(table(spark, d, "documents")).select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), message(F.col("text")).alias("text"), F.col("lang").alias("label"), F.lit(True).alias("commit"))
    reqs = spread(table(spark, d, "requests")).select(F.lit("requests").alias("tbl"), F.col("req_id").alias("row_id"), "text", F.lit(None).cast("string").alias("label"), F.lit(False).alias("commit"))
    known = samples(spark, d)
    learned = mojibake.learn(docs.select("text").unionByName(reqs.select("text")), [t for _, t in known])
    looked = [langlabel.identify(x, known, learned).select("tbl", "row_id", "label", "langs") for x in (docs, reqs)]
    # the answers meet the languages found, not the texts
    answers = table(spark, d, "responses").filter("rank_no = 1").groupBy("req_id").agg(F.max_by("l", F.struct("logged_at", "resp_id")).alias("answer"))
    labelled = looked[1].join(answers, F.col("row_id") == F.col("req_id"), "left").select("tbl", "row_id", F.col("answer").alias("label"), "langs")
    return looked[0].unionByName(labelled)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cases = langlabel.label_cases(p4_langs(spark, d), "label", codes(spark, d)).filter("case is not null")
    return cases.select("tbl", "row_id", F.explode("languages").alias("language"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, restored, lost) of the garbled rows."""
    both = texts(spark, d)
    clean = mojibake.CharModel.fit_column(labelled_samples(spark, d))
    learned = mojibake.learn(both, clean)
    got = mojibake.with_repair(both, learned, clean).filter("repair.garbled")
    return got.select("tbl", "row_id", F.col("repair.restored").alias("restored"), F.col("repair.lost").alias("lost"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).select("tbl", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_bands(table(spark, d, "word_t")).select("value", F.explode("bands").alias("band"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_counts(table(spark, d, "word_t"))


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinct.term_scores(table(spark, d, "model_pairs"), "language", "text", "weight")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return distinct.top_terms(p7_scores(spark, d), "language", "text").select("language", "text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))
    return packing.pack(docs, "doc_id", "tokens", capacity=2048)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).filter(~blank("source")).select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs, table(spark, d, "mix_targets"), "doc_id", "source", "tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    known = samples(spark, d)
    rows = cut_lineage(reading.measured(spread(table(spark, d, "documents")), known))
    return reading.levels_measured(rows, reading.train_measured(rows, known))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_classes, p4_found, p4_langs, p5_found, p5_repaired, p6_found, p6_counts, p7_found, p7_scores, p8_pack, p9_mix, p9_shares, p10_levels)}
