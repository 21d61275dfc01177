"""Problem 6: frequency of every distinct value or term.

Method: heavy-light aggregation. Heavy terms are detected by a bounded sketch over all rows and broadcast. Rows
delivered again count once and documents are counted, so a heavy term's rows first meet by document: each task packs
those of a (term, document) into one row of (portion, count) pairs before that shuffle, and behind it counts them in
exact local arrays, of which only the sums go on. The remaining terms are shuffled once by term. Both tables are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.session import blank

_COLS = ["value", "grp", "doc", "portion", "count"]


def counting_rows(df: DataFrame) -> DataFrame:
    """The rows that count: value not null or blank, count at least 1. A null folder, document or portion is one of its own."""
    return df.select(*_COLS).filter(~blank(F.col("value")) & (F.col("count") >= 1))


def heavy_terms(df: DataFrame, tracked: int = 65_536, share: float | None = None) -> list[str]:
    """The terms of `df` whose share of the rows is `share` or more, by a sketch of `tracked` counters over all rows. By
    default a term is heavy if its rows fill half an average task of the shuffle, or 0.2 % of the table if that is less;
    so there are at most 500, or twice as many heavy terms as shuffle partitions, and every light term fits into a task
    with others.

    Which terms are taken for heavy changes where they are counted, never what is counted.
    """
    tasks = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = min(0.002, 0.5 / tasks) if share is None else share
    k = min(10_000, int(1 / share) + 1)
    row = df.select(F.expr(f"approx_top_k(value, {k}, {max(tracked, 4 * k)})").alias("top"), F.count("*").alias("n")).first()
    return [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] >= max(2, share * row["n"])]


def _pack(terms: list[str]):
    """(at, grp, doc, cells): the distinct (portion, count) of each heavy term and document in a task, the term by its
    number; handed on after every 100,000 pairs, so a task holds no more."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, set] = {}
        size = 0
        for b in batches:
            for value, grp, doc, portion, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cell = seen.setdefault((number[value], grp, doc), set())
                size -= len(cell)
                cell.add((portion, count))
                size += len(cell)
            if size > 100_000:
                yield _packed(seen)
                seen.clear()
                size = 0
        yield _packed(seen)

    return run


def _packed(seen: dict[tuple, set]) -> pa.RecordBatch:
    keys = list(seen)
    pair = pa.struct([("portion", pa.int64()), ("count", pa.int64())])
    return pa.RecordBatch.from_pydict(
        {
            "at": pa.array([k[0] for k in keys], pa.int32()),
            "grp": pa.array([k[1] for k in keys], pa.string()),
            "doc": pa.array([k[2] for k in keys], pa.string()),
            "cells": pa.array([[{"portion": p, "count": c} for p, c in seen[k]] for k in keys], pa.list_(pair)),
        }
    )


def _local_counts(terms: list[str]):
    """Counts of each heavy term among a task's (term, document) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = (np.zeros(len(terms), dtype=np.int64) for _ in range(2))
        for b in batches:
            at = b.column("at").to_numpy()
            np.add.at(total, at, b.column("total").to_numpy())  # integers: exact at every size
            docs += np.bincount(at, minlength=len(terms))
        seen = np.flatnonzero(docs)
        yield pa.RecordBatch.from_pydict({"value": pa.array([terms[i] for i in seen], pa.string()), "total": pa.array(total[seen], pa.int64()), "docs": pa.array(docs[seen], pa.int64())})

    return run


def term_counts(df: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """(value, total, docs): the sum of `count` and the number of documents (grp, doc) of each value.

    `df` has the columns value, grp, doc, portion, count; rows equal in all five were delivered again and count once;
    other columns are ignored. Values are taken exactly as stored. An empty table gives no row. `heavy`: the terms to
    count in place, by default those `heavy_terms` finds.
    """
    rows = counting_rows(df)
    heavy = heavy_terms(rows) if heavy is None else heavy
    light = rows
    tables = []
    if heavy:
        is_heavy = F.col("value").isin(heavy)
        light = rows.filter(~is_heavy)
        packed = rows.filter(is_heavy).select("value", *(F.col(c).cast("string").alias(c) for c in ("grp", "doc")), *(F.col(c).cast("long").alias(c) for c in ("portion", "count"))).mapInArrow(_pack(heavy), "at int, grp string, doc string, cells array<struct<portion:long,count:long>>")
        # one shuffle, by term and document; the steps after it keep that partitioning
        per_doc = (
            packed.repartition("at", "grp", "doc")
            .select("at", "grp", "doc", F.explode("cells").alias("c"))
            .groupBy("at", "grp", "doc", "c.portion", "c.count")
            .agg(F.lit(1).alias("one"))
            .groupBy("at", "grp", "doc")
            .agg(F.sum("count").alias("total"))
            .select("at", "total")
        )
        tables.append(per_doc.mapInArrow(_local_counts(heavy), "value string, total long, docs long").groupBy("value").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")))
    # the light terms: one shuffle, by term; the steps after it keep that partitioning
    tables.append(
        light.repartition("value")
        .groupBy(*_COLS)
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "grp", "doc")
        .agg(F.sum(F.col("count").cast("long")).alias("total"))
        .groupBy("value")
        .agg(F.sum("total").alias("total"), F.count("*").alias("docs"))
    )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def document_total(df: DataFrame) -> DataFrame:
    """One row, `n_docs`: the documents (grp, doc) with a counting row."""
    return counting_rows(df).select("grp", "doc").distinct().agg(F.count("*").alias("n_docs"))


def term_bands(df: DataFrame, rare_at_most: int = 2, common_above: float = 0.5) -> DataFrame:
    """(value, total, docs, n_docs, bands): `term_counts` with an array of marks, `rare` for a total of at most
    `rare_at_most` and `common` for a share of documents above `common_above`. In a tiny collection a value can be both."""
    n = F.broadcast(document_total(df))  # one row
    marks = F.array_compact(F.array(F.when(F.col("total") <= rare_at_most, F.lit("rare")), F.when(F.col("docs") > common_above * F.col("n_docs"), F.lit("common"))))
    return term_counts(df).join(n).withColumn("bands", marks)
