"""Problem 7: how distinctive a term is per record.

Method: smoothed language-model divergence. A record's distribution over terms is smoothed with the collection's
(Dirichlet prior of mass mu); a term's score is its contribution to the relative entropy between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_scores(df: DataFrame, record_col: str, term_col: str, weight_col: str, mu_share: float = 0.1, min_df: int = 2) -> DataFrame:
    """(record, term, weight, n_records, score) for each term of each record.

    `weight` is summed over all rows of the term in the record, repeated rows included; null, NaN and negative weights
    count as 0. Rows without a record or a term are left out. The documents of the collection are the rows: a term that
    stands in fewer than `min_df` of them is too rare to be judged and scores 0, as does a record whose weights are all
    0. (A term in several rows of one record only is not cut off: it is what marks that record.) mu is `mu_share` times the mean mass of a record. A term that all records
    share in proportion scores about 0, one that a record has to itself scores by its mass there. Other columns are
    ignored; an empty table gives no row.
    """
    w = F.col(weight_col).cast("double")
    cells = (
        df.select(F.col(record_col).alias("record"), F.col(term_col).alias("term"), F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0).alias("w"))
        .filter(F.col("record").isNotNull() & F.col("term").isNotNull())
        .groupBy("term", "record")
        .agg(F.count("*").alias("k"), F.sum("w").alias("w"))
    )
    # k is at least 1: so every use of the cells needs all their columns, and they are made and shuffled once
    cells = cells.withColumn("w", F.when(F.col("k") > 0, F.col("w")))
    terms = cells.groupBy("term").agg(F.sum("w").alias("term_w"), F.count("*").alias("n_records"), F.sum("k").alias("df"))
    records = cells.groupBy("record").agg(F.sum("w").alias("record_w"))
    whole = records.agg(F.sum("record_w").alias("all_w"), F.avg("record_w").alias("mean_w"))  # one row
    p_all = F.col("term_w") / F.col("all_w")
    mu = F.col("mean_w") * F.lit(mu_share)
    p = (F.col("w") + mu * p_all) / (F.col("record_w") + mu)
    score = F.when((F.col("df") >= min_df) & (F.col("term_w") > 0) & (F.col("record_w") > 0), p * F.ln(p / p_all)).otherwise(0.0)
    return (
        cells.join(terms, "term")
        .join(records, "record")
        .join(F.broadcast(whole))
        .select(F.col("record").alias(record_col), F.col("term").alias(term_col), F.col("w").alias("weight"), "n_records", score.alias("score"))
    )


def top_terms(scores: DataFrame, record_col: str, term_col: str, k: int = 5) -> DataFrame:
    """The `k` terms with the highest score of each record, ties by term. Each task keeps `k` rows a record before the
    shuffle, so a hot record moves no more than that."""
    order = Window.partitionBy(record_col).orderBy(F.desc("score"), F.asc(term_col))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
