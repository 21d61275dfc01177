"""Models as DataFrames: long form (ngram, lang, weight), a multiset of rows; nested form (ngram, langs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.functions.chars import upper


def from_long(df: DataFrame, ngram_col: str, lang_col: str, weight_col: str) -> DataFrame:
    """A model from any table of n-grams, languages and weights. N-grams are upper-cased as tokens are; rows without an
    n-gram, a language or a weight are left out; equal rows stay as often as they are there."""
    out = df.select(upper(F.trim(F.col(ngram_col))).alias("ngram"), F.col(lang_col).alias("lang"), F.col(weight_col).cast("double").alias("weight"))
    return out.filter("ngram is not null and ngram <> '' and lang is not null and weight is not null")


def union(*models: DataFrame) -> DataFrame:
    """Several models as one: rows are appended, the same n-gram and language twice counts twice."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out


def nested(model: DataFrame) -> DataFrame:
    """(ngram, langs): one row per n-gram with its (lang, weight) pairs, sorted. An n-gram has few languages."""
    return model.groupBy("ngram").agg(F.sort_array(F.collect_list(F.struct("lang", "weight"))).alias("langs"))


def unnested(model: DataFrame) -> DataFrame:
    return model.select("ngram", F.explode("langs").alias("x")).select("ngram", "x.lang", "x.weight")


def record_count(model: DataFrame) -> DataFrame:
    """One row, `n`: distinct n-grams."""
    return model.select("ngram").distinct().agg(F.count("*").alias("n"))


def merged(model: DataFrame) -> DataFrame:
    """(ngram, lang, weight, hits): equal n-grams of a language summed; `hits` rows of it count as so many matches."""
    return model.groupBy("ngram", "lang").agg(F.sum("weight").alias("weight"), F.count("*").alias("hits"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ngram, only_in, pairs): where two models differ. `only_in` is `first` or `second` for an n-gram that the other
    lacks, `both` for one whose multisets of (lang, weight) differ; no row means equal models."""
    joined = nested(a).withColumnRenamed("langs", "x").join(nested(b).withColumnRenamed("langs", "y"), "ngram", "full_outer")
    where = F.when(F.col("y").isNull(), "first").when(F.col("x").isNull(), "second").when(F.col("x") != F.col("y"), "both")
    pairs = F.size(F.coalesce("x", F.array().cast("array<struct<lang:string,weight:double>>"))) - F.size(F.coalesce("y", F.array().cast("array<struct<lang:string,weight:double>>")))
    return joined.select("ngram", where.alias("only_in"), pairs.alias("pairs")).filter("only_in is not null")


def vocabulary(model: DataFrame) -> DataFrame:
    return model.select("ngram").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return vocabulary(a).intersect(vocabulary(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return vocabulary(a).exceptAll(vocabulary(b))


def occurring(model: DataFrame, ngrams: DataFrame) -> DataFrame:
    """The part of a model whose n-grams occur in a table with the column `ngram`."""
    return model.join(ngrams.select("ngram").distinct(), "ngram", "left_semi")
