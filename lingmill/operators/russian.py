"""Russian-only detection: a Cyrillic gate, then the share of known 1- and 2-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.config import RussianConfig
from lingmill.functions.chars import is_blank
from lingmill.functions.cyrillic import cyrillic_percent, has_cyrillic_letters
from lingmill.functions.ngrams import ngrams


def russian_vocabulary(model: DataFrame) -> DataFrame:
    """The distinct n-grams of a model, whatever their weights."""
    return model.select("ngram").distinct()


def ratio(docs: DataFrame, vocabulary: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """(id, weight): known 1- and 2-grams by the number of terms less one; 0 with fewer than two terms. It can exceed 1."""
    t = F.col(tokens_col)
    grams = docs.select(F.col(id_col).alias("id"), F.size(t).alias("terms"), F.explode_outer(F.concat(t, ngrams(t, 2))).alias("ngram"))
    hit = grams.join(vocabulary.select("ngram", F.lit(1).alias("hit")), "ngram", "left")
    out = hit.groupBy("id").agg(F.first("terms").alias("terms"), F.sum("hit").alias("hits"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("terms") > 1, F.coalesce("hits", F.lit(0)) / (F.col("terms") - 1)).otherwise(0.0).alias("weight"))


def detect_ru(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str = "text", tokens_col: str = "tokens", config: RussianConfig | None = None) -> DataFrame:
    """(id, gate, cyrillic_percent, weight, is_russian). Null for a blank text in the last two; only texts that pass the
    gate are weighed (others weigh 0)."""
    c = config or RussianConfig()
    gate = F.when(~is_blank(F.col(text_col)), has_cyrillic_letters(F.col(text_col), c.cyrillic_percent))
    rows = docs.withColumn("gate", gate)
    weighed = ratio(rows.filter("gate"), vocabulary, id_col, tokens_col)
    out = rows.select(id_col, "gate", cyrillic_percent(F.col(text_col)).alias("cyrillic_percent")).join(weighed, id_col, "left")
    weight = F.when(F.col("gate").isNotNull(), F.coalesce("weight", F.lit(0.0)))
    return out.select(id_col, "gate", "cyrillic_percent", weight.alias("weight"), ((weight >= c.threshold) & (weight != 0)).alias("is_russian"))
