"""Detection on streams: row-local, so in append mode without a watermark; and counts of languages by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.functions.tokenize import tokens
from lingmill.functions.urls import UrlRules
from lingmill.operators.detect import LocalDetector


def detect_stream(stream: DataFrame, detector: LocalDetector, rules: UrlRules | None = None, text_col: str = "text") -> DataFrame:
    """A stream with `reason` and `langs` for each row."""
    return detector.detect(stream.withColumn("_tokens", tokens(F.col(text_col), rules)), F.col("_tokens")).drop("_tokens")


def language_counts(detected: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, lang, n): texts by best language and tumbling window, late rows accepted up to `late`."""
    best = F.coalesce(F.get(F.col("langs"), F.lit(0))["lang"], F.lit("unknown"))
    out = detected.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), best.alias("lang")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "lang", "n")
