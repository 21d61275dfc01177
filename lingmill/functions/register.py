"""SQL functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lingmill.functions.scan import word_lists
from lingmill.functions.urls import UrlRules, find_urls
from lingmill.operators.detect import LocalDetector


def register(spark: SparkSession, rules: UrlRules | None = None, detector: LocalDetector | None = None) -> None:
    """Functions `tokenize(text)`, `url_spans(text)`, and, with a detector, `detect_language(text)`; table functions
    `words(text)` and `extract_urls(text)`."""
    rules = rules or UrlRules.default(spark)

    @F.arrow_udf("array<string>")
    def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield word_lists(a, rules)

    @F.pandas_udf("array<struct<start:int,length:int,value:string>>")
    def url_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [(a, b - a, t[a:b]) for a, b in find_urls(t, rules)] for t in s], dtype=object)

    @F.udtf(returnType="pos int, term string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(word_lists(pa.array([text]), rules)[0].as_py() or [])

    @F.udtf(returnType="start int, length int, value string")
    class Urls:
        def eval(self, text: str):
            if text is not None:
                yield from ((a, b - a, text[a:b]) for a, b in find_urls(text, rules))

    spark.udf.register("tokenize", tokenize)
    spark.udf.register("url_spans", url_spans)
    spark.udtf.register("words", Words)
    spark.udtf.register("extract_urls", Urls)
    if detector is not None:
        spark.udf.register("detect_language", detector.sql_function(rules))
