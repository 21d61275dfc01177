"""Tokenizers: the main one, over Arrow batches, and the simple one, as JVM expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lingmill.functions import scan
from lingmill.functions.chars import DOTS, WHITE, upper
from lingmill.functions.urls import UrlRules

LETTER_EDGES = "^[^\\p{L}]+|[^\\p{L}]+$"


def tokens(text: Column, rules: UrlRules | None = None) -> Column:
    """Words of a text, in order; URLs (by `rules`) are no words. Null gives null, a wordless text an empty array."""

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield scan.word_lists(a, rules)

    return words(text)


def simple_tokens(text: Column) -> Column:
    """The simple tokenizer: control characters are spaces; terms are trimmed to letters and upper-cased. A term of
    which trimming leaves one character or none is kept as null."""
    terms = F.filter(F.split(F.regexp_replace(text, "[\\x{00}-\\x{1E}]", " "), f"[{WHITE}]+"), lambda x: x != "")
    return F.transform(terms, normalize_term)


def normalize_term(term: Column) -> Column:
    w = F.regexp_replace(term, LETTER_EDGES, "")
    return F.when((w == term) | (F.length(w) > 1), upper(w))


def is_dot(c: Column) -> Column:
    return c.isin(*DOTS)
