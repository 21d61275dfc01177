"""N-grams of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, joined by single spaces, in order; empty if there are fewer tokens."""
    if n == 1:
        return tokens
    out = tokens
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def segments(tokens: Column, keep, gap: str = "reset") -> Column:
    """Arrays of the tokens that `keep` accepts: one array bridging what was dropped (`bridge`), or one for each stretch
    between dropped tokens (`reset`)."""
    if gap == "bridge":
        return F.array(F.filter(tokens, keep))
    if gap != "reset":
        raise ValueError("gap must be 'reset' or 'bridge'")
    text = F.array_join(F.transform(tokens, lambda t: F.when(keep(t), t).otherwise(F.lit("\u0002"))), "\u0001")
    parts = F.transform(F.split(text, "\u0002"), lambda p: F.filter(F.split(p, "\u0001"), lambda t: t != ""))
    return F.filter(parts, lambda a: F.size(a) > 0)


def previous(tokens: Column) -> Column:
    """The token before each token; null before the first."""
    return F.transform(tokens, lambda t, i: F.get(tokens, i - 1))


def explode_ngrams(df: DataFrame, keys: list[str], tokens_col: str = "tokens", orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(keys..., n, ngram): one row per occurrence."""
    arrays = F.array(*(F.struct(F.lit(n).cast("tinyint").alias("n"), ngrams(F.col(tokens_col), n).alias("g")) for n in orders))
    return df.select(*keys, F.explode(arrays).alias("o")).select(*keys, F.col("o.n").alias("n"), F.explode("o.g").alias("ngram"))
