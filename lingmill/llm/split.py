"""Problem 1: splitting oversized texts at natural boundaries.

Method: lexical-cohesion segmentation. A text is seen as a row of units (sentences, lines). At each gap between units
the word counts of the block of units before and after it are compared by cosine; valleys of that curve mark topic
boundaries. Within the window in which a piece may end, the gap with the deepest valley is the cut. The next piece
starts `overlap` characters before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of units, the strongest first: blank line, line end, sentence end.
_UNIT_END = re.compile(r"\n+|(?<=[.!?…。])[^\S\n]+")
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s")
#: Characters that belong to the character before them.
_JOINED = re.compile("[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")


def cohesion_depths(units: list[list[str]], block: int) -> np.ndarray:
    """The valley depth at each inner gap (between unit i and i+1) of `units`, each a list of words."""
    n = len(units)
    if n < 2:
        return np.zeros(0)
    ids: dict[str, int] = {}
    rows, cols = [], []
    for i, words in enumerate(units):
        for w in words:
            rows.append(i)
            cols.append(ids.setdefault(w, len(ids)))
    counts = np.zeros((n + 1, max(1, len(ids))), dtype=np.float32)
    np.add.at(counts, (np.asarray(rows, dtype=np.int64) + 1, np.asarray(cols, dtype=np.int64)), 1) if rows else None
    total = counts.cumsum(axis=0)
    gap = np.arange(1, n)
    left = total[gap] - total[np.maximum(gap - block, 0)]
    right = total[np.minimum(gap + block, n)] - total[gap]
    norm = np.sqrt((left**2).sum(axis=1) * (right**2).sum(axis=1))
    sim = np.divide((left * right).sum(axis=1), norm, out=np.zeros(n - 1, dtype=np.float32), where=norm > 0)
    # the peak on either side of a gap: climb while the curve rises
    peak_l, peak_r = sim.copy(), sim.copy()
    for i in range(1, n - 1):
        if sim[i - 1] >= sim[i]:
            peak_l[i] = peak_l[i - 1]
    for i in range(n - 3, -1, -1):
        if sim[i + 1] >= sim[i]:
            peak_r[i] = peak_r[i + 1]
    return (peak_l - sim) + (peak_r - sim)


def _hard_cut(text: str, low: int, high: int) -> int:
    """Without a natural boundary in (low, high]: after the last white space, else at `high`, not before a joined character."""
    for i in range(high, low, -1):
        if _SPACE.match(text[i - 1]):
            return i
    cut = high
    while cut > low + 1 and cut < len(text) and _JOINED.match(text[cut]):
        cut -= 1
    return cut


def cut_text(text: str, limit: int, overlap: int, block: int = 6) -> list[tuple[int, int]]:
    """(start, end) of each piece. Every piece has at most `limit` characters, each but the first starts exactly
    `overlap` characters before the end of the one before, and together they cover the whole text."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = np.asarray([m.end() for m in _UNIT_END.finditer(text)], dtype=np.int64)
    out, start, body = [], 0, 0
    while len(text) - start > limit:
        high = start + limit
        low = max(start + limit // 2, body + 1)
        # units of this window and of a block's width beyond it
        a, b = np.searchsorted(ends, body, side="right"), np.searchsorted(ends, high, side="right")
        inside = ends[a:b]
        fit = np.flatnonzero(inside >= low)
        if len(fit):
            after = ends[b : b + block]
            bounds = sorted({body, *inside.tolist(), *after.tolist(), *([len(text)] if b + block >= len(ends) else [])})
            units = [_WORD.findall(text[i:j].lower()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            depth = cohesion_depths(units, block)[: len(inside)]
            depth = np.pad(depth, (0, len(inside) - len(depth)))[fit]
            best = fit[len(depth) - 1 - int(np.argmax(depth[::-1]))]  # of equal depths the last
            cut = int(inside[best])
        else:
            cut = _hard_cut(text, low, high)
        out.append((start, cut))
        body, start = cut, cut - overlap
    return [*out, (start, len(text))]


def split_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4000, overlap: int = 200, block: int = 6) -> DataFrame:
    """One row per piece: (id, piece_no from 0, n_pieces, start, end, piece); offsets count code points.

    A text of at most `limit` characters is its only piece (also the empty text); a null text has none. Repeated rows
    are split each on its own; other columns are ignored. Piece 0 followed by each later piece without its first
    `overlap` characters is the text. Only oversized texts pass through Python; one row is one unit of work, so hot
    sources or repeated texts need no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be from 0 to less than half the limit")

    @F.pandas_udf("array<struct<start:int,end:int,piece:string>>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([None if t is None else [(i, j, t[i:j]) for i, j in cut_text(t, limit, overlap, block)] for t in s], dtype=object)

    long = F.length("text") > limit
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("piece")))
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .filter(F.col("text").isNotNull())
        .withColumn("cuts", pieces(F.when(long, F.col("text"))))
        .select("id", F.coalesce("cuts", one).alias("cuts"))
        .select("id", F.size("cuts").alias("n_pieces"), F.posexplode("cuts").alias("piece_no", "c"))
        .select(F.col("id").alias(id_col), "piece_no", "n_pieces", "c.start", "c.end", "c.piece")
    )
