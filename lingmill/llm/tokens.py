"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's path is a parameter; it is read on each executor."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenization pattern that belongs to this byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the pattern's engine knows it; it gives up on very long runs of it.
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer, made once for each Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: str, enc, run: int = 1_000) -> int:
    """Tokens of a text, exactly as the tokenizer counts the whole of it.

    The pattern makes one piece of all but the last character of a run of white space, or of the whole run at the end of
    a text, and every piece before the run ends there. So a run of `run` characters or more is taken out as that piece,
    and what stands before and after it is counted for itself, with the same result at any `run`."""
    total = at = 0
    for m in re.finditer(f"{_SPACES}{{{run},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if end > m.start():
            total += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
            at = end
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens; null for a null text, 0 for an empty one."""

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([None if t is None else count_tokens(t, enc) for t in s], dtype="Int64")

    return f(text)
