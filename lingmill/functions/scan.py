"""The main tokenizer over whole batches of texts, as array operations on their characters; and hashes of n-grams.

Characters other than white space, separators (punctuation and some symbols) and URLs form runs. After a separator all
punctuation and white space is passed over. A run of digits and number signs before another such character is no word
(except before a separator); any other run is trimmed to letters and digits, and is a word unless trimming leaves it with
one character or none. Words are upper-cased letter by letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lingmill.functions.chars import IN_WORD, SEPARATING_SYMBOLS, upper_py
from lingmill.functions.urls import UrlRules, find_urls, is_letter, is_punctuation, is_white

#: Characters of a number besides digits.
NUMBER_PARTS = ";,:./\\- –〃´°"
#: Texts are worked on in groups of about so many characters, so the arrays stay in the processor's cache.
GROUP = 300_000

_CORE, _WHITE, _PUNCT, _SEPARATOR, _NUMBER, _END = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(classes, upper case) of the characters of the basic multilingual plane; the last entry stands for all others."""
    kinds, upper = np.zeros(0x10001, dtype=np.uint8), np.arange(0x10001, dtype=np.uint32)
    for code in range(0x10000):
        c = chr(code)
        k = 0
        digit = unicodedata.category(c) == "Nd"
        if is_letter(c) or digit:
            k |= _CORE
        if is_white(c):
            k |= _WHITE
        if is_punctuation(c):
            k |= _PUNCT
        if (k & _PUNCT and c not in IN_WORD) or c in SEPARATING_SYMBOLS:
            k |= _SEPARATOR
        if digit or c in NUMBER_PARTS:
            k |= _NUMBER
        kinds[code] = k
        upper[code] = ord(upper_py(c))
    kinds[0] = _END
    return kinds, upper


@dataclass
class Words:
    """The words of some texts: UTF-8 `data`, `offsets` of each word in it, and how many words each text has."""

    data: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray


def scan(texts: list[str], rules: UrlRules | None) -> Words:
    """The words of texts, in order. A text ends at its first NUL; URLs (by `rules`) are no words."""
    kinds, upper = _tables()
    texts = [t[: t.index("\0")] if "\0" in t else t for t in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    plane = np.minimum(codes, 0x10000)
    kind = kinds[plane]
    hidden = None
    if rules is not None:
        hits = [(int(b) + s, int(b) + e) for b, t in zip(begins, texts, strict=False) for s, e in find_urls(t, rules)]
        if hits:
            hidden = np.zeros(n + 1, dtype=np.int32)
            np.add.at(hidden, [s for s, _ in hits], 1)
            np.add.at(hidden, [e for _, e in hits], -1)
            hidden = np.cumsum(hidden[:-1]) > 0
    passed = (kind & (_WHITE | _PUNCT | _SEPARATOR)) != 0
    separator = (kind & _SEPARATOR) != 0
    if hidden is not None:
        passed &= ~hidden
        separator &= ~hidden
    # passed over: behind a separator, with nothing but white space and punctuation between
    place = np.arange(n, dtype=np.int32)
    outside = (kind & (_WHITE | _END)) != 0
    outside |= passed & (np.maximum.accumulate(np.where(separator, place, -1)) > np.maximum.accumulate(np.where(passed, -1, place)))
    if hidden is not None:
        outside |= hidden
    edge = np.diff(outside.view(np.int8), prepend=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # each run and the character behind it
    last = last[: len(first)] if not len(last) or not len(first) or last[0] > first[0] else last[1:]
    # numbers
    number = (kind & _NUMBER) != 0
    numbers = np.concatenate([[0], np.cumsum(number, dtype=np.int32)])
    keep = separator[last] | ~number[last] | (numbers[last] - numbers[first] < last - first)
    # trimming
    core = np.flatnonzero(kind & _CORE)
    a, b = np.searchsorted(core, first), np.searchsorted(core, last) - 1
    keep &= b >= a
    first, last, a, b = first[keep], last[keep], a[keep], b[keep]
    start, end = core[a], core[b] + 1
    keep = ((start == first) & (end == last)) | (end - start > 1)
    start, end = start[keep], end[keep]
    # the words' characters, one after the other
    sizes = end - start
    steps = np.zeros(n + 1, dtype=np.int8)
    steps[start] = 1
    steps[end] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
    chars = codes[inside]
    small = plane[inside]
    chars = np.where(small < 0x10000, upper[small], chars)
    data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) == len(chars):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    else:
        bytes_of = np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)
        offsets = np.concatenate([[0], bytes_of[np.cumsum(sizes) - 1]]) if len(sizes) else np.zeros(1, dtype=np.int64)
    counts = np.diff(np.searchsorted(start, begins))
    return Words(data, offsets, counts)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, about `GROUP` characters or one longer text each."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > GROUP:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def word_lists(texts: pa.Array, rules: UrlRules | None) -> pa.Array:
    """The words of each text as an Arrow list; null for a null text."""
    valid = [t for t in texts.to_pylist() if t is not None]
    values, counts = [], [np.zeros(0, dtype=np.int64)]
    for part in groups(valid):
        w = scan(part, rules)
        values.append(pa.StringArray.from_buffers(len(w.offsets) - 1, pa.py_buffer(w.offsets.astype(np.int32)), pa.py_buffer(w.data)))
        counts.append(w.counts)
    size = np.zeros(len(texts), dtype=np.int64)
    here = np.asarray(texts.is_valid())
    size[here] = np.concatenate(counts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    words = pa.concat_arrays(values) if values else pa.array([], pa.string())
    return pa.ListArray.from_arrays(offsets, words, mask=pa.array(~here) if not here.all() else None)


# n-gram hashes: polynomials of the bytes modulo 2^64 by two odd bases, from which a key of 64 bits and a check of 32 are
# mixed. Equal keys and checks of different n-grams are as good as impossible (one in 2^96 pairs).
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        size = max(n, 1 << 16) * 5 // 4
        for base in _BASES:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            both = []
            for x in (base, inverse):
                p = np.full(size, x, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _powers.append((both[0], both[1]))
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The two polynomials of each string."""
    powers = _power_tables(len(data) + 2)
    out = []
    for p, inverse in powers:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * p[: len(data)], out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]])
    return out


def pair_hashes(one: list[np.ndarray], two: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """The polynomials of `a b` from those of a (`sizes` bytes long) and b."""
    powers = _power_tables(int(sizes.max(initial=0)) + 2)
    return [a + np.uint64(33) * p[sizes] + b * p[sizes + 1] for (p, _), a, b in zip(powers, one, two, strict=True)]


def keys(h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of polynomials."""
    return _mix(h[0]), (_mix(h[1]) >> np.uint64(32)).astype(np.uint32)


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow string array; a null is empty."""
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]
