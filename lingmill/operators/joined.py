"""The joining form of detection, for models too large to be looked up in one place.

Neither texts nor model are taken apart into rows of n-grams. Texts are put together in batches; of each batch every
distinct n-gram travels once, as a hash, to the part of the model that its hash belongs to, however often it occurs there.
What that part has of it travels back to the batch, whose texts are then scored against this small model of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lingmill.functions import scan
from lingmill.session import cut_lineage

#: About so many words, texts counting as one more each, make a batch.
BATCH_WORDS = 1_000_000
#: A part of the model holds about so many rows at most.
PART_ROWS = 1_000_000
#: Occurrences of n-grams that are added up at a time.
_STEP = 1_000_000

_GRAM = np.dtype([("key", "<u8"), ("check", "<u4")])
_ROW = np.dtype([("key", "<u8"), ("check", "<u4"), ("lang", "<i4"), ("hits", "<i8"), ("weight", "<f8")])
_MOVED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("langs", pa.list_(pa.string()))])
_MOVED_SQL = "part int, batch long, blob binary, langs array<string>"
_CELLS = "array<struct<lang:string,weight_sum:double,hits:long>>"


def scored(docs: DataFrame, cells: DataFrame, rows: int, id_col: str, tokens_col: str, batch_words: int = BATCH_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, terms, detected, x) of each text, x the (lang, weight_sum, hits) of each language, by a merged model `cells` of
    so many rows. The batches are written to the shared checkpoint folder at once, since both their n-grams and their texts
    are read from there."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows))
    moved = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")).mapInArrow(_batched(parts, batch_words), _MOVED_SQL))
    model = cells.filter("ngram is not null").mapInArrow(_parted(parts), _MOVED_SQL)
    asked = model.unionByName(moved.filter("part is not null")).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("batch"))
    found = asked.mapInArrow(_look_up, _MOVED_SQL)
    met = found.unionByName(moved.filter("part is null")).repartition("batch").sortWithinPartitions("batch", F.asc_nulls_last("part"))
    out = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(f"terms int, detected long, x {_CELLS}").fields])
    return met.mapInArrow(_score, out).withColumnRenamed("id", id_col)


def _moved(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MOVED, strict=True)], schema=_MOVED)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32)


def _by_part(rows: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows) of every part that has rows."""
    part = _part(rows["key"], parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield int(part[i]), rows[order[i:j]]


def _packed(rows: np.ndarray, langs: list) -> tuple[bytes, list]:
    """Rows as bytes, with the languages that occur in them, which they number."""
    used, number = np.unique(rows["lang"], return_inverse=True)
    rows = rows.copy()
    rows["lang"] = number
    return rows.tobytes(), [langs[i] for i in used.tolist()]


def _unpacked(held: list[tuple[bytes, list]]) -> tuple[np.ndarray, list]:
    """The rows of several packages in the order of their keys, and their languages."""
    langs = sorted({x for _, names in held for x in names}, key=lambda x: (x is None, x))
    number = {x: i for i, x in enumerate(langs)}
    parts = [np.zeros(0, _ROW)]
    for blob, names in held:
        rows = np.frombuffer(blob, _ROW).copy()
        rows["lang"] = np.array([number[x] for x in names], dtype=np.int32)[rows["lang"]]
        parts.append(rows)
    rows = np.concatenate(parts)
    return rows[np.argsort(rows["key"], kind="stable")], langs


def _matches(key: np.ndarray, check: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of every row with the key and check of a query, in the order of the queries."""
    keys = np.ascontiguousarray(rows["key"])
    low = np.searchsorted(keys, key, "left")
    query, row = _spans(low, np.searchsorted(keys, key, "right") - low)
    hit = rows["check"][row] == check[query]
    return query[hit], row[hit]


def _spans(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which span, place) of all places of spans."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


def _counts(words: pa.Array) -> np.ndarray:
    return np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _grams(words: pa.DictionaryArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the hashes of the distinct 1- and 2-grams of texts, which 1-gram each word is, which 2-gram ends with it); -1: none.
    A null is no word, and no n-gram reaches over it."""
    data, offsets = scan.strings(words.dictionary)
    n = len(offsets) - 1
    one = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    second = np.flatnonzero((text[1:] == text[:-1]) & (one[1:] >= 0) & (one[:-1] >= 0)) + 1
    pairs, which = np.unique(one[second - 1] * n + one[second], return_inverse=True)
    two = np.full(len(one), -1)
    two[second] = n + which
    h = scan.hashes(data, offsets)
    a, b = (pairs // n, pairs % n) if n else (pairs, pairs)
    hp = scan.pair_hashes([x[a] for x in h], [x[b] for x in h], np.diff(offsets)[a])
    grams = np.empty(n + len(pairs), _GRAM)
    grams["key"], grams["check"] = scan.keys([np.concatenate(x) for x in zip(h, hp, strict=True)])
    return grams, one, two


def _batched(parts: int, batch_words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (ids, tokens) in enumerate(_batches(batches, batch_words)):
            counts = _counts(tokens)
            words = tokens.flatten().dictionary_encode()
            grams, _, _ = _grams(words, counts)
            number = (task << 32) + i
            texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), words)
            yield _moved([(p, number, g.tobytes(), None) for p, g in _by_part(grams, parts)] + [(None, number, _written(ids, texts), None)])

    return f


def _batches(batches: Iterator[pa.RecordBatch], batch_words: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, tokens) of about `batch_words` words each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(_counts(b.column("tokens")) + 1)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(b.num_rows, int(np.searchsorted(ends, before + batch_words - size)) + 1)
            held.append(b.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= batch_words:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "tokens"))


def _written(ids: pa.Array, texts: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids, texts], ["id", "tokens"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _parted(parts: int):
    """The rows of the model as packages by part; they have no batch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.empty(b.num_rows, _ROW)
            rows["key"], rows["check"] = scan.keys(scan.hashes(*scan.strings(b.column("ngram"))))
            names = b.column("lang").dictionary_encode(null_encoding="encode")
            rows["lang"] = names.indices.to_numpy()
            rows["hits"], rows["weight"] = b.column("hits").to_numpy(), b.column("weight").to_numpy()
            langs = names.dictionary.to_pylist()
            yield _moved([(p, None, *_packed(r, langs)) for p, r in _by_part(rows, parts)])

    return f


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(c)[i].as_py() for c in ("part", "batch", "blob", "langs"))


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part of the model has of the n-grams of each batch; the part's own rows come first."""
    now, held = None, []
    rows = langs = None
    for part, batch, blob, names in _rows(batches):
        if part != now:
            now, held, rows = part, [], None
        if batch is None:
            held.append((blob, names))
            continue
        if rows is None:
            rows, langs = _unpacked(held)
            held = []
        grams = np.frombuffer(blob, _GRAM)
        _, row = _matches(grams["key"], grams["check"], rows)
        if len(row):
            yield _moved([(part, batch, *_packed(rows[row], langs))])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of the texts of each batch; what the model has of its n-grams comes first."""
    now, held = None, []
    for part, batch, blob, names in _rows(batches):
        if batch != now:
            now, held = batch, []
        if part is not None:
            held.append((blob, names))
            continue
        texts = pa.ipc.open_stream(blob).read_all().combine_chunks()
        for t in texts.to_batches():
            yield pa.RecordBatch.from_arrays([t.column("id"), *_sums(t.column("tokens"), *_unpacked(held))], ["id", "terms", "detected", "x"])


def _sums(tokens: pa.Array, rows: np.ndarray, langs: list) -> list[pa.Array]:
    """(terms, detected, x) of texts."""
    counts = _counts(tokens)
    grams, one, two = _grams(tokens.flatten(), counts)
    query, row = _matches(grams["key"], grams["check"], rows)
    n = np.bincount(query, minlength=len(grams) + 1)  # the last: none
    begin = np.cumsum(n) - n
    text = np.repeat(np.arange(len(counts)), counts)
    detected = np.bincount(text[(n[one] > 0) | (n[two] > 0)], minlength=len(counts))
    gram, text = np.concatenate([one, two]), np.concatenate([text, text])
    there = np.flatnonzero(n[gram] > 0)
    size = max(1, len(langs))
    lang, weight, hits = (np.ascontiguousarray(rows[c][row]) for c in ("lang", "weight", "hits"))
    sums = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for i in range(0, len(there), _STEP):
        at = there[i : i + _STEP]
        which, place = _spans(begin[gram[at]], n[gram[at]])
        sums.append(_added(text[at[which]] * size + lang[place], weight[place], hits[place]))
    cell, weight, hits = _added(*(np.concatenate(x) for x in zip(*sums, strict=True)))
    of = np.concatenate([[0], np.cumsum(np.bincount(cell // size, minlength=len(counts)))])
    x = pa.StructArray.from_arrays([pa.array(langs, pa.string()).take(pa.array(cell % size)), pa.array(weight.astype(np.float64)), pa.array(hits.astype(np.int64))], ["lang", "weight_sum", "hits"])
    return [pa.array(counts, pa.int32()), pa.array(detected.astype(np.int64)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), x)]


def _added(cell: np.ndarray, weight: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and hits added up by cell, in the order of the cells."""
    cells, which = np.unique(cell, return_inverse=True)
    return cells, np.bincount(which, weight, len(cells)), np.bincount(which, hits, len(cells))
