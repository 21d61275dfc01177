"""Language detection: 1- and 2-grams of each text against a model, thresholds, ranked languages.

Two physical forms with the same result. The local form looks hashes of n-grams up in arrays that every executor fetches
once as a file, batch by batch and without a shuffle, also on streams and as SQL function; it holds any model whose arrays
stay below a checked size, that of 19 languages with 6.6 million n-grams included. Larger models are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingmill.config import DetectorConfig
from lingmill.functions import scan
from lingmill.functions.urls import UrlRules
from lingmill.operators import joined
from lingmill.operators.model import merged
from lingmill.session import cut_lineage, filesystem, shared_folder

#: A model whose arrays take at most so many bytes in each Python worker is looked up locally, a larger one is joined.
LOCAL_BYTES = 512 * 1024 * 1024
_ROW_BYTES = 8 + 8 + 4 + 4 + 2 + 4
_CELLS = "array<struct<lang:string,weight_sum:double,hits:long>>"


#: How a text's (sum of weights, hits, terms) in a language make its weight; any other rule can be given.
Weigh = Callable[[Column, Column, Column], Column]


def by_hits(weight_sum: Column, hits: Column, terms: Column) -> Column:
    """Sum of weights x hits / terms."""
    return weight_sum * hits / terms


@dataclass
class LocalModel:
    """Rows of a model in the order of their n-grams' keys, and where the rows of each range of keys begin."""

    key: np.ndarray
    check: np.ndarray
    lang: np.ndarray
    hits: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    shift: np.uint64

    @classmethod
    def of_rows(cls, key: np.ndarray, check: np.ndarray, lang: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> LocalModel:
        order = np.argsort(key, kind="stable")
        key = key[order]
        bits = max(1, min(24, int(len(key)).bit_length()))
        shift = np.uint64(64 - bits)
        begin = np.concatenate([[0], np.cumsum(np.bincount((key >> shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)
        return cls(key, check[order].astype(np.uint32), lang[order].astype(np.int16), hits[order].astype(np.int32), weight[order].astype(np.float64), begin, shift)

    _ARRAYS = (("key", "<u8"), ("weight", "<f8"), ("check", "<u4"), ("hits", "<i4"), ("begin", "<i4"), ("lang", "<i2"))

    def parts(self) -> Iterator[bytes]:
        """The file of a model: its numbers of rows and of bits, and the arrays, the widest first."""
        yield np.array([len(self.key), 64 - int(self.shift)], dtype="<i8").tobytes()
        for name, kind in self._ARRAYS:
            yield np.ascontiguousarray(getattr(self, name).astype(kind, copy=False)).tobytes()

    @classmethod
    def load(cls, path: str | None) -> LocalModel:
        """A model from its file, of which every worker of a machine maps the same memory; without a file an empty one."""
        if path is None:
            none = np.zeros(0, dtype=np.int64)
            return cls.of_rows(none.view(np.uint64), none, none, none, none)
        n, bits = np.fromfile(path, dtype="<i8", count=2).tolist()
        arrays, at = {}, 16
        for name, kind in cls._ARRAYS:
            size = (1 << bits) + 1 if name == "begin" else n
            arrays[name] = np.asarray(np.memmap(path, dtype=kind, mode="r", offset=at, shape=(size,)))
            at += size * np.dtype(kind).itemsize
        return cls(shift=np.uint64(64 - bits), **arrays)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every row of the model with the key and check of a query."""
        part = (key >> self.shift).astype(np.int64)
        row, stop = self.begin[part], self.begin[part + 1]
        query = np.flatnonzero(row < stop)
        row, stop = row[query], stop[query]
        queries, rows = [], []
        while len(query):
            hit = (self.key[row] == key[query]) & (self.check[row] == check[query])
            queries.append(query[hit])
            rows.append(row[hit])
            row = row + 1
            more = row < stop
            query, row, stop = query[more], row[more], stop[more]
        return (np.concatenate(queries), np.concatenate(rows)) if queries else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def score(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(detected words of each text, weights and hits by text and language) of texts given as words."""
        n, texts = len(offsets) - 1, len(counts)
        text = np.repeat(np.arange(texts), counts)
        one = scan.hashes(data, offsets)
        second = np.flatnonzero(text[1:] == text[:-1]) + 1 if n else np.zeros(0, np.int64)  # words with one before them
        two = scan.pair_hashes([h[second - 1] for h in one], [h[second] for h in one], np.diff(offsets)[second - 1])
        found = np.zeros(n, dtype=bool)
        cells, rows = [], []
        for h, word in ((one, np.arange(n)), (two, second)):
            q, r = self.find(*scan.keys(h))
            found[word[q]] = True
            cells.append(text[word[q]] * n_langs + self.lang[r])
            rows.append(r)
        cell, row = np.concatenate(cells), np.concatenate(rows)
        size = texts * n_langs
        weights = np.bincount(cell, weights=self.weight[row], minlength=size)
        hits = np.bincount(cell, weights=self.hits[row], minlength=size).astype(np.int64)
        return np.bincount(text[found], minlength=texts), weights.reshape(texts, n_langs), hits.reshape(texts, n_langs)


_loaded: dict[str | None, LocalModel] = {}


def _local(file: str | None) -> LocalModel:
    """The model of a file that Spark has handed to this executor; a worker keeps two open."""
    if file not in _loaded:
        while len(_loaded) > 1:
            _loaded.pop(next(iter(_loaded)))
        _loaded[file] = LocalModel.load(SparkFiles.get(file) if file else None)
    return _loaded[file]


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, check = scan.keys(scan.hashes(*scan.strings(b.column("ngram"))))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.astype(np.int64)), b.column("lang"), b.column("hits"), b.column("weight")], ["key", "check", "lang", "hits", "weight"])


class ModelTooLarge(ValueError):
    """A model whose arrays would take more than the bound."""


class LocalDetector:
    """A model as a file on the executors, for detection row by row.

    Making one runs jobs: the model is merged and counted, and if its arrays take at most `max_bytes` (a larger one is an
    error), the driver gets the hashed rows, writes them in order to the shared checkpoint folder, and has Spark hand that
    file to the executors, which map it into memory once for all their workers."""

    def __init__(self, model: DataFrame, config: DetectorConfig | None = None, max_bytes: int = LOCAL_BYTES, merged_model: DataFrame | None = None):
        cells = merged_model if merged_model is not None else cut_lineage(merged(model))
        rows = cells.count()
        if rows * _ROW_BYTES > max_bytes:
            raise ModelTooLarge(f"a model of {rows} rows takes more than {max_bytes} bytes; use the joining form")
        spark = cells.sparkSession
        self.langs = sorted(r["lang"] for r in cells.select("lang").distinct().limit(32_768).collect())
        if len(self.langs) > 32_767:
            raise ValueError("more than 32,767 languages")
        self.config = config or DetectorConfig()
        self.file: str | None = None
        if rows:
            number = F.element_at(F.create_map(*(x for i, c in enumerate(self.langs) for x in (F.lit(c), F.lit(i)))), F.col("lang"))
            t = cells.select("ngram", number.alias("lang"), F.col("hits").cast("int").alias("hits"), "weight").mapInArrow(_hash_rows, "key long, check long, lang int, hits int, weight double").toArrow()
            packed = LocalModel.of_rows(t["key"].to_numpy().view(np.uint64), *(t[c].to_numpy() for c in ("check", "lang", "hits", "weight")))
            path = f"{shared_folder(spark, 'local-model')}.bin"
            fs, at = filesystem(spark, path)
            out = fs.create(at)
            for part in packed.parts():
                for i in range(0, len(part), 1 << 24):
                    out.write(bytearray(part[i : i + (1 << 24)]))
            out.close()
            spark.sparkContext.addFile(path)
            self.file = path.rsplit("/", 1)[1]

    def scored(self, tokens: Column) -> Column:
        """(terms, detected, x) of a token array, x the (lang, weight_sum, hits) of each language."""
        file, langs = self.file, self.langs
        names = pa.array([*langs], pa.string())

        @F.arrow_udf(f"struct<terms:int,detected:long,x:{_CELLS}>")
        def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _local(file)
            for a in batches:
                yield pa.concat_arrays([_score(model, part, names) for part in _slices(a)]) if len(a) else _score(model, a, names)

        return f(tokens)

    def detect(self, df: DataFrame, tokens: Column, weigh: Weigh = by_hits) -> DataFrame:
        """`df` with `reason` and `langs`; no shuffle, so also on a stream in append mode."""
        rows = df.withColumn("_s", self.scored(tokens)).select("*", "_s.terms", "_s.detected", _weighed(weigh, "_s").alias("x"))
        return _decide(rows, self.config).drop("_s", "terms", "detected", "x", "total", "kept")

    def sql_function(self, rules: UrlRules | None):
        """A function text -> array<struct<lang,weight,percent>> for SQL."""
        file, langs, config = self.file, self.langs, self.config

        @F.arrow_udf("array<struct<lang:string,weight:double,percent:int>>")
        def detect_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model, names = _local(file), pa.array(langs, pa.string())
            for a in batches:
                rows = _score(model, scan.word_lists(a, rules), names).to_pylist()
                got = [[dict(zip(("lang", "weight", "percent"), x, strict=True)) for x in decide(r["terms"], r["detected"], [(x["lang"], x["weight_sum"], x["hits"]) for x in r["x"]], config)] for r in rows]
                yield pa.array(got, pa.list_(pa.struct([("lang", pa.string()), ("weight", pa.float64()), ("percent", pa.int32())])))

        return detect_language


def _slices(a: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of texts with some 100,000 words each, so the arrays stay small."""
    ends = np.cumsum(np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False)))
    cuts = [0, *(np.flatnonzero(np.diff(ends // 100_000)) + 1).tolist(), len(a)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield a.slice(i, j - i)


def _score(model: LocalModel, words: pa.Array, names: pa.Array) -> pa.Array:
    """The struct of `LocalDetector.scored` for an array of word lists."""
    counts = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    detected, weights, hits = model.score(*scan.strings(words.flatten()), counts, max(1, len(names)))
    text, lang = np.nonzero(hits)
    cells = pa.StructArray.from_arrays([names.take(pa.array(lang)) if len(lang) else pa.array([], pa.string()), pa.array(weights[text, lang]), pa.array(hits[text, lang])], ["lang", "weight_sum", "hits"])
    at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))])
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(detected.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), cells)], ["terms", "detected", "x"])


def scores(docs: DataFrame, model: DataFrame, id_col: str, tokens_col: str = "tokens", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(id, terms, detected, lang, weight_sum, hits): per text and matching language. `terms` counts its tokens,
    `detected` those that match alone or with the one before. Texts without a match have one row with a null `lang`.

    Each text is one row of `docs` with a unique id. The model is merged and counted by jobs that run at once.
    """
    rows = _scored(docs, model, id_col, tokens_col, local_bytes)
    out = rows.select(id_col, "terms", "detected", F.explode_outer("x").alias("c"))
    return out.select(id_col, "terms", "detected", "c.lang", "c.weight_sum", "c.hits")


def _scored(docs: DataFrame, model: DataFrame, id_col: str, tokens_col: str, local_bytes: int) -> DataFrame:
    """(id, terms, detected, x) of each text, by the form that the model's size allows."""
    cells = cut_lineage(merged(model))
    rows = cells.count()
    if rows * _ROW_BYTES <= local_bytes:
        return docs.select(id_col, LocalDetector(model, max_bytes=local_bytes, merged_model=cells).scored(F.col(tokens_col)).alias("s")).select(id_col, "s.*")
    return joined.scored(docs, cells, rows, id_col, tokens_col)


def _weighed(weigh: Weigh = by_hits, struct: str = "") -> Column:
    """The (weight, lang) of each language."""
    at = f"{struct}." if struct else ""
    return F.transform(F.col(f"{at}x"), lambda e: F.struct(weigh(e["weight_sum"], e["hits"], F.col(f"{at}terms")).alias("weight"), e["lang"].alias("lang")))


def _decide(rows: DataFrame, c: DetectorConfig) -> DataFrame:
    """`langs` and `reason` of rows (terms, detected, x), x the (weight, lang) of each language."""
    total = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["weight"])
    rows = rows.withColumn("total", total)
    graded = F.transform("x", lambda e: F.struct(e["lang"].alias("lang"), e["weight"].alias("weight"), F.floor(F.round(e["weight"] * 100 / F.col("total"), 9)).cast("int").alias("percent")))
    ordered = F.array_sort(graded, lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["lang"] < b["lang"], -1).otherwise(1))
    kept = F.filter(ordered, lambda e: (e["weight"] >= c.min_weight) & (e["percent"] >= c.min_percent))
    rows = rows.withColumn("kept", F.when(F.col("total") > 0, kept))
    close = (F.size("kept") >= 3) & (F.get(F.col("kept"), F.lit(0))["percent"] - F.get(F.col("kept"), F.lit(1))["percent"] <= c.three_language_gap) & (F.get(F.col("kept"), F.lit(1))["percent"] - F.get(F.col("kept"), F.lit(2))["percent"] <= c.three_language_gap)
    few = (F.col("terms") > c.word_count) & (F.expr("100 * detected div terms") < c.min_percent_of_words)
    reason = (
        F.when(F.coalesce(F.col("terms"), F.lit(0)) <= 0, "no terms")
        .when(few, "few detected words")
        .when(F.col("total") <= 0, "no weight")
        .when(F.size("kept") == 0, "below thresholds")
        .when(close, "three close languages")
    )
    empty = F.array().cast("array<struct<lang:string,weight:double,percent:int>>")
    return rows.withColumn("reason", reason).withColumn("langs", F.when(F.col("reason").isNull(), F.col("kept")).otherwise(empty))


def detect(docs: DataFrame, model: DataFrame, id_col: str, tokens_col: str = "tokens", config: DetectorConfig | None = None, local_bytes: int = LOCAL_BYTES, weigh: Weigh = by_hits) -> DataFrame:
    """(id, reason, langs) of texts given as token arrays: `langs` the array of (lang, weight, percent), the best first;
    empty with a `reason` otherwise: `no terms`, `few detected words`, `no weight`, `below thresholds`, `three close
    languages`. Null token arrays have no terms. `weigh` is the scoring strategy."""
    rows = _scored(docs, model, id_col, tokens_col, local_bytes).select(id_col, "terms", "detected", _weighed(weigh).alias("x"))
    return _decide(rows, config or DetectorConfig()).select(id_col, "reason", "langs")


def long_form(detected: DataFrame, id_col: str) -> DataFrame:
    """(id, rank, lang, weight, percent), rank from 1; undecided texts have no row."""
    return detected.select(id_col, F.posexplode("langs").alias("i", "x")).select(id_col, (F.col("i") + 1).alias("rank"), "x.lang", "x.weight", "x.percent")


def top(detected: DataFrame, id_col: str) -> DataFrame:
    """(id, lang, percent) of the best language; null where undecided."""
    best = F.get(F.col("langs"), F.lit(0))
    return detected.select(id_col, best["lang"].alias("lang"), best["percent"].alias("percent"))


def as_text(langs: Column) -> Column:
    """`EN, 90 %` lines, or that the language is not defined."""
    parts = F.transform(langs, lambda e: F.concat(e["lang"], F.lit(", "), e["percent"].cast("string"), F.lit(" %")))
    return F.when(F.size(langs) > 0, F.array_join(parts, "\n")).otherwise(F.lit("[text language is not defined]"))


def as_json(langs: Column, names: dict[str, str], error: Column | None = None) -> Column:
    """The service's answer: {langs:[{l,n,p}]} or {err}."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    items = F.transform(langs, lambda e: F.struct(e["lang"].alias("l"), F.element_at(table, e["lang"]).alias("n"), e["percent"].alias("p")))
    answer = F.to_json(F.struct(items.alias("langs")))
    return answer if error is None else F.when(error.isNotNull(), F.to_json(F.struct(error.alias("err")))).otherwise(answer)


def decide(terms: int, detected: int, sums: list[tuple[str, float, int]], c: DetectorConfig) -> list[tuple[str, float, int]]:
    """`_decide` for one text: the ranked (lang, weight, percent) of (lang, sum of weights, hits)."""
    if not terms or (terms > c.word_count and 100 * detected // terms < c.min_percent_of_words):
        return []
    scored = [(lang, w * h / terms) for lang, w, h in sums]
    total = sum(w for _, w in scored)
    if total <= 0:
        return []
    out = [(lang, w, int(round(w * 100 / total, 9))) for lang, w in sorted(scored, key=lambda x: (-x[1], x[0]))]
    out = [x for x in out if x[1] >= c.min_weight and x[2] >= c.min_percent]
    if len(out) >= 3 and out[0][2] - out[1][2] <= c.three_language_gap and out[1][2] - out[2][2] <= c.three_language_gap:
        return []
    return out
