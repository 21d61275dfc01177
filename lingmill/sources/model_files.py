"""Model readers and writers: text, binary, Parquet; corpora; URL resources are read in `functions.urls`.

Paths are those of any Hadoop file system for what Spark reads and writes, and URIs of any file system that pyarrow knows
for binary model parts; on a cluster they must be shared by all executors.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.functions.chars import upper
from lingmill.session import filesystem
from lingmill.sources.model_text import BLANK, parse_lines, read_lines

MAX_NGRAM = 0x2000
MAX_DOCUMENTS = 100_000


def read_model_lines(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """(lang, file_name, line_no, text, weight, reason) of every line but headers, `paths`: language to path(s) or pattern.
    All files are read in one plan. A path without a file is an error; at most 100,000 files."""
    langs: dict[str, str] = {}
    for lang, path in paths.items():
        for p in [path] if isinstance(path, str) else path:
            fs, at = filesystem(spark, p)
            found = fs.globStatus(at)
            if not found:
                raise FileNotFoundError(p)
            for f in found:
                for g in fs.listStatus(f.getPath()) if f.isDirectory() else [f]:
                    langs[re.sub("^file:/+", "file:///", g.getPath().toUri().toString())] = lang
    if not langs:
        return spark.createDataFrame([], "lang string, file_name string, line_no long, text string, weight float, reason string")
    if len(langs) > MAX_DOCUMENTS:
        raise ValueError(f"more than {MAX_DOCUMENTS} files")
    table = F.broadcast(spark.createDataFrame([(re.sub("^file:/+", "", f), lang) for f, lang in langs.items()], "_file string, lang string"))
    rows = parse_lines(read_lines(spark, [unquote(f) for f in langs])).filter("not is_header")
    known = rows.join(table, F.regexp_replace("file_name", "^file:/+", "") == F.col("_file"))
    return known.select("lang", "file_name", "line_no", "text", "weight", "reason")


def read_text_model(spark: SparkSession, paths: dict[str, str | list[str]], strict: bool = True) -> DataFrame:
    """(ngram, lang, weight) of text files. A line that doesn't parse is an error that names file, line and reason as soon
    as it is reached; without `strict`, blank lines are passed over. `model_rejects` gives broken lines as rows instead."""
    out = read_model_lines(spark, paths)
    if not strict:
        out = out.filter(~F.coalesce(F.col("reason") == BLANK, F.lit(False)))
    message = F.concat("file_name", F.lit(", line "), F.col("line_no").cast("string"), F.lit(": "), F.col("reason"))
    ngram = F.when(F.col("reason").isNotNull(), F.raise_error(message)).otherwise(upper(F.trim("text")))
    return out.select(ngram.alias("ngram"), "lang", F.col("weight").cast("double").alias("weight"))


def model_rejects(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """(lang, file_name, line_no, reason) of the lines of text files that don't parse, blank ones included."""
    return read_model_lines(spark, paths).filter("reason is not null").select("lang", "file_name", "line_no", "reason")


def write_text_model(model: DataFrame, path: str, order: int = 2, cut: int = 1, rows_per_file: int = 5_000_000, encoding: str = "UTF-8") -> list[str]:
    """Text files `path`/group/name of (grp, doc, ngram, weight), and their paths. Each begins with its header and is named
    after its document, order and cut; a document of more than `rows_per_file` rows is spread over several files, numbered
    from 2, each with the header, so no task writes a hot document alone. Zero weights are left out. At most 100,000
    documents."""
    spark = model.sparkSession
    body = model.filter("weight <> 0")
    docs = body.groupBy("grp", "doc").agg(F.count("*").alias("n")).limit(MAX_DOCUMENTS + 1).collect()
    if len(docs) > MAX_DOCUMENTS:
        raise ValueError(f"more than {MAX_DOCUMENTS} documents")
    if not docs:
        return []
    name = f"(ngram_{order}-cut_{cut})"
    info = [(k, r["grp"], r["doc"], -(-r["n"] // rows_per_file)) for k, r in enumerate(docs)]
    table = spark.createDataFrame(info, "k int, grp string, doc string, parts int")
    same = body["grp"].eqNullSafe(table["grp"]) & body["doc"].eqNullSafe(table["doc"])
    rows = body.join(F.broadcast(table), same).select("k", F.pmod(F.xxhash64("ngram"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("row"), F.concat("ngram", F.lit("\t"), F.col("weight").cast("string")).alias("value"))
    heads = table.select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("row"), F.concat(F.lit("#\t'"), "doc", F.lit(f"' {name}")).alias("value"))
    made = f"{path}/_making-{uuid.uuid4().hex}"
    rows.unionByName(heads).repartition("k", "part").sortWithinPartitions("k", "part", "row").select("k", "part", "value").write.partitionBy("k", "part").option("encoding", encoding).text(made)
    fs, _ = filesystem(spark, made)
    out = []
    for k, grp, doc, parts in info:
        stem, ext = re.fullmatch(r"(.*?)(\.[^.]*)?", doc or "", re.S).groups()
        for part in range(parts):
            (source,) = (f.getPath() for f in fs.listStatus(filesystem(spark, f"{made}/k={k}/part={part}")[1]) if f.getPath().getName().startswith("part-"))
            target = f"{path}/{grp}/{stem}-{name}{f'-{part + 1}' if part else ''}{ext or ''}"
            at = filesystem(spark, target)[1]
            fs.mkdirs(at.getParent())
            fs.delete(at, False)
            if not fs.rename(source, at):
                raise OSError(f"can't name {target}")
            out.append(target)
    fs.delete(filesystem(spark, made)[1], True)
    return sorted(out)


def encode_record(ngram: str, langs: list[tuple[int, float]]) -> bytes:
    """One record: UTF-16LE n-gram, a zero character, the number of languages, and (language, float weight) of each."""
    raw = ngram.encode("utf-16-le")
    if len(raw) > 2 * MAX_NGRAM:
        raise ValueError(f"n-gram of more than {MAX_NGRAM} characters")
    if len(langs) > 255:
        raise ValueError(f"{ngram!r}: more than 255 languages")
    return raw + b"\0\0" + bytes([len(langs)]) + b"".join(struct.pack("<Bf", lang, w) for lang, w in langs)


def decode_records(data: bytes) -> Iterator[tuple[str, list[tuple[int, float]]]]:
    at = 0
    while at < len(data):
        end = at
        while data[end : end + 2] != b"\0\0":
            end += 2
            if end - at > 2 * MAX_NGRAM or end >= len(data):
                raise ValueError(f"broken record at byte {at}")
        n = data[end + 2]
        yield data[at:end].decode("utf-16-le"), [struct.unpack_from("<Bf", data, end + 3 + 5 * i) for i in range(n)]
        at = end + 3 + 5 * n


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """(pyarrow file system, path in it) of a path or URI."""
    uri = re.sub("^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def write_binary_model(model: DataFrame, lang_ids: dict[str, int], path: str, name: str = "model", part_bytes: int = 25_690_112) -> list[str]:
    """Binary part files of a model (ngram, lang, weight) in the shared folder `path` (a path or URI), each closed by the
    first record that takes it to `part_bytes`; their paths. Earlier files of that name are deleted. Tasks write their own
    parts, numbered by task; a part is moved to its name when it is whole, so a repeated attempt replaces it. An empty
    model is an error."""
    ids = F.create_map(*(F.lit(x) for kv in lang_ids.items() for x in kv))
    records = model.groupBy("ngram").agg(F.collect_list(F.struct(F.element_at(ids, F.col("lang")).cast("int").alias("lang"), F.col("weight").cast("float").alias("weight"))).alias("langs"))
    store, base = _place(path)
    store.create_dir(base, recursive=True)
    for f in store.get_file_info(pafs.FileSelector(base)):
        if f.base_name == f"{name}.bin" or re.fullmatch(rf"{re.escape(name)}-\d+-\d+\.bin", f.base_name):
            store.delete_file(f.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = TaskContext.get().partitionId(), []
        out, folder = _place(path)
        buffer = bytearray()

        def close() -> None:
            final = f"{folder}/{name}-{task:05d}-{len(names) + 1}.bin"
            draft = f"{final}.{uuid.uuid4().hex}.tmp"
            with out.open_output_stream(draft) as f:
                f.write(bytes(buffer))
            out.move(draft, final)
            names.append(final)
            buffer.clear()

        for b in batches:
            for ngram, langs in zip(b.column("ngram").to_pylist(), b.column("langs").to_pylist(), strict=True):
                if any(x["lang"] is None for x in langs):
                    raise ValueError(f"{ngram!r}: unknown language")
                buffer += encode_record(ngram, [(x["lang"], x["weight"]) for x in langs])
                if 0 < part_bytes <= len(buffer):
                    close()
        if buffer:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    files = sorted(r["file"] for r in records.mapInArrow(run, "file string").collect())
    if not files:
        raise ValueError("no data in the model")
    if missing := [f.path for f in store.get_file_info(files) if f.type != pafs.FileType.File]:
        raise OSError(f"{missing[0]} is not there: the folder is not shared by the executors")
    if len(files) == 1:
        store.move(files[0], f"{base}/{name}.bin")
        files = [f"{base}/{name}.bin"]
    return files


def read_binary_model(spark: SparkSession, path: str | list[str], lang_ids: dict[str, int], check: bool = True) -> DataFrame:
    """(ngram, lang, weight) of binary part files, a folder or a list of files. With `check`, an n-gram in more than one
    record is an error. A part is read as a whole; parts are made of bounded size."""
    codes = {i: c for c, i in lang_ids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows = [(g, codes[i], float(w), k) for g, langs in decode_records(data.as_buffer().to_pybytes()) for k, (i, w) in enumerate(langs)]
                yield pa.RecordBatch.from_pydict({"ngram": pa.array([r[0] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string()), "weight": pa.array([r[2] for r in rows], pa.float64()), "k": pa.array([r[3] for r in rows], pa.int32())})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("content").mapInArrow(run, "ngram string, lang string, weight double, k int")
    if check:
        twice = rows.filter("k = 0").groupBy("ngram").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['ngram']!r} is in several records")
    return rows.drop("k")


def convert_text_to_binary(spark: SparkSession, paths: dict[str, str | list[str]], lang_ids: dict[str, int], path: str, name: str = "model", part_bytes: int = 25_690_112) -> list[str]:
    """Text model files as binary ones; the paths written."""
    return write_binary_model(read_text_model(spark, paths, strict=False), lang_ids, path, name, part_bytes)


def save_model(model: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """The canonical store: Parquet, clustered by n-gram."""
    model.repartition("ngram").sortWithinPartitions("ngram").write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def corpus_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(grp, doc, bytes) of the files below `path`, the largest first; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("grp"), F.element_at(parts, -1).alias("doc"), F.col("length").alias("bytes")).orderBy(F.desc("bytes"), "grp", "doc")


def read_corpus(spark: SparkSession, path: str, encoding: str = "UTF-8", pattern: str = "*") -> DataFrame:
    """(grp, doc, line_no, text): every line of the files below `path`; a file is a document, its folder the group. Files
    are read in splits, never as a whole."""
    parts = F.split("file_name", "/")
    lines = read_lines(spark, path, encoding, True, pattern)
    name = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return lines.select(name(F.element_at(parts, -2)).alias("grp"), name(F.element_at(parts, -1)).alias("doc"), "line_no", F.col("line_text").alias("text"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", max_chars: int | None = None) -> DataFrame:
    """(path, text): whole text files below a folder, unreadable ones skipped. With `max_chars`, longer texts are cut and
    end in `...`, as the console does at 10,000,000."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(path, wholetext=True)
    text = F.col("value")
    if max_chars is not None:
        text = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)
    return rows.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))
