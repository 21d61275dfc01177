"""Model text files: lines of `Text <tab> Weight`, headers starting with `#`.

Problem 3, rows that fail to parse. Method: each Arrow batch is parsed by the pyarrow CSV reader, whose invalid-row
callback takes the structural rejects; fields are read as strings, then cast as vectors, and failing cells are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingmill.session import checked_broadcast, cut_lineage

_BOM = "\ufeff"
#: A quoted Text, closed, and what follows it (RE2).
_QUOTED = r'(?s)^ *(?P<q>"(?:[^"]|"")*") *(?:\t+(?P<rest>[^"]*))?$'
#: Line ends within a line would end the CSV row; they travel as these characters.
_TRAVEL = {"\n": "\ue00a", "\r": "\ue00d"}
_WEIGHT = r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# The reasons for rejecting a line.
MISSING, BLANK, QUOTING, FIELDS, NO_TEXT, BAD_WEIGHT, NOT_FINITE = "missing line", "blank line", "broken quoting", "wrong number of fields", "blank text", "invalid weight", "weight not finite"


def _read(index: pa.Array, lines: pa.Array, quoted: bool) -> tuple[pa.Table, dict[int, str]]:
    """(index, text, weight) of the rows with two fields, and the rejects of the CSV reader."""
    rejects: dict[int, str] = {}

    def invalid(row: pcsv.InvalidRow) -> str:
        rejects[int(row.text.split("\t", 1)[0])] = f"{FIELDS}: {row.actual_columns - 1}"
        return "skip"

    names = ["index", "text", "weight"]
    if not len(index):
        return pa.table({n: pa.array([], pa.string()) for n in names}), rejects
    for a, b in _TRAVEL.items():
        lines = pc.replace_substring(lines, a, b)
    rows = pc.binary_join_element_wise(pc.binary_join_element_wise(index.cast(pa.string()), lines, "\t"), "", "\n")
    data = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), "")[0].as_buffer())
    table = pcsv.read_csv(
        pa.BufferReader(data),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
        parse_options=pcsv.ParseOptions(delimiter="\t", quote_char='"' if quoted else False, double_quote=quoted, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pcsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False, null_values=[]),
    )
    return table, rejects


def _choose(mask: pa.Array, value: str, other: pa.Array) -> pa.Array:
    return pc.if_else(pc.fill_null(mask, False), pa.scalar(value), other)


def parse_array(lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(texts, weights, reasons) of lines, none of them a header. All steps are vector operations over the batch; Python
    sees only rows with a wrong number of fields."""
    n = len(lines)
    body = pc.utf8_trim(pc.replace_substring_regex(lines, r"\r$", ""), "\t")
    blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(body)), 0)
    quoted = pc.starts_with(pc.utf8_ltrim(body, " "), '"')
    parts = pc.extract_regex(body, _QUOTED)
    broken = pc.and_(quoted, pc.is_null(parts))
    reason = _choose(pc.is_null(lines), MISSING, _choose(blank, BLANK, _choose(broken, QUOTING, pa.nulls(n, pa.string()))))
    rest = pc.replace_substring_regex(pc.struct_field(parts, "rest"), "\t+", "\t")
    alone = pc.equal(pc.utf8_length(rest), 0)
    with_rest = pc.if_else(alone, pc.struct_field(parts, "q"), pc.binary_join_element_wise(pc.struct_field(parts, "q"), rest, "\t"))
    form = pc.if_else(pc.fill_null(quoted, False), with_rest, pc.replace_substring_regex(body, "\t+", "\t"))
    texts, weights, reasons = np.full(n, None, dtype=object), np.full(n, np.nan, dtype=np.float32), np.array(reason.to_pylist(), dtype=object)
    open_rows = pc.is_null(reason)
    for q in (False, True):
        at = pc.indices_nonzero(pc.and_(open_rows, pc.equal(pc.fill_null(quoted, False), q)))
        table, rejects = _read(at, form.take(at), q)
        for i, why in rejects.items():
            reasons[i] = why
        if not len(table):
            continue
        place = table["index"].combine_chunks().cast(pa.int64()).to_numpy()
        text = table["text"].combine_chunks()
        for a, b in _TRAVEL.items():
            text = pc.replace_substring(text, b, a)
        text = text if q else pc.utf8_trim(text, " ")
        weight = pc.utf8_trim(table["weight"].combine_chunks(), " ")
        has_text = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0)
        formed = pc.match_substring_regex(weight, _WEIGHT)
        # the cast takes every form the pattern lets through; beyond the range it gives infinity
        single = pc.cast(pc.cast(pc.if_else(formed, weight, pa.scalar(None, pa.string())), pa.float64()), pa.float32(), safe=False)
        finite = pc.fill_null(pc.is_finite(single), False)
        why = np.array(pc.case_when(pc.make_struct(pc.invert(has_text), pc.invert(formed), pc.invert(finite)), NO_TEXT, BAD_WEIGHT, NOT_FINITE).to_pylist(), dtype=object)
        good = np.equal(why, None)
        reasons[place] = why
        texts[place[good]] = text.to_numpy(zero_copy_only=False)[good]
        weights[place[good]] = single.to_numpy(zero_copy_only=False)[good]
    bad = pa.array(reasons, pa.string())
    return pa.array(texts, pa.string()), pc.if_else(pc.is_null(bad), pa.array(weights), pa.scalar(None, pa.float32())), bad


def parse_batch(lines: list[str | None]) -> tuple[list[str | None], list[float | None], list[str | None]]:
    """`parse_array` for lists."""
    texts, weights, reasons = parse_array(pa.array(lines, pa.string()))
    return texts.to_pylist(), weights.to_pylist(), reasons.to_pylist()


def with_headers(df: DataFrame, file_col: str = "file_name", no_col: str = "line_no", line_col: str = "line_text") -> DataFrame:
    """`df` with `is_header`: lines starting with `#` before any other line of their file; a byte-order mark in front of
    a file's first line does not count (and is taken off). Only lines starting with `#` meet their file's first other
    line, which is pre-aggregated, so a file with a third of all lines is no hot group. A null line number is no header."""
    line = F.when(F.col(no_col) == 1, F.regexp_replace(F.col(line_col), f"^{_BOM}", "")).otherwise(F.col(line_col))
    rows = df.withColumn(line_col, line)
    marked = F.coalesce(F.col(line_col).startswith("#"), F.lit(False))
    first = rows.filter(~marked).groupBy(F.col(file_col).alias("_file")).agg(F.min(no_col).alias("_first"))
    hashes = rows.filter(marked).join(first, F.col(file_col).eqNullSafe(F.col("_file")), "left")
    header = F.coalesce(F.col(no_col) < F.col("_first"), F.col("_first").isNull() & F.col(no_col).isNotNull())
    return hashes.withColumn("is_header", header).drop("_file", "_first").unionByName(rows.filter(~marked).withColumn("is_header", F.lit(False)))


def parse_lines(df: DataFrame, id_col: str = "line_id", file_col: str = "file_name", no_col: str = "line_no", line_col: str = "line_text") -> DataFrame:
    """(id, file, line_no, is_header, text, weight, reason): every line once.

    Headers have neither text nor reason; loaded lines have a text and a float weight and no reason; all others have a
    reason only. Repeated rows are parsed each; other columns are ignored; an empty table gives no row.
    """
    keep = df.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.col(no_col).alias("no"), F.col(line_col).alias("line"))
    rows = with_headers(keep, "file", "no", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = b.column("is_header")
            texts, weights, reasons = parse_array(pc.if_else(head, pa.scalar("#\t0"), b.column("line")))
            text, weight, reason = (pc.if_else(head, pa.scalar(None, x.type), x) for x in (texts, weights, reasons))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("file"), b.column("no"), head, text, weight, reason], ["id", "file", "no", "is_header", "text", "weight", "reason"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parsed = rows.mapInArrow(run, f"id {kinds['id']}, file {kinds['file']}, no {kinds['no']}, is_header boolean, text string, weight float, reason string")
    return parsed.select(F.col("id").alias(id_col), F.col("file").alias(file_col), F.col("no").alias(no_col), "is_header", "text", "weight", "reason")


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", recursive: bool = False, pattern: str = "*") -> DataFrame:
    """(line_id, file_name, line_no, line_text) of text files, numbered from 1 in each file; `file_name` is the whole path.

    Files are read in splits, never as a whole. A line's number is its place in its split plus the lines of the splits
    before it; the lines of each split are counted first. Places are row ids within a task, less that of the split's first
    line; both passes read the files in the same splits."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).option("encoding", encoding)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line_text"))
    splits = rows.groupBy("file_name", "_s").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy("file_name").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = checked_broadcast(cut_lineage(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")), 1_000_000)
    lines = rows.join(starts, ["file_name", "_s"])
    number = F.col("_before") + F.col("_i") - F.col("_first") + 1
    return lines.select(F.xxhash64("file_name", number).alias("line_id"), "file_name", number.alias("line_no"), "line_text")
