"""Model training: n-gram counts, cumulative-mass cuts, TF-IDF, BM25 and residual-IDF weights.

Counts are rows (grp, doc, n, ngram, cnt); a group is one universe of documents. Nothing is dense: a weight that is
not there is 0 (residual IDF says what an absent n-gram weighs in a column).
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingmill.config import CUTS, TrainConfig
from lingmill.functions.cyrillic import has_cyrillic_char
from lingmill.functions.ngrams import explode_ngrams, ngrams, segments
from lingmill.session import checked_broadcast, cut_lineage

KEY = ["grp", "doc"]


#: Stands for a dropped word, over which no n-gram reaches.
_GAP = "\u0002"


def split_lines(df: DataFrame, keys: list[str], order_col: str, text_col: str = "text") -> DataFrame:
    """(keys..., line_no, text): the lines of texts, to be tokenized line by line. `order_col` (a whole number below 2^31)
    orders the texts of a key, which are read one after the other as one file."""
    lines = df.select(*keys, F.col(order_col).cast("long").alias("_o"), F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("_l", "text"))
    return lines.select(*keys, (F.shiftleft("_o", 32) + F.col("_l")).alias("line_no"), "text")


def _last(tokens: Column, n: int) -> Column:
    """The last `n` tokens of an array, or all."""
    return F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n))


def join_lines(rows: DataFrame, most: int, block: int = 10_000) -> DataFrame:
    """`rows` (grp, doc, line_no, tokens) with a column `carry`: the last `most` tokens before each line.

    Lines without a token are left out. A document's lines are looked at in blocks of `block` line numbers; of each block
    only its last tokens meet those of the others, so no task holds a document."""
    there = rows.filter(F.size("tokens") > 0).withColumn("_b", F.floor(F.col("line_no") / block).cast("long")).withColumn("_tail", _last(F.col("tokens"), most))
    in_block = Window.partitionBy("grp", "doc", "_b").orderBy("line_no")

    def before(tail: str, w: Window) -> Column:
        none = F.array().cast("array<string>")
        return _last(F.flatten(F.array(*(F.coalesce(F.lag(tail, k).over(w), none) for k in range(most, 0, -1)))), most)

    near = there.withColumn("_near", before("_tail", in_block))
    ends = near.groupBy("grp", "doc", "_b").agg(F.max_by(_last(F.concat("_near", "tokens"), most), "line_no").alias("_end"))
    blocks = ends.withColumn("_far", before("_end", Window.partitionBy("grp", "doc").orderBy("_b"))).select("grp", "doc", "_b", "_far")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("grp", "doc", "_b")]
    out = near.alias("r").join(blocks.alias("k"), same[0] & same[1] & same[2])
    return out.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), _last(F.concat("k._far", "r._near"), most).alias("carry"))


def count_ngrams(docs: DataFrame, order: int, skip_cyrillic: Column | None = None, gap: str = "reset", line_col: str | None = None) -> DataFrame:
    """(grp, doc, n, ngram, cnt) of rows (grp, doc, tokens).

    Without `line_col`, n-grams never reach over two rows. With it, a document's rows are the lines of one file, in that
    (numeric) order, and n-grams reach over the ends of lines, whatever their number or length. Where the boolean column
    `skip_cyrillic` is true, words with Cyrillic letters are left out, and n-grams stop there or bridge (`gap`)."""
    rows = docs.select("grp", "doc", *([F.col(line_col).alias("line_no")] if line_col else []), "tokens", *([skip_cyrillic.alias("skip")] if skip_cyrillic is not None else []))
    keep = (lambda t: ~(F.col("skip") & has_cyrillic_char(t))) if skip_cyrillic is not None else None
    if line_col is None:
        if keep is not None:
            rows = rows.select("grp", "doc", F.explode(segments(F.col("tokens"), keep, gap)).alias("tokens"))
        return explode_ngrams(rows, KEY, "tokens", tuple(range(1, order + 1))).groupBy("grp", "doc", "n", "ngram").agg(F.count("*").alias("cnt"))
    if keep is not None:
        marked = F.filter("tokens", keep) if gap == "bridge" else F.transform("tokens", lambda t: F.when(keep(t), t).otherwise(F.lit(_GAP)))
        rows = rows.withColumn("tokens", marked)
    lines = rows.select("grp", "doc", "line_no", "tokens")
    lines = join_lines(lines, order - 1) if order > 1 else lines.withColumn("carry", F.array().cast("array<string>"))
    parts = F.array(*(F.struct(F.lit(n).cast("tinyint").alias("n"), ngrams(F.concat(_last(F.col("carry"), n - 1), F.col("tokens")) if n > 1 else F.col("tokens"), n).alias("g")) for n in range(1, order + 1)))
    grams = lines.select("grp", "doc", F.explode(parts).alias("o")).select("grp", "doc", F.col("o.n").alias("n"), F.explode("o.g").alias("ngram"))
    if keep is not None:
        grams = grams.filter(~F.col("ngram").contains(_GAP))
    return grams.groupBy("grp", "doc", "n", "ngram").agg(F.count("*").alias("cnt"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Partial counts (of portions, of orders) merged: equal n-grams of a document are summed."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("grp", "doc", "n", "ngram").agg(F.sum("cnt").alias("cnt"))


def cut_counts(counts: DataFrame, cut: int) -> DataFrame:
    """`counts` is read several times: write it first if it is costly. The n-grams of each (grp, doc, n) that make up the first percents of its mass, the most frequent first, of equal
    counts the lesser n-gram first: kept while the running sum is at most the percentage.

    No document's vocabulary is sorted in one task. The count at which the mass runs out is found from the histogram of
    counts (few distinct values); n-grams above it stay, below it go. Of those that tie at it, as many stay as fit: they
    are counted by their first characters, and only those that share the first 8 characters with the last one that fits
    are numbered.
    """
    percents = CUTS[cut]
    if percents is None:
        return counts
    pct = F.element_at(F.create_map(*(F.lit(x) for kv in percents.items() for x in kv)), F.col("n").cast("int"))
    hist = counts.groupBy("grp", "doc", "n", "cnt").agg(F.count("*").alias("k"))
    unit = Window.partitionBy("grp", "doc", "n")
    down = unit.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("cnt") * F.col("k")
    seen = hist.withColumn("above", F.coalesce(F.sum(mass).over(down), F.lit(0))).withColumn("total", F.sum(mass).over(unit)).withColumn("pct", pct)
    # whole n-grams of this count that still fit
    fits = F.floor((F.col("pct") * F.col("total") - F.col("above") * 100) / (F.col("cnt") * 100))
    seen = seen.withColumn("fit", F.greatest(F.lit(0), F.least(F.col("k"), fits)).cast("long"))
    full = F.min(F.when(F.col("fit") == F.col("k"), 1).otherwise(0)).over(unit.orderBy(F.desc("cnt")))
    marked = seen.withColumn("all_above", full).withColumn("before", F.coalesce(F.lag("all_above").over(unit.orderBy(F.desc("cnt"))), F.lit(1)))
    limits = marked.filter((F.col("before") == 1) & (F.col("fit") > 0)).select("grp", "doc", "n", "cnt", "k", "fit")
    # one row for each count from the most frequent down to where the mass runs out, a few hundred a document
    limits = checked_broadcast(cut_lineage(limits))
    kept = counts.join(limits, ["grp", "doc", "n", "cnt"])
    columns = ["grp", "doc", "n", "ngram", "cnt"]
    tied = kept.filter("fit < k")
    edge3 = _edge(tied.withColumn("b", F.substring("ngram", 1, 3)), unit).select("grp", "doc", "n", F.col("b").alias("b3"), F.col("rest").alias("rest3"))
    near = tied.drop("fit").join(edge3, ["grp", "doc", "n"])
    at_edge = near.filter(F.substring("ngram", 1, 3) == F.col("b3"))
    edge8 = _edge(at_edge.withColumn("b", F.substring("ngram", 1, 8)).withColumn("fit", F.col("rest3")), unit).select("grp", "doc", "n", F.col("b").alias("b8"), F.col("rest").alias("rest8"))
    at_edge = at_edge.join(edge8, ["grp", "doc", "n"])
    number = F.row_number().over(Window.partitionBy("grp", "doc", "n").orderBy("ngram"))
    parts = [
        kept.filter("fit = k"),
        near.filter(F.substring("ngram", 1, 3) < F.col("b3")),
        at_edge.filter(F.substring("ngram", 1, 8) < F.col("b8")),
        at_edge.filter(F.substring("ngram", 1, 8) == F.col("b8")).withColumn("r", number).filter(F.col("r") <= F.col("rest8")),
    ]
    return reduce(DataFrame.unionByName, (x.select(*columns) for x in parts))


def _edge(rows: DataFrame, unit) -> DataFrame:
    """Of rows (grp, doc, n, b, fit): the bucket `b` in which the `fit`-th row falls, in the order of buckets, and how many
    rows of it still fit. One row for each document and order, broadcast if they are few."""
    sizes = rows.groupBy("grp", "doc", "n", "fit", "b").agg(F.count("*").alias("m"))
    first = F.coalesce(F.sum("m").over(unit.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("first", first).filter((F.col("first") < F.col("fit")) & (F.col("first") + F.col("m") >= F.col("fit")))
    return checked_broadcast(cut_lineage(at.select("grp", "doc", "n", "b", (F.col("fit") - F.col("first")).alias("rest"))))


def group_sizes(counts: DataFrame) -> DataFrame:
    """(grp, n_docs): documents with at least one n-gram."""
    return counts.select("grp", "doc").distinct().groupBy("grp").agg(F.count("*").alias("n_docs"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(grp, ngram, df): in how many documents of its group an n-gram occurs."""
    return counts.groupBy("grp", "ngram").agg(F.count("*").alias("df"))


def term_frequency(counts: DataFrame) -> DataFrame:
    """(grp, doc, ngram, cnt, tf): count by the number of distinct n-grams of the document."""
    size = counts.groupBy("grp", "doc").agg(F.count("*").alias("size"))
    return counts.join(size, KEY).select("grp", "doc", "ngram", "cnt", (F.col("cnt") / F.col("size")).alias("tf"))


def tfidf(counts: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(grp, doc, ngram, weight), weight = -tf ln(df / N), zeros left out. `n_docs` overrides N, the number of documents."""
    out = term_frequency(counts).join(document_frequency(counts), ["grp", "ngram"])
    out = out.withColumn("n_docs", F.lit(n_docs)) if n_docs else out.join(group_sizes(counts), "grp")
    weight = -F.col("tf") * F.ln(F.col("df") / F.col("n_docs"))
    return out.filter(F.col("df") != F.col("n_docs")).select("grp", "doc", "ngram", weight.alias("weight"))


def tfidf_one_dimension(counts: DataFrame, n_docs: int, doc: str) -> DataFrame:
    """The vector of one document with N given, zeros kept."""
    one = term_frequency(counts).filter(F.col("doc") == doc).join(document_frequency(counts), ["grp", "ngram"])
    return one.select("grp", "doc", "ngram", (-F.col("tf") * F.ln(F.col("df") / F.lit(n_docs))).alias("weight"))


def bm25(counts: DataFrame) -> DataFrame:
    """(grp, doc, ngram, weight), weight = 3c / (2 (0.25 + 0.75 dl / avgdl) + c) ln((N - df + 0.5) / (df + 0.5)), where dl
    is the document's sum of counts; it may be negative."""
    length = counts.groupBy("grp", "doc").agg(F.sum("cnt").alias("dl"))
    mean = length.groupBy("grp").agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n_docs"))
    out = counts.join(length, KEY).join(mean, "grp").join(document_frequency(counts), ["grp", "ngram"])
    tf = 3 * F.col("cnt") / (2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")) + F.col("cnt"))
    return out.select("grp", "doc", "ngram", (tf * F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))


def residual_idf(counts: DataFrame) -> DataFrame:
    """(grp, doc, ngram, weight, absent): weight = -ln(df / N) + ln(1 - e^(-cf / N)) in the documents that hold the n-gram;
    `absent` is what it weighs in every other document, -ln(df / N)."""
    stats = counts.groupBy("grp", "ngram").agg(F.count("*").alias("df"), F.sum("cnt").alias("cf")).join(group_sizes(counts), "grp")
    idf = -F.ln(F.col("df") / F.col("n_docs"))
    stats = stats.select("grp", "ngram", idf.alias("absent"), (idf + F.ln(1 - F.exp(-F.col("cf") / F.col("n_docs")))).alias("weight"))
    return counts.select("grp", "doc", "ngram").join(stats, ["grp", "ngram"]).select("grp", "doc", "ngram", "weight", "absent")


def train(docs: DataFrame, config: TrainConfig | None = None, skip_cyrillic: Column | None = None, line_col: str | None = None) -> DataFrame:
    """(grp, doc, ngram, weight) of rows (grp, doc, tokens), all groups in one job; with `line_col` the rows are lines of
    files. The counts, which the cut and the weights read several times, are written to the shared checkpoint folder once,
    by jobs that run as soon as the plan is made."""
    c = config or TrainConfig()
    counts = cut_lineage(count_ngrams(docs, c.order, skip_cyrillic if skip_cyrillic is not None else F.lit(True) if c.skip_cyrillic else None, c.gap, line_col))
    counts = cut_lineage(cut_counts(counts, c.cut))
    weighed = {"tfidf": tfidf, "bm25": bm25, "residual_idf": residual_idf}[c.weighting](counts)
    return weighed.select("grp", "doc", "ngram", "weight").filter("weight <> 0")


def train_all(docs: DataFrame, configs: list[TrainConfig] | None = None, errors: dict[tuple[int, int], Exception] | None = None) -> DataFrame:
    """Models of several settings, marked by `order` and `cut`. A setting that fails does not stop the others: its error is
    put into `errors` by (order, cut), and warned of; if all fail, the last error is raised."""
    out, last = None, None
    for c in configs or TrainConfig.all_models():
        try:
            m = cut_lineage(train(docs, c)).withColumns({"order": F.lit(c.order), "cut": F.lit(c.cut)})
        except Exception as e:  # noqa: BLE001
            last = e
            warnings.warn(f"order {c.order}, cut {c.cut}: {e}", stacklevel=2)
            if errors is not None:
                errors[c.order, c.cut] = e
            continue
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise last or ValueError("no settings")
    return out


def ordered(counts: DataFrame, ties: str = "asc") -> DataFrame:
    """Counts by frequency, the highest first; equal counts by n-gram, ascending or descending."""
    return counts.orderBy(F.desc("cnt"), F.asc("ngram") if ties == "asc" else F.desc("ngram"))


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent n-grams of each (grp, doc, n) with their rank; each task keeps `k` before the shuffle."""
    order = Window.partitionBy("grp", "doc", "n").orderBy(F.desc("cnt"), F.asc("ngram"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def require_words(docs: DataFrame) -> DataFrame:
    """`docs`, or an error that names documents without a word."""
    bad = empty_documents(docs).limit(5).collect()
    if bad:
        raise ValueError("no words in " + ", ".join(f"{r['grp']}/{r['doc']}" for r in bad))
    return docs


def empty_documents(docs: DataFrame) -> DataFrame:
    """(grp, doc) of documents without a word in any row."""
    return docs.groupBy("grp", "doc").agg(F.max(F.size(F.coalesce("tokens", F.array().cast("array<string>")))).alias("most")).filter("most <= 0").select("grp", "doc")
