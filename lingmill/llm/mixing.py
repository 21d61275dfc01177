"""Problem 9: mixing sources to target weights.

Method: Pfair scheduling. Every source's output is a row of blocks of equal size; block i of a source with weight w is
released at slot floor(i / w) and due at ceil((i + 1) / w). One slot after the other goes to the released block that is
due first, which keeps every source within one block of its share at any time. Weights are exact fractions. With weights
n / N the schedule repeats itself exactly after N slots, where every source stands exactly at its share; so the slots of
one period, or of the whole stream if that is shorter, hold for every block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingmill.session import cut_lineage


def period_of(weights: dict[str, Fraction]) -> int:
    """The slots after which the schedule of weights that sum to 1 repeats itself."""
    return lcm(*(w.denominator for w in weights.values()))


def pfair(weights: dict[str, Fraction], slots: int) -> dict[str, list[int]]:
    """The slots, among the first `slots`, of each source's blocks in order: earliest deadline first among the released
    blocks. `weights` sum to 1."""
    waiting = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in weights}
    parts = {s: (w.numerator, w.denominator) for s, w in weights.items()}
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            n, d = parts[s]
            heapq.heappush(ready, (-(-(i + 1) * d // n), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        n, d = parts[s]
        heapq.heappush(waiting, ((i + 1) * d // n, s, i + 1))
    return out


def slot_of(block: int, slots: list[int], period: int) -> int:
    """The slot of a source's block; `slots` are those of its blocks in a period."""
    return block // len(slots) * period + slots[block % len(slots)]


def plan(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> tuple[int, dict[str, int]]:
    """(total size, size wanted of each source). Without `total`, the largest mixture in which every source with records
    reaches its share. A source never gives more than `max_repeats` times what it has; one without records gives nothing,
    and the others keep their proportions."""
    there = {s: (share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and available.get(s, 0) > 0}
    mass = sum(share for share, _ in there.values())
    if not there:
        return 0, {}
    if total is None:
        total = int(min(available[s] * cap / (share / mass) for s, (share, cap) in there.items()))
    return total, {s: min(round(total * share / mass), available[s] * cap) for s, (share, cap) in there.items()}


def exact_weights(targets: list[tuple[str, float, int]], wanted: dict[str, int], total: int) -> dict[str, Fraction]:
    """The weights of the schedule: the target shares as the decimal fractions they are written as, among the sources that
    give something; where a source can't give its share, the sizes that are wanted of each."""
    shares = {s: Fraction(str(share)) for s, share, _ in targets if s in wanted}
    mass = sum(shares.values())
    if any(abs(w - total * shares[s] / mass) > 1 for s, w in wanted.items()):
        shares, mass = {s: Fraction(w) for s, w in wanted.items()}, Fraction(sum(wanted.values()))
    return {s: x / mass for s, x in shares.items()}


def mix(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, total: int | None = None, slots: int = 1000, block: int = 65_536, most_slots: int = 200_000, rows_per_bucket: int = 20_000) -> DataFrame:
    """(id, source, copy, tokens, slot, place): the records of the mixture, in the order of slot and place.

    `targets`: source, target_share, max_repeats, one row per source; at most 10,000 rows, since the plan is made on the
    driver from one sum per source. Records of other sources, and records without tokens, are not part of the mixture.
    Copies of a record are numbered from 0. A source's records come in the order of a hash of their id, so a cut falls on
    a random part; that order is found from sums over buckets of bounded size, so a hot source is no task of its own.

    The stream has at least `slots` slots and blocks of at most `block` tokens, as long as the schedule's period or the
    stream has no more than `most_slots` slots, which bounds the table that is broadcast; otherwise blocks are larger. At
    the end of every block each source's size is less than one block from its share.
    """
    rows = targets.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target rows")
    wanted_rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in rows if r["source"] is not None]
    if len({s for s, _, _ in wanted_rows}) < len(wanted_rows):
        raise ValueError("a source has several target rows")
    spark = df.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted_rows], "source string"))
    items = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("tokens")).filter("tokens > 0").join(names, "source", "left_semi")
    items = cut_lineage(items)  # ids and sizes, read three times
    sums = items.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # one row per target
    available = {r["source"]: r["t"] for r in sums}
    goal, wanted = plan(wanted_rows, available, total)
    wanted = {s: w for s, w in wanted.items() if w > 0}
    if not wanted:
        return items.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.lit(0).alias("copy"), "tokens", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("place")).limit(0)
    weights = exact_weights(wanted_rows, wanted, goal)
    # small mixtures get smaller blocks
    size = sum(wanted.values())
    block = max(1, min(block, size // max(slots, len(wanted))))
    period = period_of(weights)
    if min(period, size // block + len(wanted)) > most_slots:
        block = -(-size // (most_slots - len(wanted)))
    stream = size // block + 2 * len(wanted) + 1
    table = pfair(weights, min(period, stream))
    if period > stream:
        period = stream
        for s, w in wanted.items():
            if len(table[s]) * block < w:  # the source's last block, due after the end of the stream
                table[s].append(stream)
    info = F.broadcast(spark.createDataFrame([(s, available[s], wanted[s], len(table[s]), table[s]) for s in wanted], "source string, have long, want long, quota long, slots array<long>"))
    buckets = max(1, -(-sum(r["n"] for r in sums) // rows_per_bucket))
    order = F.xxhash64("id", "tokens")
    placed = items.withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    laid = placed.join(offsets, ["source", "bucket"]).withColumn("at", at).join(info, "source")
    copies = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("cast((want - 1) div have as int)")))).withColumn("at", F.col("at") + F.col("copy") * F.col("have")).filter("at < want")
    number = F.expr(f"at div {block}")
    slot = F.expr(f"(at div {block}) div quota * {period}L") + F.element_at("slots", (number % F.col("quota") + 1).cast("int"))
    return copies.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "copy", "tokens", slot.alias("slot"), (F.col("at") % block).alias("place"))


def shares(mixture: DataFrame, targets: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, target_share, actual_share, tokens, most_copies): what a mixture reached; sources without a record show 0."""
    got = mixture.groupBy(F.col(source_col).alias("source")).agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("most_copies"))
    out = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["tokens", "most_copies"])
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    return out.join(F.broadcast(whole)).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "tokens", "most_copies")
