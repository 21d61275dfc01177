"""Problem 8: filling fixed-capacity containers with items.

Method: sum-of-squares packing. An item is placed so that, afterwards, the sum over all residual gaps of the squared
number of open containers with that gap is smallest. It is an online rule: a task packs its stream of items with one
counter per gap, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SumOfSquares:
    """Open containers by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # open containers with a gap of 1 to capacity - 1
        self.open: dict[int, list[int]] = {}
        self.opened = 0

    def place(self, size: int) -> int:
        """The container of an item of 1 to `capacity` tokens; of equal choices the fullest."""
        n, cap = self.count, self.capacity
        # change of the sum when a container of gap g = size .. capacity gets the item: g loses one, g - size gains one
        change = np.where(n[size:] > 0, 2 * (n[: cap + 1 - size] - n[size:]) + 2, np.iinfo(np.int64).max)
        if n[size] > 0:
            change[0] = 1 - 2 * n[size]  # filled up: no new gap
        change[cap - size] = 2 * n[cap - size] + 1 if size < cap else 0  # a new container
        gap = size + int(change.argmin())
        if gap == cap:
            box, self.opened = self.opened, self.opened + 1
        else:
            box = self.open[gap].pop()
            n[gap] -= 1
        if left := gap - size:
            n[left] += 1
            self.open.setdefault(left, []).append(box)
        return box


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, items_per_task: int = 20_000) -> DataFrame:
    """(id, part_no, tokens, container): every item's place.

    An item above `capacity` is divided into parts of `capacity` and a rest; no other is. Items without tokens (null or 0,
    so null and empty texts) need no room: one row with 0 tokens and a null container. Repeated rows are packed each.
    Items are dealt to tasks evenly whatever their id or size; a container belongs to one task, so each task may leave
    a few containers open, which `items_per_task` makes few against those it fills. An empty table gives no row.
    """
    items = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    n = items.count()
    tasks = max(1, -(-n // items_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = SumOfSquares(capacity)
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            take, part, tokens, box = [], [], [], []
            for i, size in enumerate(b.column("size").to_pylist()):
                whole, rest = divmod(size, capacity)
                for k in range(whole):
                    take.append(i), part.append(k), tokens.append(capacity), box.append(base + boxes.place(capacity))
                if rest or not size:
                    take.append(i), part.append(whole), tokens.append(rest), box.append(base + boxes.place(rest) if rest else None)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(take, pa.int64())), pa.array(part, pa.int32()), pa.array(tokens, pa.int64()), pa.array(box, pa.int64())], ["id", "part_no", "tokens", "container"])

    kind = items.schema["id"].dataType.simpleString()
    return items.repartition(tasks).mapInArrow(run, f"id {kind}, part_no int, tokens long, container long").withColumnRenamed("id", id_col)


def containers(packed: DataFrame) -> DataFrame:
    """(container, items, used) of the result of `pack`."""
    return packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
