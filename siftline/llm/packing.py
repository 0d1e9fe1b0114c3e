"""Filling containers of fixed capacity (problem 7): bounded-space online best-fit.

Each task keeps a fixed number of open containers in lists by free space, and one integer with a bit for each
free space that occurs: the tightest container that an item fits is the lowest set bit at or above its size.
When all are open and none fits, the fullest is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
#: Open containers of a task.
OPEN = 64
#: Containers' worth of tokens in a task of the first round, and tasks of it whose leftovers meet in the second.
PER_TASK, TASKS = 4096, 64

_PACKED = "id bigint, start bigint, n bigint, container bigint, open boolean"


class Bins:
    """``put`` gives the container of an item no larger than the capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.count, self.next = 0, 0, 0

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count == self.most:  # the fullest closes: the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space = self.next, self.capacity
            self.next += 1
        if space > size:
            self.free[space - size].append(bin_)
            self.bits |= 1 << (space - size)
            self.count += 1
        return bin_

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop(0)
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.count -= 1
        return bin_

    def still_open(self) -> set[int]:
        return {b for f in self.free for b in f}


def _pack(items: DataFrame, tasks: int, capacity: int, most: int, round_: int, last: bool) -> DataFrame:
    """Items ``id, start, n`` by hash into tasks, within them in an order that depends on the data alone, so
    that a task that runs again packs alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, most), (round_ << 60) | (TaskContext.get().partitionId() << 32)
        held: dict[int, list[tuple[int, int, int]]] = {}
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for i, s, n in zip(*(b[c].to_pylist() for c in ("id", "start", "n")), strict=True):
                held.setdefault(bins.put(n), []).append((i, s, n))
            open_ = bins.still_open()
            for k in [k for k in held if k not in open_]:
                out += [(*x, k) for x in held.pop(k)]
            yield batch(out, base, False)
        yield batch([(*x, k) for k, v in held.items() for x in v], base, not last)

    def batch(rows: list, base: int, open_: bool) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array([base + k for k in cols[3]], pa.int64()), pa.array([open_] * len(rows), pa.bool_())], ["id", "start", "n", "container", "open"])

    order = F.xxhash64("id", "start", "n")
    return items.select("id", "start", "n").repartition(tasks, order).sortWithinPartitions(order, "id", "start", "n").mapInArrow(run, _PACKED)


def packed(sizes: DataFrame, *, id_: str, n: str, capacity: int = CAPACITY, most: int = OPEN, per_task: int = PER_TASK, tasks: int = TASKS) -> DataFrame:
    """``id, start, n, container``: which of the item's units lie in which container.

    An item over the capacity gives full containers of its own and a rest that is packed like any item; all
    others stay whole.  Null, zero and negative sizes take no place and do not come out.  Repeated items are
    packed each.  A first round packs by task; what lies in containers still open at a task's end is packed
    again, many tasks' leftovers together, so that few containers stay partly empty whatever the tasks.
    """
    items = sizes.where(F.col(n) > 0).select(F.col(id_).cast("bigint").alias("id"), F.col(n).cast("bigint").alias("n"))
    items = cut(items)
    total = items.agg(F.sum("n")).first()[0] or 0
    first = max(1, -(-total // (capacity * per_task)))
    whole = F.expr(f"transform(sequence(0L, (n - 1) div {capacity}), i -> named_struct('start', i * {capacity}, 'n', least({capacity}L, n - i * {capacity})))")
    parts = items.select("id", F.explode(whole).alias("p")).select("id", "p.start", "p.n")
    once = cut(_pack(parts, first, capacity, most, 0, False))
    again = _pack(once.where("open"), max(1, -(-first // tasks)), capacity, most, 1, True)
    return once.where("NOT open").unionByName(again).select("id", "start", "n", "container")


def fill(packed_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container, items, n, free`` of each container."""
    return packed_.groupBy("container").agg(F.count("*").alias("items"), F.sum("n").alias("n")).withColumn("free", F.lit(capacity) - F.col("n"))
