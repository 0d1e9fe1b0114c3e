"""Near-duplicate codes of one language (problem 5).

Likeness of two codes is the Jaccard similarity J of their sets of three-word shingles.  A set is read as a
fingerprint: a bit for each point of a 48-bit hash space.  J >= t says that the fingerprints of sizes a and
b differ in at most k = (1 - t) / (1 + t) * (a + b) bits.  The hash space is cut into segments, and a
fingerprint becomes its vector of bits per segment; the Manhattan distance of two vectors is never above the
number of bits in which the fingerprints differ.

The vectors are joined on grids.  One grid over a few coarse segments separates nothing: the counts of two
unrelated codes of 150 shingles in 8 segments differ by about 40 in sum, and the bound at t = 0.75 is 43.  So the
segments are narrow and many, and are taken in ``g`` groups of neighbours, more than k of them: each group is a
space of its own, with a grid whose cells are one count wide.  Two vectors within distance k lie in the same
cell in at least g - k of the groups, so that the first k + 1 of a row's g cells, in any one order of all
cells, hold one that they share.  The order takes cells of few rows first, which leaves out groups without any
shingle and those of nothing but boilerplate.  ``g`` depends on the size of the larger set, by powers of two; a
row that may be the smaller of a pair over such a border is put into the grids on both of its sides.

Within a cell, rows are matched over the range of sizes and the places of the cell that the bound allows; the
Manhattan distance over 32 coarse segments is then checked for each pair of classes so found, and the pairs left
are verified exactly on the whole sets.  Nothing is lost at any step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.graph import components
from ..session import commonest, cut
from . import sets
from . import shingles as S

#: A cell of more rows than twice this is split into blocks of about so many, and pairs of blocks.
BLOCK = 4096
#: A cell with so many rows in one task is reported as frequent.
FREQUENT_IN_TASK = 4
#: So many of the most frequent cells are known when cells are put in order, 0.8 MB at most; any others count as
#: rare, and are split when they are met.
MOST_FREQUENT = 1 << 16
#: Sizes up to this share the smallest grids; groups of segments for each bit of the bound.
SMALLEST, GROUPS = 16, 1.5
#: Bits of the hash that are not told apart within a segment, so that there are 2**40 segments.
NARROW = 8
_LEVEL = 26
#: Rows of one class beyond which a join deals them out.
PAIRS = 1 << 16

_CELLS = "k bigint, n int, c bigint, i int, s int"


class Grids:
    """The grids of a likeness num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def bound(self, total: np.ndarray) -> np.ndarray:
        """The most bits in which two fingerprints of so many bits together may differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        """The level of a pair whose larger set has so many shingles: 0 up to ``SMALLEST``, one more up to each double."""
        return np.ceil(np.log2(np.maximum(n, SMALLEST) / SMALLEST)).astype(np.int64)

    def groups(self, level: int) -> int:
        return int(GROUPS * (int(self.bound(np.int64(2 * (SMALLEST << level)))) + 1)) + 1

    def cells(self, points: np.ndarray, begin: np.ndarray, rows: np.ndarray, tag: np.ndarray) -> Iterator[tuple]:
        """For each level: the rows in its grids, how many cells each needs, and all the cells of these rows, row by
        row, with those that are empty."""
        n = np.diff(begin)[rows]
        widest = self.den * n // self.num
        for level in range(int(self.level(n).min(initial=0)), int(self.level(widest).max(initial=-1)) + 1):
            here = (self.level(n) <= level) & (self.level(widest) >= level)
            if not here.any():
                continue
            g = self.groups(level)
            for part in np.array_split(np.flatnonzero(here), -(-int(here.sum()) * g // (1 << 20))):  # of bounded size
                yield level, *self._cells(points, begin, rows[part], n[part], widest[part], tag, level, g)

    def _cells(self, points: np.ndarray, begin: np.ndarray, r: np.ndarray, size: np.ndarray, widest: np.ndarray, tag: np.ndarray, level: int, g: int) -> tuple[np.ndarray, ...]:
        need = self.bound(size + np.minimum(widest, SMALLEST << level)) + 1
        row = np.repeat(np.arange(len(r)), size)
        x = points[np.repeat(begin[r] - np.cumsum(size) + size, size) + np.arange(len(row))]
        group = ((x >> np.uint64(S.BITS - 32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)
        where = row * g + group
        held = np.zeros(len(r) * g, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
        held[where[first]] = np.add.reduceat(S.mix((x >> np.uint64(NARROW)) + np.uint64(1)), first) if len(first) else 0
        empty = np.ones(len(held), bool)
        empty[where[first]] = False
        axis = S.mix(np.arange(g, dtype=np.uint64) + np.uint64(level << 48))
        return r, need, S.mix(held + np.tile(axis, len(r)) ^ np.repeat(tag[r], g)), empty


def _rows_and_frequent(df: DataFrame, grids: Grids, width: int, least: int) -> DataFrame:
    """From ``sets.prepared``: ``sets.ROWS`` of each text with shingles, and rows of ``cell, df`` for cells frequent
    in a task (the rest of the columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        for b in batches:
            points, begin = S.shingles(b["text"], width, least)
            cols = sets.row_batch(b, points, begin)
            yield batch(cols)
            rows = sets.fresh(sets.classes(points, begin, b["tag"])[0], np.diff(begin), seen)
            for _, _, _, cell, empty in grids.cells(points, begin, rows, sets.tag_hashes(b["tag"])):
                held.append(cell[~empty])
            if sum(map(len, held)) > 1 << 23:  # counted in parts, so that a task's memory is bounded
                yield from frequent(held)
                held = []
        yield from frequent(held)

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if len(every):
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            n = np.diff(np.append(first, len(every)))
            often = n >= FREQUENT_IN_TASK
            yield batch({"cell": pa.array(every[first[often]].astype(np.int64)), "df": pa.array(n[often].astype(np.int64))})

    types = {"id": pa.int64(), "cls": pa.binary(), "c": pa.int64(), "n": pa.int32(), "vec": pa.list_(pa.int32()), "tag": pa.string(), "cell": pa.int64(), "df": pa.int64()}

    def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in types.items()], list(types))

    return df.mapInArrow(run, sets.ROWS + ", cell bigint, df bigint")


def _frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent cells and their row counts, sorted by cell.  They only put an order on cells: whichever are
    listed, no pair is lost."""
    counts = cut(first.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("df").alias("df")))
    top = commonest(counts, "df", MOST_FREQUENT).toArrow()
    cell, n = top["cell"].to_numpy().astype(np.uint64), top["df"].to_numpy()
    order = np.argsort(cell)
    return cell[order], n[order].astype(np.int64)


def _cells(df: DataFrame, grids: Grids, often: np.ndarray, n_often: np.ndarray, width: int, least: int, block: int) -> DataFrame:
    """The grid cells of each class: ``k`` the cell, ``n`` the size, ``c`` the class, ``i`` the level and the place of
    the cell among those of the class, ``s`` its block where the cell joins two blocks, else -1."""
    shared = df.sparkSession.sparkContext.broadcast((often, n_often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, n_often = shared.value
        seen: set[bytes] = set()
        for b in batches:
            points, begin = S.shingles(b["text"], width, least)
            both, c_of = sets.classes(points, begin, b["tag"])
            rows = sets.fresh(both, np.diff(begin), seen)  # copies within the task go once
            for level, r, need, cell, empty in grids.cells(points, begin, rows, sets.tag_hashes(b["tag"])):
                g = len(cell) // len(r)
                freq = np.zeros(len(cell), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, cell), len(often) - 1)
                    freq = np.where(often[at] == cell, n_often[at], 0)
                freq[empty] = np.iinfo(np.int64).max
                row = np.repeat(np.arange(len(r)), g)
                order = np.lexsort((cell, freq, row))  # rows stay together; in each, cells of few rows first, then by hash
                place = np.tile(np.arange(g), len(r))
                order, place = order[place < need[row]], place[place < need[row]]
                k, freq, c, size = cell[order], freq[order], c_of[r][row[order]], np.diff(begin)[r][row[order]].astype(np.int32)
                blocks = np.where((freq > 2 * block) & ~empty[order], -(-freq // block), 1)
                if (blocks == 1).all():
                    s = np.full(len(k), -1, np.int32)
                else:
                    every = np.repeat(np.arange(len(k)), blocks)
                    other = np.arange(len(every)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    own = c[every] % blocks[every]
                    lo, hi = np.minimum(own, other), np.maximum(own, other)
                    k = np.where(blocks[every] > 1, _block_cell(k[every], lo, hi), k[every])
                    s = np.where((blocks[every] > 1) & (lo != hi), own, -1).astype(np.int32)
                    c, size, place = c[every], size[every], place[every]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(size), pa.array(c), pa.array((place + (level << _LEVEL)).astype(np.int32)), pa.array(s)], ["k", "n", "c", "i", "s"])

    return df.mapInArrow(run, _CELLS)


def _block_cell(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return S.mix(k + S.mix((lo * 0x1F123BB5 + hi + 1).astype(np.uint64)))


def _pairs_in_cells(cells: DataFrame, grids: Grids, block: int) -> DataFrame:
    """``c_a, c_b``: pairs of classes within the ranges of sizes and places.

    Rows come sorted by cell and size.  A cell is walked by lags, so that only pairs that pass are ever held; one
    cut by the end of a batch is carried to the next.  A cell that grows beyond twice a block unforeseen is not
    walked: its rows go on as they come, are dealt out in blocks, and each pair of blocks is a cell of its own."""
    num, den = grids.num, grids.den
    most = 2 * block

    def walk(split: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: list[np.ndarray] | None = None
            grown = np.zeros(0, np.int64)  # the last cell that has grown too large
            for b in batches:
                now = [b[x].to_numpy() for x in range(5)]
                if rest is not None:
                    now = [np.concatenate([p, q]) for p, q in zip(rest, now, strict=True)]
                if split and len(now[0]):
                    starts = np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))
                    sizes = np.diff(np.append(starts, len(now[0])))
                    over = (sizes > most) | np.isin(now[0][starts], grown)
                    if over.any():
                        grown, gone = now[0][starts[over][-1:]], np.repeat(over, sizes)
                        yield deferred([v[gone] for v in now])
                        now = [v[~gone] for v in now]
                last = int(np.argmax(now[0] == now[0][-1])) if len(now[0]) else 0
                rest = [x[last:] for x in now]
                if last:
                    yield from found([x[:last] for x in now])
            if rest is not None and len(rest[0]):
                yield from found(rest)

        return run

    def deferred(cols: list[np.ndarray]) -> pa.RecordBatch:
        k, n, c, i, s = cols
        return pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(n), pa.array(i), pa.array(s)], ["c_a", "c_b", "k", "n", "i", "s"])

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, n, c, i, s = cols
        again = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        again[1:] |= same
        again[:-1] |= same
        k, n, c, i, s = (x[again] for x in (k, n, c, i, s))
        if len(k):
            twice = np.zeros(len(k), bool)
            twice[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])  # copies from several tasks
            k, n, c, i, s = (x[~twice] for x in (k, n, c, i, s))
        level, place = i >> _LEVEL, i & ((1 << _LEVEL) - 1)
        own = Grids.level(n)
        live = np.arange(len(k))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held, lag = 0, 0
        while True:
            lag += 1
            live = live[live + lag < len(k)]
            j = live + lag
            near = (k[live] == k[j]) & (den * n[live].astype(np.int64) >= num * n[j])  # sorted by size: once too large, always
            live, j = live[near], j[near]
            if not len(live):
                break
            allowed = grids.bound(n[live].astype(np.int64) + n[j])
            good = (np.maximum(place[live], place[j]) <= allowed) & (own[j] == level[j]) & ((s[live] == -1) | (s[live] != s[j])) & (c[live] != c[j])
            if good.any():
                x, y = c[live[good]], c[j[good]]
                out.append((np.minimum(x, y), np.maximum(x, y)))
                held += len(x)
            if held > 1 << 17:
                yield flush(out)
                out, held = [], 0
        if out:
            yield flush(out)

    def flush(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["c_a", "c_b", "k", "n", "i", "s"])

    met = "c_a bigint, c_b bigint, k bigint, n int, i int, s int"
    order = ("k", "n", "c")
    once = cut(cells.repartition("k").sortWithinPartitions(*order).mapInArrow(walk(True), met))
    later = once.where("c_b IS NULL").select("k", "n", F.col("c_a").alias("c"), "i", "s")
    parts = joins.large(later, "k", block)
    pairs = once.where("c_b IS NOT NULL").select("c_a", "c_b")
    if parts is not None:
        own = F.pmod(F.xxhash64("c"), F.col("_parts")).cast("int")
        dealt = later.join(parts, F.col("k") == F.col("_g")).withColumn("_o", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        again = dealt.select(F.xxhash64("k", F.least("_o", "_x"), F.greatest("_o", "_x")).alias("k"), "n", "c", "i", "s")
        pairs = pairs.unionByName(again.repartition("k").sortWithinPartitions(*order).mapInArrow(walk(False), met).select("c_a", "c_b"))
    return cut(pairs.distinct())


def near_duplicates(
    df: DataFrame, *, id_: str, text: str, tag: Column, num: int = 3, den: int = 4, width: int = 3, least: int = S.LEAST_WORDS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Rows and links: ``id, cls, n`` for every text that has shingles, and ``cls_a, cls_b, shared, total``
    for every pair of classes of equal tag with shared / total >= num / den.

    A class holds the rows of equal tag and equal shingle set; likeness within it is 1.  Null texts, null
    tags, null ids and texts of fewer than ``least`` words are in no class.  Repeated ids keep their rows.
    Empty tables give empty results.  Only the three columns named are read.  ``block`` sets only how hot
    cells are spread.  Very long texts are worked through in parts of 1 MB and count in full.
    """
    grids, prepared = Grids(num, den), sets.prepared(df, id_, text, tag)
    first = cut(_rows_and_frequent(prepared, grids, width, least))
    rows = first.where("cls IS NOT NULL")
    pairs = _pairs_in_cells(_cells(prepared, grids, *_frequent(first), width, least, block), grids, block)
    reps = cut(sets.representatives(rows))
    side = lambda s: reps.select(*[F.col(x).alias(f"{x}_{s}") for x in ("c", "cls", "n", "vec", "rep")])
    apart = sum((F.abs(F.col("vec_a")[x] - F.col("vec_b")[x]) for x in range(sets.SEGMENTS)), F.lit(0))
    met = joins.with_unique(joins.with_unique(pairs, side("a"), "c_a", "c_b", PAIRS), side("b"), "c_b", "c_a", PAIRS)
    bounded = cut(met.where((num + den) * apart <= (den - num) * (F.col("n_a") + F.col("n_b"))).select("cls_a", "cls_b", "n_a", "n_b", "rep_a", "rep_b"))
    verified = sets.with_sets(bounded, prepared, width, least).withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    verified = verified.withColumn("total", F.col("n_a") + F.col("n_b") - F.col("shared")).where(den * F.col("shared") >= num * F.col("total"))
    return rows.select("id", "cls", "n"), verified.select("cls_a", "cls_b", "shared", "total")


def groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One row a text: ``id, class_id`` (the smallest id of equal sets), ``group_id`` (the smallest id of all
    reachable over links) and ``n_links`` (linked classes)."""
    reps = cut(rows.groupBy("cls").agg(F.min("id").alias("class_id")))
    of = lambda s: reps.select(F.col("cls").alias(f"cls_{s}"), F.col("class_id").alias(s))
    ends = cut(links.join(of("a"), "cls_a").join(of("b"), "cls_b").select("a", "b"))
    group = components(ends, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    degree = ends.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    known = reps.join(group, "class_id", "left").join(degree, "class_id", "left")
    known = known.select("cls", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return joins.with_unique(rows, known, "cls", "id", PAIRS).select("id", "class_id", "group_id", "n_links")
