"""The same or almost the same records across splits (problem 3).

Likeness is the Jaccard similarity of sets of three-word shingles.  Written as a string, the sorted
shingles of a set, two sets of sizes a and b lie at an edit distance (insertions and deletions) that is
exactly the number D of shingles that only one of them has, whatever the order of the code.  Likeness
>= t is then D <= (1 - t) / (1 + t) * (a + b) =: k, and the segment join is exact: an evaluation string
cut into more than k segments keeps at least one of them untouched in any string within distance k, at a
position moved by x with |x| + |d - x| <= k, d being the difference of lengths.  Training strings offer
their substrings of the lengths that segments have; those that match at an allowed position are verified
by a banded dynamic program over the two strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bloom
from ..operators import joins
from ..session import cut
from . import sets
from . import shingles as S

_SEGMENTS = "k bigint, c bigint, n int, p int"
#: Numbers in the table of one batch of dynamic programs, 16 MB.
_CELLS = 1 << 21
#: Segments in one Bloom filter, 16 MB at 16 bits each; more go by ranges of their hash, one filter after another.
IN_FILTER = bloom.MOST_BITS // 16
#: Rows of one segment, and pairs of one class, beyond which a join deals them out.
BLOCK, PAIRS = 4096, 1 << 16


def most_edits(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest edit distance of strings of lengths a and b of likeness num / den or more."""
    return ((den - num) * (a + b)) // (den + num)


def _windows(points: np.ndarray, begin: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """A hash of the ``length`` points from each start."""
    h = np.full(len(starts), length, np.uint64)
    for j in range(length):
        h = S.mix(h * np.uint64(0xD6E8FEB86659FD93) + points[starts + j])
    return h


def segments(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of lengths n, end to end: string, start and length of each of their segments, one more
    than the edits to the longest partner."""
    k = most_edits(n, den * n // num, num, den) + 1
    which = np.repeat(np.arange(len(n)), k)
    i = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
    start = i * n[which] // k[which]
    end = (i + 1) * n[which] // k[which]
    return which, start, end - start


def lengths(num: int, den: int) -> dict[int, int]:
    """For each length that a segment can have, the longest string with such a segment (0: any).

    With r = num / (den - num), a string of n is cut into pieces of n / m, floor and ceiling, where m grows by
    (den - num)(den + num) for each num(den + num) more in n, just by the factor r.  From n = r * r on, n / m lies
    within 1 of r and comes closer from its side in every such period; so one period beyond that shows all
    lengths that ever occur there, and the strings before are looked at one by one."""
    d = math.gcd(num, den)
    num, den = num // d, den // d
    early = (num // (den - num) + 1) ** 2 + 1
    n = np.arange(1, early + num * (den + num) + 1, dtype=np.int64)
    m = most_edits(n, den * n // num, num, den) + 1
    out: dict[int, int] = {}
    for size in (n // m, -(-n // m)):
        for late in (False, True):  # in order of n, so that the longest stays
            here = (n > early) == late
            found = np.unique(size[here])
            for x in found[found > 0].tolist():
                out[x] = 0 if late or out.get(x) == 0 else max(out.get(x, 0), int(n[here & (size == x)].max()))
    return dict(sorted(out.items()))


def _eval_segments(df: DataFrame, num: int, den: int, width: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            points, begin = S.shingles(b["text"], width, least)
            both, c = sets.classes(points, begin, b["tag"])
            n, rows = np.diff(begin), sets.fresh(both, np.diff(begin), seen)
            if not len(rows):
                continue
            which, start, size = segments(n[rows], num, den)
            row = rows[which]
            k = np.zeros(len(row), np.uint64)
            for x in np.unique(size):
                at = size == x
                k[at] = _windows(points, begin, int(x), begin[row[at]] + start[at])
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c[row]), pa.array(n[row].astype(np.int32)), pa.array(start.astype(np.int32))], ["k", "c", "n", "p"])

    return df.mapInArrow(run, _SEGMENTS)


def _range(k: Column, of: int) -> Column:
    """The range, of so many, that a segment's hash falls in by its first eight bits."""
    return F.pmod(F.shiftright(k, 56), F.lit(of))


def _train_substrings(df: DataFrame, filter_: np.ndarray, number: int, of: int, num: int, den: int, width: int, least: int) -> DataFrame:
    """Substrings of one range that pass the Bloom filter of its segments; nearly all others stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(filter_)
    sizes = lengths(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_: np.ndarray = shared.value
        seen: set[bytes] = set()
        for b in batches:
            points, begin = S.shingles(b["text"], width, least)
            both, c = sets.classes(points, begin, b["tag"])
            n, new = np.diff(begin), np.zeros(len(begin) - 1, bool)
            new[sets.fresh(both, n, seen)] = True
            row = np.repeat(np.arange(len(n)), n)
            for size, longest in sizes.items():
                fits = new[row] & (np.arange(len(points)) + size <= begin[row + 1])
                if longest:
                    fits &= (n * num <= longest * den)[row]
                start = np.flatnonzero(fits)
                k = _windows(points, begin, size, start)
                hit = bloom.hits(filter_, k)
                if of > 1:
                    hit &= (k.astype(np.int64) >> 56) % of == number
                start, k = start[hit], k[hit]
                r = row[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.astype(np.int64)), pa.array(c[r]), pa.array(n[r].astype(np.int32)), pa.array((start - begin[r]).astype(np.int32))], ["k", "c", "n", "p"]
                )

    return df.mapInArrow(run, _SEGMENTS)


def _offered(train: DataFrame, asked: DataFrame, in_filter: int, num: int, den: int, width: int, least: int) -> DataFrame:
    """Substrings of training strings that may be segments: as many passes over the texts as the segments need
    filters, at most 256, so that a filter is full only beyond 2 * 10**9 segments, and then only lets more pass."""
    total = asked.count()
    of = min(256, max(1, -(-total // in_filter)))
    out: DataFrame | None = None
    for i in range(of):
        bits = bloom.bits_for(-(-total // of))
        filter_ = bloom.collect(bloom.build(asked.where(_range(F.col("k"), of) == i) if of > 1 else asked, F.col("k"), bits), bits)
        found = cut(_train_substrings(train, filter_, i, of, num, den, width, least).distinct())
        out = found if out is None else out.unionByName(found)
    return out


def banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances (insertions and deletions) of pairs of strings, cells further than ``most`` from the
    diagonal left out; above ``most`` the value is only known to be larger.  One row of all bands at a time:
    the best way along a row is a running minimum."""
    p = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    half = int(most.max(initial=0)) + 1
    band = 2 * half + 1
    far = np.int32(1 << 29)
    # padded so that every band position exists: unlike values on either side
    rows = int(la.max(initial=0))
    left = np.full((p, rows), -1, np.int64)
    right = np.full((p, rows + 2 * band + int(lb.max(initial=0))), -2, np.int64)
    for x in range(p):
        left[x, : la[x]] = a[x]
        right[x, half : half + lb[x]] = b[x]
    d = np.arange(-half, half + 1)
    now = np.broadcast_to(np.where(d >= 0, d, far), (p, band)).astype(np.int32).copy()
    now[d[None, :] > lb[:, None]] = far
    out = np.where(la == 0, lb, far).astype(np.int64)
    slope = np.arange(band, dtype=np.int32)
    for i in range(1, rows + 1):
        same = right[:, i - 1 : i - 1 + band] == left[:, i - 1 : i]
        new = np.where(same, now, far).astype(np.int32)
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        j = i + d
        new[:, (j < 0)] = far
        new = np.minimum.accumulate(new - slope, axis=1) + slope
        new[j[None, :] > lb[:, None]] = far
        new[:, (j < 0)] = far
        now = np.minimum(new, far)
        if not i & 63 and (now.min(axis=1) > most).all():
            break  # no way within the bounds is left
        done = np.flatnonzero(la == i)
        if len(done):
            at = lb[done] - i + half
            ok = (at >= 0) & (at < band)
            out[done[ok]] = now[done[ok], at[ok]]
    return out


def _verify(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Keeps ``cls_a, cls_b`` whose strings ``set_a, set_b`` lie within the edits allowed; adds ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.asarray(v.values) for v in b[c]] for c in ("set_a", "set_b"))
            most = most_edits(np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64), num, den)
            edits = np.zeros(len(x), np.int64)
            order = np.argsort([len(v) for v in x], kind="stable")  # like lengths together
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and (hi - lo + 1) * (len(x[order[hi]]) + 5 * int(most[order[hi]]) + 8) < _CELLS:
                    hi += 1
                part = order[lo:hi]
                edits[part] = banded([x[r] for r in part], [y[r] for r in part], most[part])
                lo = hi
            good = pa.array(edits <= most)
            yield pa.RecordBatch.from_arrays([b["cls_a"].filter(good), b["cls_b"].filter(good), pa.array(edits).filter(good)], ["cls_a", "cls_b", "edits"])

    return pairs.select("cls_a", "cls_b", "set_a", "set_b").mapInArrow(run, "cls_a binary, cls_b binary, edits bigint")


def overlaps(
    df: DataFrame, *, id_: str, text: str, split: str, train: str = "train", evaluation: tuple[str, ...] = ("test", "val"), num: int = 4, den: int = 5, width: int = 3, least: int = S.LEAST_WORDS, in_filter: int = IN_FILTER, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluation rows, training rows (``id, cls, n`` each) and the links ``cls_a, cls_b, edits`` from
    evaluation classes to training classes of likeness >= num / den.

    A class holds the rows of one side with equal shingle sets.  Null texts and ids, texts of fewer than
    ``least`` words and rows of any other split (or none) are in no class; an empty side gives empty results.
    Repeated rows are members of one class.  Only the three columns named are read.
    """
    side = F.when(F.col(split) == train, F.lit("t")).when(F.col(split).isin(*evaluation), F.lit("e"))
    prepared = sets.prepared(df, id_, text, side)
    rows = cut(sets.rows_of(prepared, width, least))
    asked = cut(_eval_segments(prepared.where("tag = 'e'"), num, den, width, least).distinct())
    offered = _offered(prepared.where("tag = 't'"), asked, in_filter, num, den, width, least)
    e, t = (x.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("c", "n", "p")]) for x, s in ((asked, "e"), (offered, "t")))
    x, d, both = F.col("p_t") - F.col("p_e"), F.col("n_t") - F.col("n_e"), F.col("n_t") + F.col("n_e")
    near = (den + num) * (F.abs(x) + F.abs(d - x)) <= (den - num) * both
    met = cut(joins.in_blocks(e, t, "k", ("c_e", "c_t"), near, block).select("c_e", "c_t").distinct())
    reps = cut(rows.groupBy("tag", "cls", "c").agg(F.min("id").alias("rep")))
    of = lambda s, i: reps.where(F.col("tag") == s).select(F.col("c").alias(f"c_{s}"), F.col("cls").alias(f"cls_{i}"), F.col("rep").alias(f"rep_{i}"))
    pairs = cut(joins.with_unique(joins.with_unique(met, of("e", "a"), "c_e", "c_t", PAIRS), of("t", "b"), "c_t", "c_e", PAIRS).select("cls_a", "cls_b", "rep_a", "rep_b"))
    links = _verify(sets.with_sets(pairs, prepared, width, least), num, den)
    split_ = lambda s: rows.where(F.col("tag") == s).select("id", "cls", "n")
    return split_("e"), split_("t"), links


def pairs(evaluation: DataFrame, train: DataFrame, links: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``, smaller first: every evaluation row with every training row of a linked class."""
    both = joins.members(links, "cls_a", "cls_b", evaluation, train, "cls", "id")
    return both.select(F.least("member_a", "member_b").alias("row_id_a"), F.greatest("member_a", "member_b").alias("row_id_b")).distinct()


def matches(evaluation: DataFrame, train: DataFrame, links: DataFrame) -> DataFrame:
    """One row an evaluation row with shingles: ``id, class_id`` (smallest id of equal sets), ``n_links``
    (training classes it is like), ``n_rows`` (training rows in them) and ``n_same`` (of those, with an equal set)."""
    size = train.groupBy(F.col("cls").alias("cls_b")).agg(F.count("*").alias("rows"))
    found = links.join(size, "cls_b").groupBy(F.col("cls_a").alias("cls")).agg(F.count("*").alias("n_links"), F.sum("rows").alias("n_rows"), F.sum(F.when(F.col("edits") == 0, F.col("rows")).otherwise(0)).alias("n_same"))
    reps = evaluation.groupBy("cls").agg(F.min("id").alias("class_id"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_links", "n_rows", "n_same")]
    return joins.with_unique(evaluation, reps.join(found, "cls", "left").select("cls", "class_id", *zero), "cls", "id", PAIRS).select("id", "class_id", "n_links", "n_rows", "n_same")


def report(df: DataFrame, found: DataFrame, id_: str, split: str, source: Column, evaluation: tuple[str, ...] = ("test", "val")) -> DataFrame:
    """``split, source, n_rows, n_overlapping, n_same, n_pairs`` of the evaluation rows."""
    rows = df.where(F.col(split).isin(*evaluation)).select(F.col(id_).alias("id"), F.col(split).alias("split"), source.alias("source"))
    joined = rows.join(found.select("id", F.col("n_rows").alias("pairs"), "n_same"), "id", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("pairs") > 0).alias("n_overlapping"), F.count_if(F.col("n_same") > 0).alias("n_same"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs")
    )
