"""Cutting oversized texts into pieces at natural boundaries (problem 1)."""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

LIMIT, OVERLAP = 4000, 200
#: Weights of a cut against an unevenness of one whole piece: after a block that stands alone; at a blank line;
#: at a line's end, by the depth of the next line, and more before a closing bracket or a blank line; at a space; anywhere.
BLOCK, BLANK, LINE, DEPTH, CLOSING, SPACE, ANYWHERE = 0.0, 0.05, 0.15, 0.1, 0.3, 2.0, 4.0

_LINE = re.compile(r"\r\n|\n|\r")
_LEAD = re.compile(r"([ \t]*)[^\S\r\n]*(\S?)")
_SPACE = re.compile(r"[^\S\r\n]+(?=\S)|(?<=[;,{}()\[\]])(?=[^\s;,{}()\[\]])")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places after line ends, in order, with what a cut there costs."""
    at, cost = [], []
    n, start = len(text), 0
    for m in _LINE.finditer(text):
        p = m.end()
        if p >= n:
            break
        lead = _LEAD.match(text, p)
        first = lead[2]  # what the next line starts with, empty if it is blank
        indent = len(lead[1].expandtabs(4))
        before = text[start : m.start()].rstrip()
        start = p
        opens = indent == 0 and first and first not in "}])"
        if not before and opens:
            c = BLOCK
        elif not before:
            c = BLANK + DEPTH * (indent // 2)
        elif opens and before[-1] in "};":
            c = BLANK
        else:
            c = LINE + DEPTH * (indent // 2) + (CLOSING if first in ("}", "]", ")", "") else 0.0)
        at.append(p)
        cost.append(c)
    return np.array(at, np.int64), np.array(cost)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where the pieces end, the last at the text's end.

    From each reachable place, the next cut may lie at any line end within reach; only if there is none, at
    any space; only if there is none, at even distances up to the next line end.  Reach leaves room for the
    overlap, and a piece adds at least as much as it repeats, but the last.  Of all such chains, dynamic
    programming takes the one of least penalties plus squared deviations from the even piece.
    """
    n = len(text)
    if n <= limit:
        return [n]
    reach = limit - overlap
    even = (n - overlap) / -(-(n - overlap) // reach)
    places = boundaries(text)
    if (found := _by_lines(*places, n, limit, overlap, even)) is not None:
        return found
    lines = _Layer(*places)
    spaces: _Layer | None = None
    loose: dict[int, tuple[float, int]] = {}
    best, last = math.inf, 0
    todo: list[tuple[int, float]] = [(0, 0.0)]  # reached places; a line end's cost is looked up when its turn comes
    while todo:
        i, base = heapq.heappop(todo)
        base = min([base, *(x.cost_at(i) for x in (lines, spaces) if x), loose.get(i, (math.inf, 0))[0]])
        far = i + (limit if i == 0 else reach)
        repeated = overlap if i == 0 else 0
        if far >= n and (total := base + ((n - i - repeated - even) / even) ** 2) < best:
            best, last = total, i
        lo, hi = i + max(overlap, 1), min(far, n - 1)
        if not lines.any(lo, hi):
            if far >= n:
                continue
            if spaces is None:
                at = np.array([m.end() for m in _SPACE.finditer(text)], np.int64)
                spaces = _Layer(at, np.full(len(at), SPACE))
            if not spaces.any(lo, hi):
                after = int(np.searchsorted(lines.at, far, "right"))
                gap = (int(lines.at[after]) if after < len(lines.at) else n) - i
                p = i - (-gap // -(-gap // (far - i)))
                p -= text[p - 1 : p + 1] == "\r\n"
                total = base + ANYWHERE + ((p - i - repeated - even) / even) ** 2
                if p not in loose:
                    heapq.heappush(todo, (p, total))
                if total < loose.get(p, (math.inf, 0))[0]:
                    loose[p] = (total, i)
                continue
            layer = spaces
        else:
            layer = lines
        for p in layer.relax(i, base, lo, hi, even, repeated):
            heapq.heappush(todo, (p, math.inf))
    out, at = [n], last
    while at > 0:
        out.append(at)
        ways = [x.way_to(at) for x in (lines, spaces) if x] + [loose.get(at, (math.inf, 0))]
        at = min(ways)[1]
    return out[::-1]


def _by_lines(at: np.ndarray, pay: np.ndarray, n: int, limit: int, overlap: int, even: float) -> list[int] | None:
    """``cuts`` of a text that has a line end within reach of every line end; None for any other.

    The same chain, but each place looks back at all it can be reached from at once."""
    at = np.concatenate([[0], at])
    far = at + np.where(np.arange(len(at)) == 0, limit, limit - overlap)
    step = max(overlap, 1)
    if not ((far >= n) | (np.searchsorted(at, at + step) < np.searchsorted(at, np.minimum(far, n - 1), "right"))).all():
        return None
    low = np.searchsorted(at, at - (limit - overlap))
    low[at <= limit] = 0
    high = np.searchsorted(at, at - step, "right")
    old = np.where(np.arange(len(at)) == 0, overlap, at).astype(float)  # the first piece repeats nothing
    cost, came = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    cost[0] = 0.0
    for j, (a, b, p, c) in enumerate(zip(low.tolist(), high.tolist(), at.tolist(), [0.0, *pay.tolist()], strict=True)):
        if j and a < b:
            total = cost[a:b] + c + ((p - even - old[a:b]) / even) ** 2
            k = int(total.argmin())
            cost[j], came[j] = total[k], a + k
    last = np.flatnonzero(far >= n)
    k = int(last[(cost[last] + ((n - even - old[last]) / even) ** 2).argmin()])
    out = [n]
    while k:
        out.append(int(at[k]))
        k = int(came[k])
    return out[::-1]


class _Layer:
    """Boundaries of one sort: place, penalty, least cost so far and where from."""

    def __init__(self, at: np.ndarray, pay: np.ndarray):
        self.at, self.pay, self.places = at, pay, at.tolist()
        self.cost, self.came = np.full(len(at), np.inf), np.zeros(len(at), np.int64)

    def any(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.places, lo)
        return k < len(self.places) and self.places[k] <= hi

    def way_to(self, p: int) -> tuple[float, int]:
        k = bisect_left(self.places, p)
        return (float(self.cost[k]), int(self.came[k])) if k < len(self.places) and self.places[k] == p else (math.inf, 0)

    def cost_at(self, p: int) -> float:
        k = bisect_left(self.places, p)
        return float(self.cost[k]) if k < len(self.places) and self.places[k] == p else math.inf

    def relax(self, i: int, base: float, lo: int, hi: int, even: float, repeated: int) -> list[int]:
        """Offers a way from i to all places in lo..hi; returns those reached for the first time."""
        a, b = bisect_left(self.places, lo), bisect_right(self.places, hi)
        total = base + self.pay[a:b] + ((self.at[a:b] - i - repeated - even) / even) ** 2
        cost = self.cost[a:b]
        new = self.at[a:b][np.isinf(cost)].tolist()
        better = total < cost
        self.cost[a:b][better] = total[better]
        self.came[a:b][better] = i
        return new


def pieces(df: DataFrame, *, id_: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, piece_no (from 1), start, text`` of every text longer than the limit.

    Lengths are code points; a CRLF counts as two and is never cut in half.  Each piece but the first repeats
    the last ``overlap`` characters of the one before; without these, the pieces in order are the text.  Null
    texts and texts within the limit have no pieces.  Repeated rows are cut each.  Only the two columns named
    are read.  ``limit`` must be more than twice ``overlap``.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            size = 0
            for i, t in zip(b["id"].to_pylist(), b["text"], strict=True):
                s = t.as_py()
                at = 0
                for k, e in enumerate(cuts(s, limit, overlap)):
                    start = at - overlap if k else 0
                    for c, v in zip(cols, (i, k + 1, start, s[start:e]), strict=True):
                        c.append(v)
                    at = e
                size += len(s)
                if size > 1 << 22:
                    yield batch(cols)
                    cols, size = [[], [], [], []], 0
            yield batch(cols)

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["id", "piece_no", "start", "text"])

    long = df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    return spread(long).mapInArrow(run, "id bigint, piece_no int, start bigint, text string")
