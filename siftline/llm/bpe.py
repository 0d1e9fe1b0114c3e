"""Byte-level BPE by speculation (problem 6).

A word's tokens are first guessed: greedily the longest token, then the next.  The guess is the encoding
exactly when every token is what its own bytes encode to and every two neighbours are *compatible*, that is,
encode to themselves when written together.  Compatibility is decided from the merge ranks alone, for all
pairs of a batch at once: undoing the later of the two tokens' merges step by step shows every pair that ever
met at their border, and they are incompatible if such a pair had a merge of its own before either side's
next.  Only words with an incompatible pair are merged step by step, with a heap.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the public tokenizers' vocabulary files are.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a process; beyond that they are forgotten and encoded anew.
_MOST = 400_000
_LONGEST_KEPT = 64
_FAR = np.int64(1 << 40)


class Encoder:
    def __init__(self, path: str):
        """``path``: a file of base64 tokens and ranks; ids are ranks, and single bytes come first."""
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        n = len(self.tokens)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.array([0 if len(t) == 1 else i + 1 for i, t in enumerate(self.tokens)], np.int64)
        for i, t in enumerate(self.tokens):
            if len(t) > 1 and (parts := self._split(t, i)):
                self.left[i], self.right[i] = parts
        made = np.flatnonzero(self.left >= 0)
        keys = self.left[made] * n + self.right[made]
        order = np.argsort(keys)
        self._keys, self._made = keys[order], self.rank[made[order]]
        ok = np.ones(n, bool)
        ok[made] = self._meet(self.left[made], self.right[made], self.rank[made], self.rank[made])
        self.stable = np.array([len(t) == 1 for t in self.tokens])
        for i in made[np.argsort(self.rank[made])].tolist():
            self.stable[i] = ok[i] and self.stable[self.left[i]] and self.stable[self.right[i]]
        self.pairs: dict[tuple[int, int], int] = dict(zip(zip(self.left[made].tolist(), self.right[made].tolist(), strict=True), made.tolist(), strict=True))
        self.known = {t: i for t, i in self.ids.items() if self.stable[i]}
        self.prefixes = {t[:k] for t in self.known for k in range(1, len(t) + 1)}
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.guessed = self.merged = 0

    def _split(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what merges of lower rank leave of its bytes."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(parts[k] + parts[k + 1], limit)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = (self.ids.get(p, -1) for p in parts)
        return (a, b) if a >= 0 and b >= 0 else None

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], _FAR)

    def _meet(self, a: np.ndarray, b: np.ndarray, next_a: np.ndarray, next_b: np.ndarray) -> np.ndarray:
        """Whether nothing merges across the border of a and b before their own merges at the ranks given.

        Equal ranks merge from the left: a's own merge lies left of the border and comes first, b's after."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y, nx, ny = a.copy(), b.copy(), next_a.astype(np.int64).copy(), next_b.astype(np.int64).copy()
        while len(at):
            r = self._merge_rank(x, y)
            crossed = (r < nx) & (r <= ny)
            out[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            live = ~crossed & ((rx > 0) | (ry > 0))
            at, x, y, nx, ny, rx, ry = (v[live] for v in (at, x, y, nx, ny, rx, ry))
            undo = rx > ry  # the later one; of equal ones the right, which was made last
            nx, ny = np.where(undo, rx, nx), np.where(undo, ny, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each a followed by each b encodes to just these two."""
        far = np.full(len(a), _FAR)
        return self._meet(a, b, far, far)

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match over tokens that encode to themselves."""
        if (i := self.known.get(word)) is not None:
            return [i]
        out, at, n = [], 0, len(word)
        while at < n:
            end, k = at + 1, at + 1
            while k <= n and word[at:k] in self.prefixes:
                if word[at:k] in self.known:
                    end = k
                k += 1
            out.append(self.known[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact: the lowest-ranked pair first, of equal ones the leftmost."""
        n = len(word)
        tok = [self.ids[word[k : k + 1]] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p], k) for k in range(n - 1) if (p := (tok[k], tok[k + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            made, k = heapq.heappop(heap)
            j = after[k] if tok[k] >= 0 else n
            if j >= n or self.pairs.get((tok[k], tok[j])) != made:
                continue
            tok[k], tok[j] = made, -1
            after[k] = e = after[j]
            if e < n:
                before[e] = k
                if (p := (made, tok[e])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p], k))
            if (b := before[k]) >= 0 and (p := (tok[b], made)) in self.pairs:
                heapq.heappush(heap, (self.pairs[p], b))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Each word's ids: guesses, all neighbours checked at once, and merging where the check fails."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.guess(w) for w in raw]
        size = np.array([len(x) for x in ids])
        flat = np.array([t for x in ids for t in x], np.int64)
        word = np.repeat(np.arange(len(ids)), size)
        inner = np.flatnonzero(word[1:] == word[:-1])
        failed = np.unique(word[inner[~self.compatible(flat[inner], flat[inner + 1])]]).tolist()
        self.guessed += len(ids)
        self.merged += len(failed)
        for k in failed:
            ids[k] = self.merge(raw[k])
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; empty for empty and null texts."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > _MOST:
            self.cache.clear()
        cache_ = self.cache
        new = list({w for c in cut for w in c if w not in cache_})
        found = self.encode_words(new) if new else []
        once = {}
        for w, i in zip(new, found, strict=True):
            (cache_ if len(w) <= _LONGEST_KEPT else once)[w] = tuple(i)
        out = []
        for c in cut:
            ids: list[int] = []
            for w in c:
                ids += cache_[w] if w in cache_ else once[w]
            out.append(ids)
        return out


@cache
def encoder(folder: str = FOLDER, name: str = NAME) -> Encoder:
    return Encoder(f"{folder}/{name}.tiktoken")


#: Characters encoded at a time, so that a task's memory does not follow the batch.
_CHARS = 1 << 20


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts.to_pylist():
        part.append(t)
        size += len(t) if t else 0
        if size > _CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(df: DataFrame, *, id_: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``id, ids ARRAY<INT>`` of every row.  Null and empty texts: the empty list.  Strings of special tokens
    are ordinary text.  Repeated rows each come out; texts of any length are encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            at = 0
            for part in _parts(b["text"]):
                ids = e.encode(part)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["id", "ids"])
                at += len(part)

    return spread(df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"))).mapInArrow(run, "id bigint, ids array<int>")


def counted(df: DataFrame, *, id_: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``id, n``: how many tokens each row's text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            n = [len(x) for part in _parts(b["text"]) for x in e.encode(part)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64())], ["id", "n"])

    return spread(df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"))).mapInArrow(run, "id bigint, n bigint")
