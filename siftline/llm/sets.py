"""Rows as sets of word shingles: one row a text, one class a distinct set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bloom
from ..operators import joins
from ..session import cut, spread
from . import shingles as S

#: Coarse segments of the popcount embedding: the hash space is cut into so many equal parts.
SEGMENTS = 32
#: Pairs of one text beyond which its set is moved in several copies.
PAIRS = 4096

ROWS = "id bigint, cls binary, c bigint, n int, vec array<int>, tag string"


def prepared(df: DataFrame, id_: str, text: str, tag: Column) -> DataFrame:
    """The columns needed, under fixed names; null texts are left out, so is a null tag."""
    return spread(df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"), tag.alias("tag")).where("text IS NOT NULL AND tag IS NOT NULL AND id IS NOT NULL"))


def tag_hashes(tags: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole tag."""
    d = pc.dictionary_encode(tags)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    known = np.array([int.from_bytes(hashlib.blake2b(str(x).encode("utf-8"), digest_size=8).digest(), "little") for x in d.dictionary.to_pylist()] or [0], np.uint64)
    return known[d.indices.to_numpy()] if len(tags) else np.zeros(0, np.uint64)


def classes(sets: np.ndarray, begin: np.ndarray, tags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row, equal for rows of equal tag and equal set: 128 bits, and the first 64 of them."""
    tag = tag_hashes(tags)
    both = np.stack([S.mix(S.set_ids(sets, begin) ^ tag), S.mix(S.set_ids(sets, begin, 0x2545F4914F6CDD1D) + tag)], axis=1)
    return both, both[:, 0].astype(np.int64)


def fresh(both: np.ndarray, n: np.ndarray, seen: set[bytes]) -> np.ndarray:
    """Rows with a set whose class is not in ``seen``, the first of each, which are added."""
    new = []
    for r in np.flatnonzero(n).tolist():
        if (c := both[r].tobytes()) not in seen:
            seen.add(c)
            new.append(r)
    return np.array(new, np.int64)


def popcounts(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per row, how many of its shingles lie in each coarse segment of the hash space."""
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    cell = rows * SEGMENTS + (sets >> np.uint64(S.BITS - 5)).astype(np.int64)
    return np.bincount(cell, minlength=(len(begin) - 1) * SEGMENTS).reshape(-1, SEGMENTS)


assert SEGMENTS == 1 << 5


def binary(both: np.ndarray) -> pa.Array:
    """128-bit classes as a column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(np.ascontiguousarray(both))]).cast(pa.binary())


def row_batch(b: pa.RecordBatch, sets: np.ndarray, begin: np.ndarray) -> dict[str, pa.Array]:
    """The columns of ``ROWS`` for the rows of a batch that have shingles."""
    keep = np.flatnonzero(np.diff(begin))
    both, c = classes(sets, begin, b["tag"])
    vec = popcounts(sets, begin)[keep].astype(np.int32)
    return {
        "id": b["id"].take(pa.array(keep)).cast(pa.int64()),
        "cls": binary(both[keep]),
        "c": pa.array(c[keep]),
        "n": pa.array(np.diff(begin)[keep].astype(np.int32)),
        "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * SEGMENTS), pa.array(vec.ravel())),
        "tag": b["tag"].take(pa.array(keep)).cast(pa.string()),
    }


def rows_of(df: DataFrame, width: int, least: int) -> DataFrame:
    """From ``prepared``: ``ROWS`` of each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, begin = S.shingles(b["text"], width, least)
            cols = row_batch(b, sets, begin)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return df.mapInArrow(run, ROWS)


def representatives(rows: DataFrame) -> DataFrame:
    """One row a class: ``cls, c, n, vec, rep`` with the smallest id."""
    return rows.groupBy("cls", "c", "n").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"))


def with_sets(pairs: DataFrame, prepared_: DataFrame, width: int, least: int, block: int = PAIRS) -> DataFrame:
    """``pairs`` (of ``rep_a, rep_b, cls_a, cls_b``, a table already cut) with the two sides' sorted shingles, ``set_a`` and
    ``set_b``.

    A Bloom filter of the ids asked for, of bounded size, thins the scan before any text reaches Python; ids
    that pass it by chance do no harm, as the joins are exact.  Each pair asks for two sets and then gets its two
    sides together; a text asked for by very many pairs is dealt out in blocks."""
    keep = [c for c in pairs.columns if c not in ("rep_a", "rep_b")]
    both = F.array(F.struct(F.col("rep_a").alias("id"), F.lit(0).alias("side")), F.struct(F.col("rep_b").alias("id"), F.lit(1).alias("side")))
    asked = pairs.select("rep_a", "rep_b", *keep, F.explode(both).alias("x")).select("rep_a", "rep_b", *keep, "x.id", "x.side", F.xxhash64("rep_a", "rep_b").alias("_by"))
    bits = bloom.bits_for(2 * pairs.count())
    filter_ = bloom.dense(bloom.build(asked, F.xxhash64("id"), bits), bits).scalar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, begin = S.shingles(b["text"], width, least)
            listed = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b["id"].cast(pa.int64()), binary(classes(sets, begin, b["tag"])[0]), listed], ["id", "cls", "shingles"])

    whole = prepared_.where(bloom.might_contain(filter_, F.xxhash64("id"), bits)).mapInArrow(run, "id bigint, cls binary, shingles array<bigint>")
    # of several texts under one id, that of the class asked for
    joined = joins.with_unique(asked, whole, "id", "_by", block).where(F.col("cls") == F.when(F.col("side") == 0, F.col("cls_a")).otherwise(F.col("cls_b")))
    side = lambda k: F.first(F.when(F.col("side") == k, F.col("shingles")), ignorenulls=True)
    return joined.groupBy("rep_a", "rep_b", *keep).agg(side(0).alias("set_a"), side(1).alias("set_b"))


def expanded(links: DataFrame, rows: DataFrame) -> DataFrame:
    """``id_a, id_b``, the smaller first: all pairs of rows of linked classes (``cls_a, cls_b``) and within classes."""
    several = rows.groupBy("cls").agg(F.count("*").alias("k")).where("k > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    both = joins.members(links.select("cls_a", "cls_b").unionByName(several), "cls_a", "cls_b", rows, rows, "cls", "id")
    return both.select(F.least("member_a", "member_b").alias("id_a"), F.greatest("member_a", "member_b").alias("id_b"))
