"""Near-duplicates and overlaps against all pairs, with hot groups, copies, nulls and clashing names."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import near_duplicates, sets, shingles, split_overlap

WORDS = [f"w{i}" for i in range(300)]


def brute(codes, num, den, pair):
    s = {}
    for i, (tag, text) in codes.items():
        w = re.findall("[A-Za-z0-9_]+", text or "", re.ASCII)
        if text is not None and tag is not None and len(w) >= 20:
            s[i] = (tag, frozenset(zip(w, w[1:], w[2:], strict=False)))
    ids, out = sorted(s), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if pair(s[a][0], s[b][0]):
                k = len(s[a][1] & s[b][1])
                if k * den >= num * (len(s[a][1]) + len(s[b][1]) - k):
                    out.add((a, b))
    return out


def corpus(seed, n, tags):
    """A third are edits of one text; others copies, edits, reorderings, short, empty, null."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(150)]
    licence = [f"licence{i}" for i in range(40)]
    out, texts = {}, []
    for i in range(n):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        elif i % 3 == 1 and texts:
            w = list(rng.choice(texts))
            kind = rng.randrange(4)
            if kind == 0:
                for _ in range(rng.randint(1, 12)):
                    w.insert(rng.randrange(len(w) + 1), rng.choice(WORDS))
            elif kind == 1:
                k = rng.randrange(len(w) or 1)
                w = w[k:] + w[:k]
            elif kind == 2:
                del w[: rng.randint(0, 10)]
        else:
            w = licence * (rng.random() < 0.5) + [rng.choice(WORDS) for _ in range(rng.choice([5, 19, 20, 25, 60, 200, 400]))]
        texts.append(w)
        sep = rng.choice([" ", "\n", "; ", "(é)"])
        text = None if i % 41 == 0 else "" if i % 43 == 0 else sep.join(w)
        out[i] = (rng.choice(tags), text)
    return out


def test_words_and_shingles_equal_a_plain_count():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "9", "_", " ", "\n", "é", "-", "日", "xyz "]) for _ in range(rng.randint(0, 300))) for _ in range(300)] + [None, "", "word" * 400000, "a b " * 300000]
    got, begin = shingles.shingles(pa.array(texts), 3, 20)
    for i, t in enumerate(texts):
        w = re.findall("[A-Za-z0-9_]+", t or "", re.ASCII)
        assert begin[i + 1] - begin[i] == (len(set(zip(w, w[1:], w[2:], strict=False))) if len(w) >= 20 else 0)
        assert (np.diff(got[begin[i] : begin[i + 1]].astype(np.int64)) > 0).all()
    again, at = shingles.shingles(pa.array([None, *texts])[1:], 3, 20)
    assert (again == got).all() and (at == begin).all()


@pytest.mark.parametrize(("block", "known"), [(8, 1 << 16), (8, 0), (4096, 1 << 16)])
def test_near_duplicates_equal_all_pairs(spark, block, known, monkeypatch):
    monkeypatch.setattr(near_duplicates, "MOST_FREQUENT", known)  # with 0, large cells are only met while they are walked
    codes = corpus(7, 330, ["c", "C ", "go", None])
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (g, t) in codes.items()], "id bigint, code string, tag string, cls string, n int")
    rows, links = near_duplicates.near_duplicates(df.repartition(5), id_="id", text="code", tag=F.lower(F.trim("tag")), block=block)
    got = {tuple(r) for r in sets.expanded(links, rows).collect()}
    norm = {i: (g.strip().lower() if g else None, t) for i, (g, t) in codes.items()}
    assert got == brute(norm, 3, 4, lambda a, b: a == b) and len(got) > 1000
    groups = near_duplicates.groups(rows, links).collect()
    assert len(groups) == rows.count() and len({r.id for r in groups}) == len(groups)
    group = {r.id: r.group_id for r in groups}
    assert all(group[a] == group[b] for a, b in got) and all(r.group_id <= r.class_id <= r.id for r in groups)


@pytest.mark.parametrize(("in_filter", "block"), [(1 << 20, 4096), (700, 5)])
def test_overlaps_equal_all_pairs(spark, in_filter, block):
    codes = corpus(11, 330, ["train", "train", "train", "test", "val", "other", None])
    df = spark.createDataFrame([(i, t, g, "s", "x") for i, (g, t) in codes.items()], "id bigint, raw string, split string, source string, text string")
    found = split_overlap.overlaps(df.repartition(5), id_="id", text="raw", split="split", in_filter=in_filter, block=block)
    got = {tuple(r) for r in split_overlap.pairs(*found).collect()}
    side = {"train": "t", "test": "e", "val": "e"}
    want = brute({i: (side.get(g), t) for i, (g, t) in codes.items()}, 4, 5, lambda a, b: a != b)
    assert got == want and len(got) > 500
    per = {r.id: r for r in split_overlap.matches(*found).collect()}
    for i, r in per.items():
        assert r.n_rows == sum(i in p for p in want)
    total = split_overlap.report(df, split_overlap.matches(*found), "id", "split", F.col("source")).agg(F.sum("n_pairs")).first()[0]
    assert total == len(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, code string, tag string")
    rows, links = near_duplicates.near_duplicates(df, id_="id", text="code", tag=F.col("tag"))
    assert rows.count() == links.count() == near_duplicates.groups(rows, links).count() == 0
    assert split_overlap.pairs(*split_overlap.overlaps(df, id_="id", text="code", split="tag")).count() == 0


def test_banded_distance_of_long_and_empty_strings():
    a, b = np.arange(0, 3000, 2), np.arange(0, 3000, 3)
    d = len(set(a.tolist()) ^ set(b.tolist()))
    assert split_overlap.banded([a, a[:0], a], [b, b[:5], b[:0]], np.array([d, 10, 2000])).tolist() == [d, 5, 1500]


@pytest.mark.parametrize(("num", "den", "most"), [(4, 5, 2000), (3, 4, 1500), (2, 3, 900), (99, 100, 40_000), (499, 500, 60_000)])
def test_segments_cover_a_string_and_are_enough(num, den, most):
    rng = random.Random(num)
    known = split_overlap.lengths(num, den)
    for n in [*range(1, 300), *(rng.randrange(1, most) for _ in range(300))]:
        which, start, size = split_overlap.segments(np.array([n]), num, den)
        assert size.sum() == n and (size > 0).all() and len(size) == split_overlap.most_edits(np.array([n]), np.array([den * n // num]), num, den)[0] + 1
        assert set(size.tolist()) <= {x for x, longest in known.items() if not longest or n <= longest}


def test_all_lengths_of_a_high_likeness():
    known = split_overlap.lengths(999, 1000)
    n = np.arange(1, 6_000_000, dtype=np.int64)
    m = split_overlap.most_edits(n, 1000 * n // 999, 999, 1000) + 1
    assert {*np.unique(n // m).tolist(), *np.unique(-(-n // m)).tolist()} == set(known)


def test_banded_walks_strings_of_any_length():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 40, 9500))
    b = np.union1d(np.delete(a, rng.choice(len(a), 40, replace=False)), rng.integers(0, 1 << 40, 35))
    d = len(np.setxor1d(a, b))
    most = split_overlap.most_edits(np.array([len(a)]), np.array([len(b)]), 4, 5)
    assert split_overlap.banded([a], [b], np.minimum(most, 400)).tolist() == [d]
    assert split_overlap.banded([a], [np.unique(rng.integers(0, 1 << 40, 9500))], np.array([50]))[0] > 50


def test_tags_are_compared_whole():
    a, b = sets.tag_hashes(pa.array(["x" + "y" * 500, "z" + "y" * 500]))
    assert a != b


def test_a_text_and_a_shingle_in_half_of_all_rows(spark):
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(60))
    texts = {i: hot if i % 2 else hot + " " + " ".join(rng.choice(WORDS) for _ in range(rng.choice([8, 40, 300]))) for i in range(240)}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "id bigint, code string, tag string")
    rows, links = near_duplicates.near_duplicates(df.repartition(6), id_="id", text="code", tag=F.col("tag"), block=16)
    assert {tuple(r) for r in sets.expanded(links, rows).collect()} == brute({i: ("c", t) for i, t in texts.items()}, 3, 4, lambda a, b: a == b)


def test_two_texts_under_one_id(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, one, "c"), (1, two, "c"), (2, one + " more", "c"), (3, two + " more", "c")], "id bigint, code string, tag string")
    rows, links = near_duplicates.near_duplicates(df, id_="id", text="code", tag=F.col("tag"))
    assert {tuple(r) for r in sets.expanded(links, rows).collect()} == {(1, 2), (1, 3)}
