import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().ids, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().ids, special_tokens={})
    assert bpe.encoder().encode([text])[0] == enc.encode_ordinary(text)


def test_words_of_repeated_and_rare_parts(exact):
    rng = random.Random(4)
    parts = ["a", "aa", "ab", "the", "in", "ing", "er", "_", "  ", "x", "é", "00", "==", "----", "日本", "\U0001f512", "<|endoftext|>", "\r\n", "'s", "\xad", "zzzz"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    assert bpe.encoder().encode(words) == [exact.encode_ordinary(w) for w in words]


def test_pairs_are_judged_alike_by_merging():
    e, rng = bpe.encoder(), random.Random(9)
    pairs = [(rng.randrange(len(e.tokens)), rng.randrange(len(e.tokens))) for _ in range(6000)] + [(rng.randrange(256), rng.randrange(256)) for _ in range(3000)]
    pairs += [(int(e.left[i]), int(e.right[i])) for i in range(256, 3000)] + [(i, i) for i in range(3000)]
    a, b = zip(*pairs, strict=True)
    import numpy as np

    got = e.compatible(np.array(a), np.array(b))
    assert got.tolist() == [e.merge(e.tokens[x] + e.tokens[y]) == [x, y] for x, y in pairs]


def test_guesses_and_merging_both_happen(exact):
    e = bpe.encoder()
    before = (e.guessed, e.merged)
    e.cache.clear()
    e.encode([" committed lookupRawBasket44 xqzjv unbelievably"])
    assert e.guessed > before[0] and e.merged > before[1] and e.guessed - before[0] > e.merged - before[1]


def test_long_words(exact):
    for w in ("a" * 60000, " " * 50001, "ab" * 20000, "-" * 30000 + "="):
        assert bpe.encoder().encode([w])[0] == exact.encode_ordinary(w)


def test_table(spark, exact):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (5, "a\n" * 40000, "x"), (1, "hello world", "x")], "k bigint, body string, ids string")
    got = sorted((r.id, r.ids) for r in bpe.encoded(df, id_="k", text="body").collect())
    assert got == sorted([(1, exact.encode_ordinary("hello world"))] * 2 + [(2, []), (3, []), (4, exact.encode_ordinary(" ")), (5, exact.encode_ordinary("a\n" * 40000))])
    assert dict(bpe.encoded(df, id_="k", text="body").dtypes)["ids"] == "array<int>"
    assert {r.id: r.n for r in bpe.counted(df, id_="k", text="body").collect()} == {i: len(x) for i, x in got}
    assert bpe.encoded(df.limit(0), id_="k", text="body").count() == 0


def test_documents_equal_the_reference_encoder(spark, exact, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    text = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for r in bpe.encoded(df, id_="doc_id", text="text").collect():
        assert r.ids == (exact.encode_ordinary(text[r.id]) if text[r.id] else [])


def test_best_fit_by_hand():
    b = packing.Bins(10, 2)
    assert [b.put(x) for x in (6, 3, 7)] == [0, 0, 1]  # 3 goes beside 6
    assert b.put(3) == 1  # fits exactly: closed
    assert [b.put(x) for x in (8, 9)] == [2, 3]  # two were open: the fullest closed for 9
    assert b.put(2) == 2 and b.put(1) == 3


def test_bins_never_overflow_and_waste_little():
    rng = random.Random(6)
    b, used, items = packing.Bins(2048, 64), {}, [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(40000)]
    for x in items:
        k = b.put(x)
        used[k] = used.get(k, 0) + x
        assert used[k] <= 2048 and b.count <= 64
    assert len(used) < sum(items) / 2048 * 1.02 + 64


@pytest.mark.parametrize("per_task", [4096, 3])
def test_containers(spark, per_task):
    rng = random.Random(8)
    rows = [(i, int(rng.lognormvariate(3, 1.2))) for i in range(3000)] + [(5000, 950), (5001, 1000), (5002, 100), (5003, 0), (5004, None), (5005, -3), (0, 7)]
    df = spark.createDataFrame(rows, "k bigint, n bigint").repartition(6)
    once = packing.packed(df, id_="k", n="n", capacity=100, most=8, per_task=per_task)
    got = once.collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.start, r.n))
    for i, n in rows[1:-1]:
        parts = sorted(by.get(i, []))
        assert sum(p[1] for p in parts) == max(n or 0, 0)
        assert [p[0] for p in parts] == [100 * k for k in range(len(parts))] and (n is None or n > 100 or len(parts) == (n > 0))
    fill = packing.fill(once, 100).collect()
    assert all(r.n <= 100 for r in fill)
    total = sum(max(n or 0, 0) for _, n in rows)
    assert len(fill) <= total / 100 * (1.1 if per_task == 4096 else 1.6) + 8
    again = packing.packed(df.repartition(3), id_="k", n="n", capacity=100, most=8, per_task=per_task)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_no_items(spark):
    assert packing.packed(spark.createDataFrame([], "k bigint, n bigint"), id_="k", n="n").count() == 0
