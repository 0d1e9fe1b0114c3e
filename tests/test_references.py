from datetime import datetime as T

from pyspark.sql import functions as F

from siftline.functions import bloom
from siftline.operators import references as R

CHILD = "id bigint, ref string, at timestamp_ntz, key string, spans string, _maybe int"
PARENT = "code string, a timestamp_ntz, b timestamp_ntz, ref_id string"


def run(spark, children, parents, **more):
    c = spark.createDataFrame([(*r, "x", "y", 1) for r in children], CHILD)
    p = spark.createDataFrame([(*r, "z") for r in parents], PARENT)
    out = R.orphans(c, p, child_id="id", child_key=R.numbers(F.col("ref")), at="at", parent_key=R.numbers(F.col("code")), valid_from="a", valid_to="b", **more)
    return sorted(tuple(r) for r in out.select("ref_id", "ref_key", "reason").collect())


def test_reasons_periods_and_spellings(spark, monkeypatch):
    parents = [("CWE-0010", T(2020, 1, 1), T(2021, 1, 1)), ("10", T(2022, 1, 1), None), ("k 20", T(2022, 1, 1), None), ("30", None, None), ("40", T(2023, 1, 1), T(2022, 1, 1)), (None, T(2000, 1, 1), None)]
    children = [
        (1, "10", T(2020, 1, 1)), (2, "CWE-010", T(2021, 1, 1)), (3, "10", T(2030, 1, 1)), (4, "20", T(2021, 1, 1)), (5, "30", T(2024, 1, 1)), (6, "40", T(2024, 1, 1)), (7, "99 and 10", T(2022, 5, 1)),
        (8, None, T(2022, 1, 1)), (9, "none", T(2022, 1, 1)), (10, "20", None), (4, "20", T(2021, 1, 1)), (11, "99999999999999999999999", T(2022, 1, 1)), (12, "", None),
    ]
    want = [(2, "10", "gap"), (4, "20", "later"), (5, "30", "missing"), (6, "40", "missing"), (7, "99", "missing"), (10, "20", "gap"), (11, "99999999999999999999999", "missing")]
    assert run(spark, children, parents) == want
    assert run(spark, children, parents, bits=64) == want  # a full filter only sends more to the join
    monkeypatch.setattr(R.joins, "BROADCAST_BYTES", -1)
    assert run(spark, children, parents) == run(spark, children, parents, block=1) == want


def test_ended_and_overlapping(spark):
    parents = [("1", T(2020, 1, 1), T(2022, 1, 1)), ("1", T(2021, 1, 1), T(2023, 1, 1)), ("1", T(2020, 6, 1), T(2020, 7, 1)), ("1", T(2020, 1, 1), T(2022, 1, 1))]
    assert run(spark, [(1, "1", T(2022, 6, 1)), (2, "1", T(2023, 1, 1)), (3, "1", T(2019, 1, 1))], parents) == [(2, "1", "ended"), (3, "1", "later")]


def test_empty_tables(spark):
    assert run(spark, [], [("1", T(2020, 1, 1), None)]) == []
    assert run(spark, [(1, "1", T(2020, 1, 1))], []) == [(1, "1", "missing")]


def test_hot_key(spark):
    children = [(i, "7", T(2020, 1, 1 + i % 28)) for i in range(3000)]
    assert len(run(spark, children, [("7", T(2020, 1, 15), None)])) == sum(1 for i in range(3000) if 1 + i % 28 < 15)


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(0, 20000, 7).withColumn("h", F.xxhash64("id"))
    bits = bloom.bits_for(keys.count())
    words = bloom.build(keys, F.col("h"), bits)
    filter_ = bloom.dense(words, bits).scalar()
    every = spark.range(0, 20000).withColumn("hit", bloom.might_contain(filter_, F.xxhash64("id"), bits))
    assert every.where("id % 7 = 0 AND NOT hit").count() == 0
    assert every.where("id % 7 <> 0 AND hit").count() < 600
    got = bloom.hits(bloom.collect(words, bits), every.select(F.xxhash64("id")).toPandas().iloc[:, 0].to_numpy())
    assert got.sum() == every.where("hit").count()
