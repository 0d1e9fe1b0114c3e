"""Operators on groups that hold most rows, against plain loops."""

import random

from pyspark.sql import functions as F

from siftline.operators import dataset, metrics, rules


def test_first_after(spark):
    rng = random.Random(2)
    left = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.randrange(3000)) for i in range(600)]
    right = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(3000), i, rng.randrange(50)) for i in range(900)]
    got = {r.i: (r.line, r.n) for r in rules.first_after(spark.createDataFrame(left, "k string, i int, t int"), spark.createDataFrame(right, "k string, line int, n int, o int"), ["k"], ["i"], "t", "line", "o", lambda t: F.floor(t / 500)).collect()}
    want = {}
    for k, i, t in left:
        later = [(o, line, n) for kk, line, n, o in right if kk == k and line > t]
        if later:
            o, line, n = min(later)
            want[i] = (line, n)
    assert got == want


def test_smallest(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(5000)]
    t = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (1, 17, 2500, 5000):
        assert dataset.smallest(t, F.col("v"), k, 64) == sorted(values)[k - 1]
    assert dataset.smallest(t, F.col("v"), 5001, 64) == 1.0 and dataset.smallest(t.limit(0), F.col("v"), 1) == 1.0


def test_same_whatever_the_partitioning(spark):
    t = spark.range(3000).select("id", (dataset.uniform(F.col("id"), "s")).alias("s"), (dataset.uniform(F.col("id"), "y") < 0.4).cast("int").alias("y"))
    for f in (lambda d: metrics.roc(d, "y", "s"), lambda d: metrics.areas(d, "y", "s"), lambda d: dataset.weak_labels(d, "s", "moderate", "id"), lambda d: dataset.split(d, ["y"], "id")):
        one = sorted(map(tuple, f(t.repartition(1)).collect()))
        assert one == sorted(map(tuple, f(t.repartition(16)).collect())) and one


def test_roc_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(40) / 40) for _ in range(700)]
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    got = {r.score: (r.tpr, r.fpr) for r in metrics.roc(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()}
    for s, (tpr, fpr) in got.items():
        assert abs(tpr - sum(y for y, x in rows if x >= s) / p) < 1e-6 and abs(fpr - sum(1 - y for y, x in rows if x >= s) / n) < 1e-6
    auc = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z) / (p * n)
    assert abs(metrics.areas(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().auc - auc) < 1e-6
