import random
from collections import deque

from siftline.operators import graph


def made(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2400)] + [(7, 7), (None, 3), (3, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "x bigint, y bigint"), "x", "y").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    assert got == {x: min(g) for g in want.values() for x in g}


def test_reach_and_paths(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)})
    e = made(spark, pairs + pairs[:5] + [(None, "n1")])
    starts = spark.createDataFrame([("n1",), ("n2",), ("alone",)], "s string")
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want, todo = {"n1": 0, "n2": 0, "alone": 0}, deque(["n1", "n2", "alone"])
    while todo:
        x = todo.popleft()
        for y in out.get(x, ()):
            if y not in want:
                want[y] = want[x] + 1
                todo.append(y)
    assert {r.node: r.depth for r in graph.reach(e, starts).collect()} == want
    paths = {(r.start, r.node): r.path for r in graph.first_paths(e, starts).collect()}
    for (s, n), p in paths.items():
        assert p[0] == s and p[-1] == n and all((a, b) in set(pairs) for a, b in zip(p, p[1:], strict=False))
    assert {n for _, n in paths} == set(want) and min(len(p) for (s, n), p in paths.items() if n in want) == 1
    assert all(min(len(p) for (s, m), p in paths.items() if m == n) - 1 == d for n, d in want.items())
    below = {(r.start, r.node) for r in graph.closure(e, starts).collect()}
    assert {n for s, n in below if s == "n1"} >= {n for (s, n) in paths if s == "n1"} - {"n1"}


def test_cycles(spark):
    assert graph.cyclic(made(spark, [("a", "b"), ("b", "c"), ("a", "c")])).count() == 0
    assert {r.node for r in graph.cyclic(made(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])).collect()} == {"a", "b"}
    assert graph.statistics(made(spark, [("a", "b"), ("b", "b"), ("a", "b")])).first().asDict() == {"n_nodes": 2, "n_edges": 2, "is_dag": False}


def test_simple_paths(spark):
    e = made(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y")])
    got = {tuple(r.path) for r in graph.simple_paths(e, spark.createDataFrame([("a",)], "n string"), spark.createDataFrame([("d",)], "n string")).collect()}
    assert got == {("a", "c", "d"), ("a", "b", "c", "d")}


def test_taint(spark):
    e = made(spark, [("fgets", "read_line"), ("read_line", "work"), ("work", "strcpy"), ("argv", "a"), ("a", "b"), ("b", "work"), ("other", "x")])
    got = {r.target: (r.source, r.sink, r.taint_path) for r in graph.tainted(e, spark.createDataFrame([("work",), ("x",), (None,)], "f string"), "f").collect()}
    assert got == {"work": ("fgets", "strcpy", ["fgets", "read_line", "work", "strcpy"])}


def test_long_chain(spark):
    e = made(spark, [(f"n{i}", f"n{i + 1}") for i in range(70)])
    paths = {r.node: r.path for r in graph.first_paths(e, spark.createDataFrame([("n0",)], "s string")).collect()}
    assert paths == {f"n{k}": [f"n{i}" for i in range(k + 1)] for k in range(71)}


def test_empty(spark):
    none = made(spark, [])
    starts = spark.createDataFrame([], "s string")
    assert graph.components(none, "src", "dst").count() == graph.reach(none, starts).count() == graph.closure(none, starts).count() == graph.cyclic(none).count() == 0
