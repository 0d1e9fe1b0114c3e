"""Connected components by repeated minimum with pointer jumping."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node in a link; the component is its smallest node.

    Rows with a null end and links of a node to itself are ignored; repeated links count once.  Each round
    moves every edge's larger end to the smallest neighbour (large-star, then small-star), so a chain of n
    nodes takes about log2(n) rounds; each round is written to the checkpoint folder.  Hubs are safe: only
    minima are gathered, never a node's list of neighbours.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut(edges)
    before = None
    for _ in range(rounds):
        # large-star: every neighbour above u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: every neighbour below u, and u, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def edges(calls: DataFrame, src: str, dst: str, line: str | None = None, order: str | None = None) -> DataFrame:
    """``src, dst, line, n_calls``: parallel calls are one edge; of their lines the last in order counts."""
    rows = calls.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    last = F.max_by(line, order).alias("line") if line else F.lit(None).cast("int").alias("line")
    return rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(last, F.count("*").alias("n_calls"))


def reach(edges_: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """``node, depth``: the fewest steps from any start, itself 0; unreached nodes are missing, and with ``most``
    those of that depth or more.

    One round a depth: the frontier joins the edges, and what was seen before is left out; a round is written
    to the checkpoint folder, partitioned like the edges.  Starts need not have edges."""
    e = cut(edges_.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s IS NOT NULL AND _d IS NOT NULL").distinct())
    seen = front = cut(starts.select(F.col(starts.columns[0]).alias("node")).where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most) if most else count(1):
        step = e.join(front.select("node"), e["_s"] == F.col("node")).select(F.col("_d").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 10 == 0:
            seen = cut(seen)
    return seen


def first_paths(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node, path``: of the shortest paths from each start to each node the first in order of nodes.

    Only the best path to each node is kept, so a round holds at most starts times nodes rows."""
    e = cut(edges_.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s IS NOT NULL AND _d IS NOT NULL").distinct())
    seen = front = cut(starts.select(F.col(starts.columns[0]).alias("start")).where("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    for k in count(1):
        step = front.join(e, front["node"] == e["_s"]).select("start", F.col("_d").alias("node"), F.concat("path", F.array("_d")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        front = cut(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 10 == 0:
            seen = cut(seen)


def simple_paths(edges_: DataFrame, starts: DataFrame, ends: DataFrame, most: int = 8) -> DataFrame:
    """``path``: all paths of at most ``most`` edges from a start to an end that visit no node twice.

    Their number is that of the answer itself; nodes from which no end can be reached in the steps left are
    dropped in every round."""
    e = cut(edges_.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s IS NOT NULL AND _d IS NOT NULL AND _s <> _d").distinct())
    back = reach(e.select(F.col("_d").alias("src"), F.col("_s").alias("dst")), ends, most=most + 1)
    left = cut(back.select(F.col("node").alias("_n"), F.col("depth").alias("_left")))
    end = cut(ends.select(F.col(ends.columns[0]).alias("_e")).distinct())
    front = starts.select(F.col(starts.columns[0]).alias("node")).distinct().select("node", F.array("node").alias("path"))
    out = None
    for k in range(1, most + 1):
        step = front.join(e, front["node"] == e["_s"]).where(~F.array_contains("path", F.col("_d"))).select(F.col("_d").alias("node"), F.concat("path", F.array("_d")).alias("path"))
        front = cut(step.join(left, step["node"] == left["_n"]).where(F.col("_left") <= most - k).select("node", "path"))
        if front.isEmpty():
            break
        found = front.join(end, front["node"] == end["_e"], "left_semi").select("path")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else front.select("path").limit(0)


def closure(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node``: all nodes below each start, the start itself only if it lies on a cycle."""
    e = cut(edges_.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s IS NOT NULL AND _d IS NOT NULL").distinct())
    s = starts.select(F.col(starts.columns[0]).alias("start")).where("start IS NOT NULL").distinct()
    seen = front = cut(s.join(e, F.col("start") == F.col("_s")).select("start", F.col("_d").alias("node")).distinct())
    for k in count(1):
        step = front.join(e, front["node"] == e["_s"]).select("start", F.col("_d").alias("node")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 10 == 0:
            seen = cut(seen)


def cyclic(edges_: DataFrame) -> DataFrame:
    """``node``: nodes on a cycle or between two. Empty exactly if the graph has no cycle.

    Nodes without a caller or without a callee are peeled off, round by round."""
    e = cut(edges_.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = e.count()
    while True:
        e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if (left := e.count()) == n:
            break
        n = left
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def statistics(edges_: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, is_dag``."""
    pairs = edges_.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    dag = cyclic(edges_).isEmpty()
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(pairs.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.count_if(F.col("n") == 1).alias("n_nodes"), F.count_if(F.col("e") == 1).alias("n_edges")).withColumn("is_dag", F.lit(dag))


# Where taint comes from, and where it does harm, in the order they are tried.
TAINT_SOURCES = ["argv", "stdin", "getenv", "recv", "read", "fgets", "scanf"]
TAINT_SINKS = ["strcpy", "gets", "sprintf", "system", "printf", "memcpy", "exec", "popen"]


def tainted(edges_: DataFrame, targets: DataFrame, target: str, sources: list[str] = TAINT_SOURCES, sinks: list[str] = TAINT_SINKS) -> DataFrame:
    """``target, source, sink, taint_path`` of every target that a source reaches: the shortest path over the
    sources, of equal ones the first source; then on to the first sink in order that the target is or reaches."""
    spark = edges_.sparkSession
    listed = lambda x: spark.createDataFrame([(s, i) for i, s in enumerate(x)], "name string, ord int")
    down = first_paths(edges_, listed(sources).select("name"))
    names = targets.select(F.col(target).alias("target")).where("target IS NOT NULL").distinct()
    found = down.join(names, down["node"] == names["target"]).join(F.broadcast(listed(sources)), F.col("start") == F.col("name"))
    best = found.groupBy("target").agg(F.min_by(F.struct(F.col("start").alias("source"), F.col("path").alias("p")), F.struct(F.size("path"), "ord")).alias("b")).select("target", "b.*")
    # from the sinks upwards: a path to a sink is the reverse of a path from it over reversed edges
    up = first_paths(edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst")), listed(sinks).select("name"))
    to = up.join(F.broadcast(listed(sinks)), F.col("start") == F.col("name")).groupBy("node").agg(F.min_by(F.struct(F.col("start").alias("sink"), F.reverse("path").alias("q")), F.col("ord")).alias("s")).select(F.col("node").alias("target"), "s.*")
    joined = best.join(to, "target", "left")
    path = F.when(F.size("q") > 1, F.concat("p", F.slice("q", F.lit(2), F.size("q") - 1))).otherwise(F.col("p"))
    return joined.select("target", "source", "sink", F.coalesce(path, F.col("p")).alias("taint_path"))
