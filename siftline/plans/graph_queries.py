"""Queries over the call graph of findings: functions of one file in the order of their lines call the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, rules
from ..session import cut, table
from ..sources import files
from . import code_queries


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scored_vulns").where("source_file IS NOT NULL AND function_name IS NOT NULL").select("source_file", "function_name", "line_start", "finding_id", "ingested_at")
    each = rules.following(rows, ["source_file"], ["line_start", "finding_id", "ingested_at"], "function_name", "callee", F.floor(F.col("line_start") / 64))
    return each.select(F.col("function_name").alias("caller"), "callee", "line_start", F.struct("line_start", "finding_id").alias("o"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(_calls(spark, folder), "caller", "callee", "line_start", "o")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of critical findings that are reachable from an entry at depth 0."""
    return table(spark, folder, "scored_vulns").where("call_depth = 0 AND severity = 'CRITICAL' AND function_name IS NOT NULL").select("function_name").distinct()


def transition_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def callers_callees(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).groupBy("x.node").agg(F.sum("x.o").alias("n_callees"), F.sum("x.i").alias("n_callers"))


def reachability_depth(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(_edges(spark, folder), _starts(spark, folder))


def unreachable_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that no start reaches: depth -1."""
    e = cut(_edges(spark, folder))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(graph.reach(e, _starts(spark, folder)), "node", "left_anti").select("node", F.lit(-1).alias("depth"))


def cycle_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cyclic(_edges(spark, folder))


def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.statistics(_edges(spark, folder))


def components_of_calls(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(_edges(spark, folder), "src", "dst")


def _types(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"))
    return graph.edges(rows, "caller", "callee")


def simple_paths_cut8(spark: SparkSession, folder: str) -> DataFrame:
    """All simple paths between event types that follow each other, of at most eight steps."""
    e = _types(spark, folder)
    nodes = e.select(F.col("src").alias("node")).distinct()
    found = graph.simple_paths(e, nodes, nodes, 8)
    return found.select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("n_steps"))


def taint_best_path(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest paths from the sources of taint to functions, the graph having the sources of ``taint_path`` as
    callers of the functions tainted by them."""
    rows = table(spark, folder, "scored_vulns")
    source = F.regexp_extract("taint_path", r"^(\w+) ->", 1)
    entry = rows.where("taint_path IS NOT NULL").select(source.alias("src"), F.col("function_name").alias("dst")).where("src <> '' AND dst IS NOT NULL").distinct()
    e = _edges(spark, folder).select("src", "dst").unionByName(entry).distinct()
    found = graph.tainted(e, rows, "function_name")
    return found.select("target", "source", F.size("taint_path").alias("n_path"))


def functions_by_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of calls below each function of the samples, file by file."""
    return code_queries.functions_found(spark, folder).groupBy("lang", "call_depth", "reachable").agg(F.count("*").alias("n"))


def syntax_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Token chains of the samples as graphs: each file's count of edges between successive lines by first word."""
    rows = files.lines(table(spark, folder, "samples"), "raw_code", "sample_id")
    word = F.regexp_extract("src", r"([A-Za-z_]+)", 1)
    w = Window.partitionBy("sample_id").orderBy("line")
    words = rows.select("sample_id", "line", word.alias("word")).where("word <> ''")
    pairs = words.select("sample_id", "word", F.lead("word").over(w).alias("next")).where("next IS NOT NULL")
    return pairs.groupBy("word", "next").agg(F.count("*").alias("n"))


_EDGES = """c AS (SELECT function_name AS src, lead(function_name) OVER (PARTITION BY source_file ORDER BY line_start, finding_id, ingested_at) AS dst, line_start, finding_id FROM scored_vulns WHERE source_file IS NOT NULL AND function_name IS NOT NULL),
e AS (SELECT src, dst, arg_max(line_start, (line_start, finding_id)) AS line, count(*) AS n_calls FROM c WHERE dst IS NOT NULL GROUP BY 1, 2)"""
_STARTS = "s AS (SELECT DISTINCT function_name AS node FROM scored_vulns WHERE call_depth = 0 AND severity = 'CRITICAL' AND function_name IS NOT NULL)"
_REACH = "r(node, depth) USING KEY (node) AS (SELECT node, 0 FROM s UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r AS o ON o.node = e.dst WHERE o.node IS NULL GROUP BY 1)"
_REACHED = "r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"
_TYPES = "t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL)"

SQL = {
    "transition_graph_edges": f"WITH {_EDGES} SELECT * FROM e",
    "callers_callees": f"WITH {_EDGES} SELECT node, sum(o)::BIGINT AS n_callees, sum(i)::BIGINT AS n_callers FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
    "reachability_depth": f"WITH RECURSIVE {_EDGES}, {_STARTS}, {_REACH} SELECT node, depth::INT AS depth FROM r",
    "unreachable_functions": f"WITH RECURSIVE {_EDGES}, {_STARTS}, {_REACHED} SELECT DISTINCT node, -1 AS depth FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM r)",
    "components_of_calls": f"WITH RECURSIVE {_EDGES}, b AS (SELECT src AS a, dst AS z FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), r AS (SELECT a AS node, a AS component FROM b UNION SELECT b.z, r.component FROM r JOIN b ON b.a = r.node AND r.component < b.z) SELECT node, min(component) AS component FROM r GROUP BY 1",
    "simple_paths_cut8": f"WITH RECURSIVE {_TYPES}, p AS (SELECT [src, dst] AS path FROM e WHERE src <> dst UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON e.src = path[len(path)] AND NOT list_contains(path, dst) WHERE len(path) <= 8) SELECT array_to_string(path, ' > ') AS path, (len(path) - 1)::INT AS n_steps FROM p",
    "syntax_edges": r"""WITH l AS (SELECT sample_id, unnest(ls) AS src, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT sample_id, CASE WHEN raw_code = '' THEN [] ELSE string_split_regex(regexp_replace(raw_code, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END AS ls FROM samples WHERE raw_code IS NOT NULL)),
w AS (SELECT sample_id, line, regexp_extract(src, '([A-Za-z_]+)', 1) AS word FROM l), p AS (SELECT word, lead(word) OVER (PARTITION BY sample_id ORDER BY line) AS next FROM w WHERE word <> '')
SELECT word, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2""",
    "taint_best_path": f"""WITH RECURSIVE {_EDGES}, x AS (SELECT src, dst FROM e UNION SELECT regexp_extract(taint_path, '^(\\w+) ->', 1), function_name FROM scored_vulns WHERE taint_path IS NOT NULL AND function_name IS NOT NULL AND regexp_extract(taint_path, '^(\\w+) ->', 1) <> ''),
k AS (SELECT * FROM (VALUES ('argv', 0), ('stdin', 1), ('getenv', 2), ('recv', 3), ('read', 4), ('fgets', 5), ('scanf', 6)) AS v(name, ord)),
r(source, node, n) USING KEY (source, node) AS (SELECT name, name, 1 FROM k UNION SELECT r.source, x.dst, min(r.n) + 1 FROM r JOIN x ON x.src = r.node LEFT JOIN recurring.r AS o ON o.source = r.source AND o.node = x.dst WHERE o.node IS NULL GROUP BY 1, 2)
SELECT node AS target, source, n::INT AS n_path FROM r JOIN k ON name = source WHERE node IN (SELECT function_name FROM scored_vulns) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n, ord) = 1""",
}


def queries():  # noqa: ANN201
    listed = (transition_graph_edges, callers_callees, reachability_depth, unreachable_functions, cycle_nodes, graph_statistics, components_of_calls, simple_paths_cut8, taint_best_path, functions_by_depth, syntax_edges)
    return {f.__name__: f for f in listed}
