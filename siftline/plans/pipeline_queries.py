"""Queries of whole phases over the samples, and of the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches, rules
from ..session import cut, table
from ..sources import files as sources
from ..sources import parse
from ..streaming import windows


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples").select("sample_id", F.lower(F.trim("language")).alias("lang"), "raw_code").where("raw_code IS NOT NULL")


def _targets(files: DataFrame) -> DataFrame:
    """Findings of all languages, with the weakness's first strategy."""
    facts = cut(parse.facts(files, text="raw_code", lang="lang", keep=("sample_id",)))
    found = rules.scan(files, facts, "sample_id", "raw_code")
    return cut(found.select("sample_id", F.xxhash64("sample_id", "rule_name", "function_name", "line").alias("finding_id"), "cwe", patches.first_strategy(F.col("cwe")).alias("strategy"), "line", "rule_name"))


def patch_results(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return patches.apply(files, _targets(files), "sample_id", "raw_code")[0]


def patch_diffs(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return patches.diffs(patches.apply(files, _targets(files), "sample_id", "raw_code")[1], "sample_id")


def patch_verification(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    targets = _targets(files)
    changed = cut(patches.apply(files, targets, "sample_id", "raw_code")[1].join(files.select("sample_id", "lang"), "sample_id").select("sample_id", "lang", F.col("patched").alias("raw_code")))
    facts = cut(parse.facts(changed, text="raw_code", lang="lang", keep=("sample_id",)))
    after = rules.scan(changed, facts, "sample_id", "raw_code")
    before = targets.join(changed.select("sample_id"), "sample_id", "left_semi")
    return patches.verified(before.select("sample_id", "rule_name", "line"), after.select("sample_id", "rule_name", "line"), "sample_id")


def patched_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the C samples with an unbounded copy, as its template rewrites it."""
    rows = sources.lines(_files(spark, folder).where("lang = 'c'"), "raw_code", "sample_id")
    return rows.where(F.col("src").rlike(r"\bstrcpy\s*\(")).select("sample_id", "line", patches.rewritten(F.lit(0), F.col("src")).alias("new"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type; the same operator runs on a stream."""
    return windows.windowed_counts(table(spark, folder, "events"), "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


SQL = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "patched_lines": r"""WITH l AS (SELECT sample_id, unnest(ls) AS src, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT sample_id, CASE WHEN raw_code = '' THEN [] ELSE string_split_regex(regexp_replace(raw_code, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END AS ls FROM samples WHERE raw_code IS NOT NULL AND lower(trim(language)) = 'c')),
m AS (SELECT *, regexp_extract(src, '^(\s*)', 1) AS ind, regexp_extract(src, 'strcpy\s*\(\s*(\w+)\s*,\s*(.+?)\s*\)\s*;', 1) AS dst, regexp_extract(src, 'strcpy\s*\(\s*(\w+)\s*,\s*(.+?)\s*\)\s*;', 2) AS val FROM l WHERE regexp_matches(src, '\bstrcpy\s*\('))
SELECT sample_id, line, CASE WHEN dst = '' THEN src ELSE ind || 'strncpy(' || dst || ', ' || val || ', sizeof(' || dst || ') - 1);' || chr(10) || ind || dst || '[sizeof(' || dst || ') - 1] = ''\0'';  /* bounds-safe copy */' END AS new FROM m""",
}


def queries():  # noqa: ANN201
    return {f.__name__: f for f in (patch_results, patch_diffs, patch_verification, patched_lines, event_windows)}
