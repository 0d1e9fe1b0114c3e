"""Queries of problem 2 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as R
from ..session import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphans(
        table(spark, folder, "scored_vulns"), table(spark, folder, "standards_db"),
        child_id="finding_id", child_key=R.numbers(F.col("cwe")), at="scanned_at",
        parent_key=R.numbers(F.col("cwe_id")), valid_from="added_at", valid_to="retired_at",
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The column is BIGINT: a number beyond it, which no key can be, is counted in ``p2_report`` alone."""
    return _orphans(spark, folder).select(F.col("ref_id").alias("finding_id"), F.col("ref_key").try_cast("bigint").alias("cwe_no")).where("cwe_no IS NOT NULL").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, folder), table(spark, folder, "scored_vulns"), "scored_vulns", "finding_id", R.numbers(F.col("cwe")), "scanned_at")


_REFS = """
r AS (SELECT DISTINCT finding_id, scanned_at, unnest(regexp_extract_all(cwe, '0*([0-9]+)', 1)) AS cwe_no FROM scored_vulns),
s AS (SELECT unnest(regexp_extract_all(cwe_id, '0*([0-9]+)', 1)) AS no, added_at, retired_at FROM standards_db),
o AS (SELECT * FROM r WHERE cwe_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE no = cwe_no AND added_at <= scanned_at AND (retired_at IS NULL OR scanned_at < retired_at)))"""

SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT finding_id, try_cast(cwe_no AS BIGINT) AS cwe_no FROM o WHERE try_cast(cwe_no AS BIGINT) IS NOT NULL",
    "p2_report": f"""WITH {_REFS},
v AS (SELECT no, min(added_at) AS first, CASE WHEN bool_or(retired_at IS NULL) THEN NULL ELSE max(retired_at) END AS last FROM s WHERE added_at IS NOT NULL AND (retired_at IS NULL OR retired_at > added_at) GROUP BY no),
k AS (SELECT o.*, CASE WHEN no IS NULL THEN 'missing' WHEN scanned_at < first THEN 'later' WHEN scanned_at >= last THEN 'ended' ELSE 'gap' END AS reason FROM o LEFT JOIN v ON no = cwe_no),
a AS (SELECT strftime(scanned_at, '%Y-%m') AS month, count(*) AS n_refs FROM (SELECT DISTINCT finding_id, strftime(scanned_at, '%Y-%m') AS m, any_value(scanned_at) AS scanned_at, cwe_no FROM r WHERE cwe_no IS NOT NULL GROUP BY 1, 2, 4) GROUP BY 1),
b AS (SELECT strftime(scanned_at, '%Y-%m') AS month, count(*) AS n_orphans, count_if(reason = 'missing') AS n_missing, count_if(reason = 'later') AS n_later, count_if(reason = 'ended') AS n_ended, count_if(reason = 'gap') AS n_gap FROM k GROUP BY 1)
SELECT 'scored_vulns' AS table_name, a.month, n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_missing, 0) AS n_missing, coalesce(n_later, 0) AS n_later, coalesce(n_ended, 0) AS n_ended, coalesce(n_gap, 0) AS n_gap FROM a LEFT JOIN b ON a.month IS NOT DISTINCT FROM b.month""",
}


def queries():  # noqa: ANN201
    return {"p2_found": p2_found, "p2_report": p2_report}
