"""Counts, summaries and rankings of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """``dimension, value, n`` for each of the columns in one pass over the data."""
    out = findings.groupingSets([[F.col(c)] for c in by], *by).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    n = len(by)
    bit = lambda i: (1 << n) - 1 - (1 << (n - 1 - i))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        name = F.when(F.col("_g") == bit(i), c).otherwise(name)
        value = F.when(F.col("_g") == bit(i), F.col(c).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n")


def summary(findings: DataFrame, severity: str, risk: str, high: float = 0.7) -> DataFrame:
    """One row: counts by severity, all, the mean risk with nulls as 0, and how many are of high risk."""
    per = [F.count_if(F.col(severity) == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    r = F.coalesce(F.col(risk), F.lit(0.0))
    return findings.agg(F.count("*").alias("n"), *per, F.round(F.sum(r) / F.greatest(F.count("*"), F.lit(1)), 4).alias("avg_risk"), F.count_if(r >= high).alias("n_high_risk"))


def scored_summary(findings: DataFrame, probability: str, risk: str, composite: str, high: float = 0.7) -> DataFrame:
    """One row over the findings that were scored: their number, mean probability and risk, and of all findings
    those whose composite risk is high."""
    scored = F.col(probability).isNotNull()
    return findings.agg(F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), F.round(F.avg(probability), 4).alias("avg_probability"), F.round(F.avg(F.when(scored, F.col(risk))), 4).alias("avg_risk"), F.count_if(F.col(composite) >= high).alias("n_high_risk"))


def top(findings: DataFrame, order: list[Column], k: int, columns: list[str]) -> DataFrame:
    """The first ``k`` rows in a total order, with their rank: a bounded heap a task, no full sort."""
    first = findings.orderBy(*order).limit(k)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *columns)


def common(findings: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` commonest values, ties in order of the value; nulls left out."""
    return findings.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def fix_rates(per_file: DataFrame, before: str, after: str) -> DataFrame:
    """``per_file`` with ``fixed`` and ``fix_rate``: 1 where nothing was to fix."""
    fixed = F.greatest(F.col(before) - F.col(after), F.lit(0))
    return per_file.withColumn("fixed", fixed).withColumn("fix_rate", F.when(F.col(before) == 0, 1.0).otherwise(F.round(fixed / F.nullif(F.col(before), F.lit(0)), 6)))


def total_fix_rate(per_file: DataFrame, before: str, after: str) -> DataFrame:
    """One row: sums before and after and the total rate, 0 without findings before."""
    b, a = F.sum(before), F.sum(after)
    return per_file.agg(b.alias("before"), a.alias("after"), F.coalesce(F.round((b - a) / F.nullif(b, F.lit(0)), 6), F.lit(0.0)).alias("fix_rate"))


def tree(paths: DataFrame, path: str) -> DataFrame:
    """``parent, name, is_dir, n_files, place``: the folders and files of a set of paths, folders first and then
    by name within a parent."""
    each = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("_p")).distinct().select(F.split("_p", "/").alias("s"))
    rows = each.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i"))
    rows = rows.select(F.array_join(F.slice("s", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.element_at("s", F.col("i")).alias("name"), (F.col("i") < F.size("s")).alias("is_dir"))
    nodes = rows.groupBy("parent", "name", "is_dir").agg(F.count("*").alias("n_files"))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name")))
