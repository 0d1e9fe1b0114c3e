"""The queries of the training-data problems over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, lookalikes, near_duplicates, packing, sets, splitting, split_overlap, syntax

Query = Callable[[SparkSession, str], DataFrame]


def _language() -> F.Column:
    return F.lower(F.trim(F.col("language")))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "samples"), id_="sample_id", text="raw_code")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no = 1").select(F.col("id").alias("sample_id")).distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).withColumnRenamed("id", "sample_id")


def _overlaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return split_overlap.overlaps(table(spark, folder, "split_samples"), id_="row_id", text="raw", split="split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.pairs(*_overlaps(spark, folder))


def p3_matches(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.matches(*_overlaps(spark, folder)).withColumnRenamed("id", "row_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    found = split_overlap.matches(*_overlaps(spark, folder))
    return split_overlap.report(table(spark, folder, "split_samples"), found, "row_id", "split", F.col("source"))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.checked(table(spark, folder, "samples"), id_="sample_id", text="raw_code", language="language", keep=("repo",))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).where("broken").select(F.col("id").alias("sample_id")).distinct()


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).withColumnRenamed("id", "sample_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.rates(_checked(spark, folder), "repo")


def _near_duplicates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, folder, "samples"), id_="sample_id", text="raw_code", tag=_language())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, links = _near_duplicates(spark, folder)
    return sets.expanded(links, rows).select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(*_near_duplicates(spark, folder)).withColumnRenamed("id", "sample_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), id_="doc_id", text="text").withColumnRenamed("id", "doc_id")


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(bpe.counted(table(spark, folder, "documents"), id_="doc_id", text="text"), id_="id", n="n")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder).select(F.col("id").alias("doc_id"), F.col("start").alias("first_token"), F.col("n").alias("n_tokens"), F.col("container").alias("container_id"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_containers(spark, folder)).withColumnRenamed("container", "container_id")


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.forms(table(spark, folder, "documents"), id_="doc_id", text="text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.alike(_forms(spark, folder)).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select(F.col("id").alias("doc_id"), "form")


_SHINGLES = """
w AS (SELECT {id} AS id, {tag} AS tag, regexp_extract_all({text}, '[A-Za-z0-9_]+') AS w FROM {table} WHERE {text} IS NOT NULL),
s AS (SELECT DISTINCT id, tag, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, tag, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT id, tag, count(*) AS n FROM s GROUP BY ALL),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND {match} GROUP BY ALL),
likeness AS (SELECT a, b, k / (x.n + y.n - k) AS j FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b)"""

SQL = {
    "p1_found": "SELECT DISTINCT sample_id FROM samples WHERE length(raw_code) > 4000",
    "p3_found": "WITH "
    + _SHINGLES.format(id="row_id", tag="(split = 'train')", text="raw", table="(SELECT * FROM split_samples WHERE split IN ('train', 'test', 'val'))", match="a.tag <> b.tag AND a.id < b.id")
    + " SELECT a AS row_id_a, b AS row_id_b FROM likeness WHERE j >= 0.80",
    "p5_found": "WITH "
    + _SHINGLES.format(id="sample_id", tag="lower(trim(language))", text="raw_code", table="(SELECT * FROM samples WHERE language IS NOT NULL)", match="a.tag = b.tag AND a.id < b.id")
    + " SELECT a AS sample_id_a, b AS sample_id_b FROM likeness WHERE j >= 0.75",
}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
