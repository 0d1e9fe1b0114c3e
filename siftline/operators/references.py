"""References to records that do not exist, or do not exist at the time they are made (problem 2).

A Bloom filter of all parent keys, of fixed size, is folded into the scan of the referring table as a
scalar subquery: a reference that it rejects is an orphan for certain and takes no part in any join.
Only the rest is checked, by an exact join against the parents' periods of validity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..session import fresh
from . import joins


#: References to one key beyond which they are dealt out before the exact join.
BLOCK = 1 << 16


def numbers(text: Column) -> Column:
    """The distinct numbers written in a text in ASCII digits, leading zeros dropped, as ARRAY<STRING>, so that a
    number of any length is kept.  Null text: null."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("0*([0-9]+)"), 1))


def periods(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The parents' periods of validity, overlapping ones of a key merged: ``key, from, until``; an
    ``until`` of null is open. Rows with a null key or start are never in force and drop out, as do
    periods that end before they start."""
    earlier = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.coalesce(F.col(end), F.expr("timestamp_ntz'9999-12-31 23:59:59'"))).over(earlier)
    rows = parents.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).select(key, start, end).distinct()
    marked = rows.withColumn("_far", far).withColumn("_new", F.when(F.col("_far").isNull() | (F.col("_far") < F.col(start)), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(Window.partitionBy(key).orderBy(start).rangeBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(start).alias("_from"), F.when(F.max(F.col(end).isNull()), F.lit(None)).otherwise(F.max(end)).alias("_until")).drop("_run")


def orphans(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str,
    child_key: Column,
    at: str,
    parent_key: Column,
    valid_from: str,
    valid_to: str,
    bits: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """References of ``children`` for which no row of ``parents`` is in force.

    ``child_key`` and ``parent_key`` are ARRAY columns, as a value can name several keys.  A parent
    is in force from ``valid_from`` (included) until ``valid_to`` (excluded; null: still).  Returns distinct
    ``ref_id, ref_key, ref_at, reason``, where the reason is ``missing`` (no parent ever has the key),
    ``later`` (the first such parent comes after), ``ended`` (all had ended) or ``gap`` (between two).

    Null or empty keys refer to nothing.  A null ``at`` lies in no period, so its references are orphans
    (``gap``, or ``missing``).  Redelivered rows count once.  With no parents every reference is missing.
    Other columns of either table are never read, so their names cannot clash.

    The filter has 16 bits for each parent row, up to 16 MB, unless ``bits`` says otherwise; one that is too full
    only leaves more to the join.  Parents' periods are broadcast where the optimizer knows them to be small; else
    the references to a key of more than ``block`` are dealt out in blocks, and the key's one row of periods is
    repeated for each.
    """
    refs = children.select(F.col(child_id).alias("ref_id"), F.explode(child_key).alias("ref_key"), F.col(at).cast("timestamp_ntz").alias("ref_at"))
    keyed = parents.select(F.explode(parent_key).alias("key"), F.col(valid_from).cast("timestamp_ntz").alias("a"), F.col(valid_to).cast("timestamp_ntz").alias("b"))
    if bits is None:
        bits = bloom.bits_for(keyed.count())
    filter_ = bloom.dense(bloom.build(keyed, F.xxhash64("key"), bits), bits).scalar()
    refs = refs.withColumn("_maybe", bloom.might_contain(filter_, F.xxhash64("ref_key"), bits))
    definite = refs.where(~F.col("_maybe")).select("ref_id", "ref_key", "ref_at", F.lit("missing").alias("reason"))
    valid = periods(keyed, "key", "a", "b")
    spans = valid.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_from", "_until"))).alias("spans"))
    held = F.exists("spans", lambda s: (F.col("ref_at") >= s["_from"]) & (s["_until"].isNull() | (F.col("ref_at") < s["_until"])))
    maybe = refs.where("_maybe").drop("_maybe")
    if joins.fits(keyed):
        joined = maybe.join(F.broadcast(spans), F.col("ref_key") == F.col("key"), "left")
    else:
        joined = joins.with_unique(maybe, spans.withColumnRenamed("key", "ref_key"), "ref_key", "ref_id", block, "left")
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.col("ref_at") < F.get("spans", F.lit(0))["_from"], "later")
        .when(F.col("ref_at") >= F.element_at("spans", -1)["_until"], "ended")
        .otherwise("gap")
    )
    exact = joined.where(~F.coalesce(held, F.lit(False))).select("ref_id", "ref_key", "ref_at", reason.alias("reason"))
    return definite.unionByName(exact).distinct()


def orphan_report(found: DataFrame, refs: DataFrame, table: str, ref_id: str, ref_key: Column, at: str) -> DataFrame:
    """``table_name, month, n_refs, n_orphans, n_missing, n_later, n_ended, n_gap``: distinct references and
    orphans of each month of ``at`` (null for references without a time)."""
    month = lambda c: F.date_format(F.date_trunc("month", c), "yyyy-MM")
    n, m = fresh([], "n_refs", "month")
    total = refs.select(F.col(ref_id).alias("i"), F.explode(ref_key).alias("k"), month(F.col(at)).alias(m)).distinct().groupBy(m).agg(F.count("*").alias(n))
    kinds = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "later", "ended", "gap")]
    bad = found.groupBy(month(F.col("ref_at")).alias("_m")).agg(F.count("*").alias("n_orphans"), *kinds)
    out = total.join(bad, F.col(m).eqNullSafe(F.col("_m")), "left").drop("_m")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_orphans", "n_missing", "n_later", "n_ended", "n_gap")]
    return out.select(F.lit(table).alias("table_name"), m, n, *zero)
