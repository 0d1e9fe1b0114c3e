"""Measures of classifiers and regressors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Decimal places of all measures.
R = 6


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), R)


def confusion(table: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """Counts and measures of 0/1 columns; a measure without cases is 0; rows with a null in either are left out."""
    t, g = F.col(truth), F.col(guess)
    rows = table.where(t.isNotNull() & g.isNotNull())
    cell = lambda a, b: F.count_if((t == a) & (g == b))
    c = rows.groupBy(*(by or [])).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*(by or []), "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tn, tn + fp).alias("specificity"))


def by_threshold(table: DataFrame, truth: str, score: str) -> DataFrame:
    """``score, tp, fp`` at each distinct score, highest first: all rows at or above it.

    Rows are counted per score first.  The running sum over distinct scores is taken in two steps, within ranges
    of the score and over the ranges' totals, so that no task holds all of them."""
    per = table.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    ranged = cut(per.repartitionByRange(F.desc("score")).withColumn("_r", F.spark_partition_id()))
    totals = ranged.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("_r", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), "_r").select("score", (F.sum("p").over(within) + F.col("_p")).alias("tp"), (F.sum("n").over(within) + F.col("_n")).alias("fp"))


def roc(table: DataFrame, truth: str, score: str) -> DataFrame:
    """``score, tpr, fpr`` at each distinct score."""
    points = by_threshold(table, truth, score)
    total = points.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n")).alias("t")).scalar()
    return points.select("score", _ratio(F.col("tp"), total["p"]).alias("tpr"), _ratio(F.col("fp"), total["n"]).alias("fpr"))


def precision_recall(table: DataFrame, truth: str, score: str) -> DataFrame:
    """``score, precision, recall`` at each distinct score."""
    points = by_threshold(table, truth, score)
    total = points.agg(F.max("tp").alias("p")).scalar()
    return points.select("score", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), total).alias("recall"))


def areas(table: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: ``auc`` (ties count half) and ``average_precision``; 0 with one class only."""
    per = by_threshold(table, truth, score)
    total = per.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n")).alias("t")).scalar()
    # each score's own counts are the differences to the higher one; they are counted again instead of sorted again
    own = table.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    rows = per.join(own, "score")
    pairs = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return rows.agg(_ratio(pairs, F.max(total["p"] * total["n"])).alias("auc"), _ratio(ap, F.max(total["p"])).alias("average_precision"))


def regression(table: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """``n, mae, mse, rmse, r2, mape``; rows with a null in either are left out."""
    t, g = F.col(truth), F.col(guess)
    rows = table.where(t.isNotNull() & g.isNotNull())
    e = t - g
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(t).alias("_v"), F.avg(F.abs(e) / (F.abs(t) + 1e-10)).alias("mape"))
    return out.select(*(by or []), "n", F.round("mae", R).alias("mae"), F.round("mse", R).alias("mse"), F.round(F.sqrt("mse"), R).alias("rmse"), F.round(1 - F.try_divide(F.col("mse"), F.col("_v")), R).alias("r2"), F.round("mape", 2).alias("mape"))


def correlations(table: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """``a, b, r`` for every pair of columns; with a target, of the pair's product with it, without sign."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    value = (lambda a, b: F.abs(F.corr(F.col(a) * F.col(b), F.col(target)))) if target else (lambda a, b: F.corr(a, b))
    stats = table.agg(*[value(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"r{i}"), R).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def folds(table: DataFrame, id_: str, k: int = 5) -> DataFrame:
    """``table`` with ``fold``, 0..k-1, by the id's hash."""
    h = F.conv(F.substring(F.md5(F.col(id_).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return table.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def over_folds(per_fold: DataFrame, measures: list[str]) -> DataFrame:
    """``measure, mean, deviation`` over the folds."""
    stats = per_fold.agg(*[f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("deviation", F.stddev_pop))])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(f"{c}_mean"), R).alias("mean"), F.round(F.col(f"{c}_deviation"), R).alias("deviation")) for c in measures])).alias("x")).select("x.*")
