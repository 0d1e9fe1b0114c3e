"""Labels, splits, balance and augmentation of feature tables. Every random choice is a hash of the row's id,
so that a task that runs again, or another partitioning, gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C

# Thresholds of the labelling strategies (above, below) and their shares of flipped labels.
STRATEGIES = {"strict": (0.75, 0.25, 0.01), "moderate": (0.70, 0.30, 0.02), "lenient": (0.65, 0.35, 0.03)}
FEATURES = ["cwe_cvss_score", "severity_score", "confidence", "reachable_from_entry", "has_extern_input", "call_depth", "in_loop", "pointer_ops", "unsafe_api_count", "alloc_without_free", "loop_depth", "language_risk"]
BINARY = ["reachable_from_entry", "has_extern_input", "in_loop", "alloc_without_free"]
CAPS = {"call_depth": 10, "pointer_ops": 20, "unsafe_api_count": 15, "loop_depth": 5}


def uniform(id_: Column, salt: str) -> Column:
    """A number in [0, 1) fixed by the id: the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit("|" + salt)).cast("binary")), 1, 13), 16, 10).cast("bigint") / float(16**13)


def smallest(table: DataFrame, value: Column, k: int, slots: int = 4096) -> float:
    """The k-th smallest of values in [0, 1), or 1 if there are fewer: counts by slot go to the driver, and of the
    one slot in which it lies the first that are needed; never k rows."""
    v = table.select(value.alias("v")).where("v IS NOT NULL").withColumn("s", F.floor(F.col("v") * slots).cast("int"))
    for r in v.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect():
        if k <= r["n"]:
            return v.where(F.col("s") == r["s"]).orderBy("v").limit(k).agg(F.max("v")).first()[0]
        k -= r["n"]
    return 1.0


def normal(id_: Column, salt: str) -> Column:
    """A standard normal number fixed by the id."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(id_, salt + "u"))) * F.cos(2.0 * math.pi * uniform(id_, salt + "v"))


def features(findings: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """The twelve features, each 0..1: missing flags are 0, missing counts 0, numbers that are not a number 0.

    ``columns``: cwe, severity, confidence, reachable, extern, depth, in_loop, pointers, unsafe, unfreed, loops,
    language."""
    flag = lambda k: F.when(columns[k], 1.0).otherwise(0.0)
    capped = lambda k, f: F.least(F.greatest(F.coalesce(columns[k], F.lit(0)), F.lit(0)), F.lit(CAPS[f])) / float(CAPS[f])
    out = {
        "cwe_cvss_score": C.base_score(columns["cwe"]), "severity_score": C.looked_up(C.SEVERITY_SCORE, F.upper(columns["severity"]), 0.5), "confidence": F.coalesce(F.nanvl(columns["confidence"], F.lit(0.0)), F.lit(0.0)),
        "reachable_from_entry": flag("reachable"), "has_extern_input": flag("extern"), "call_depth": capped("depth", "call_depth"), "in_loop": flag("in_loop"), "pointer_ops": capped("pointers", "pointer_ops"),
        "unsafe_api_count": capped("unsafe", "unsafe_api_count"), "alloc_without_free": flag("unfreed"), "loop_depth": capped("loops", "loop_depth"), "language_risk": C.looked_up(C.LANGUAGE_RISK, columns["language"], 0.5),
    }
    return findings.select(*keep, *[v.cast("double").alias(k) for k, v in out.items()])


def unsafe_calls(calls: DataFrame, unsafe: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: calls of each function to the names that ``unsafe`` (``lang, name``) lists."""
    return calls.join(F.broadcast(unsafe), ["lang", "name"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))


# Calls that count as unsafe.
UNSAFE = {
    "c": ["strcpy", "strcat", "sprintf", "gets", "scanf", "printf", "system", "popen", "exec", "memcpy", "memmove", "malloc", "free", "realloc"],
    "python": ["eval", "exec", "compile", "pickle.loads", "pickle.load", "subprocess.call", "subprocess.Popen", "os.system", "os.popen", "open", "input"],
    "go": ["exec.Command", "unsafe.Pointer", "os.system", "fmt.Sprintf", "fmt.Fprintf"],
}


def maxima(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's maximum, 1 where that is not above 0."""
    return table.agg(*[F.when(F.max(c) > 0, F.max(c)).otherwise(1.0).alias(c) for c in columns])


def normalised(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each column divided by its maximum; the one row of maxima is a scalar subquery, not a join."""
    most = maxima(table, columns).select(F.struct(*columns).alias("m")).scalar()
    return table.withColumns({c: F.col(c) / most[c] for c in columns})


def risk(table: DataFrame) -> DataFrame:
    """``table`` with ``risk``, from the features over their maxima."""
    most = maxima(table, FEATURES).select(F.struct(*FEATURES).alias("m")).scalar()
    return table.withColumn("risk", F.round(C.composite_risk({c: F.col(c) / most[c] for c in FEATURES}), 6))


def weak_labels(table: DataFrame, score: str, strategy: str = "moderate", id_: str | None = None) -> DataFrame:
    """Rows above the upper threshold with ``label`` 1, below the lower with 0; the others drop out.  With an
    id, the strategy's share of labels, at least one, is flipped: those of the smallest hashes."""
    high, low, share = STRATEGIES[strategy]
    kept = table.where((F.col(score) > high) | (F.col(score) < low)).withColumn("label", (F.col(score) > high).cast("int"))
    if id_ is None:
        return kept
    most = smallest(kept, uniform(F.col(id_), "flip"), max(1, int(kept.count() * share)))
    return kept.withColumn("label", F.when(uniform(F.col(id_), "flip") <= F.lit(most), 1 - F.col("label")).otherwise(F.col("label")))


def percentile_split(table: DataFrame, score: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Rows at or above the upper percentile with ``label`` 1, at or below the lower with 0, the rest out."""
    cut_ = table.agg(F.percentile(score, F.array(F.lit(low), F.lit(high))).alias("p")).scalar()
    return table.where((F.col(score) >= cut_[1]) | (F.col(score) <= cut_[0])).withColumn("label", (F.col(score) >= cut_[1]).cast("int"))


def labelled(table: DataFrame, score: str, strategy: str) -> DataFrame:
    """Weak labels; if none, those of risk 0.5 on all rows; if fewer than four, by percentiles."""
    kept = weak_labels(table, score, strategy)
    n = kept.limit(4).count()
    if n == 0:
        return table.withColumn("label", (F.col(score) >= 0.5).cast("int"))
    return percentile_split(table, score) if n < 4 else kept


def two_of_each(table: DataFrame, label: str, score: str, id_: str) -> DataFrame:
    """With fewer than two of a class, the riskiest of the other (for class 1; the safest for class 0) change
    sides, as many as are missing, but never the other's last."""
    n = {r[label]: r["n"] for r in table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    for wanted, other, order in ((1, 0, F.desc(score)), (0, 1, F.asc(score))):
        missing = min(2 - n.get(wanted, 0), n.get(other, 0) - 1)
        if n.get(wanted, 0) < 2 and missing > 0:
            moved = table.where(F.col(label) == other).orderBy(order, id_).limit(missing).select(F.col(id_).alias("_m"))
            table = table.join(F.broadcast(moved), F.col(id_) == F.col("_m"), "left").withColumn(label, F.when(F.col("_m").isNotNull(), wanted).otherwise(F.col(label))).drop("_m")
            n[wanted], n[other] = n.get(wanted, 0) + missing, n[other] - missing
    return table


def balance(table: DataFrame, label: str) -> DataFrame:
    """One row: ``n, n_positive, n_negative, share``."""
    return table.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.round(F.avg((F.col(label) == 1).cast("int")), 6).alias("share"))


def split(table: DataFrame, strata: list[str], id_: str, share: float = 0.2) -> DataFrame:
    """``table`` with ``split``: of each stratum the rows of the smallest hashes are ``val``, the share rounded
    down but at least one where there are two rows; the rest is ``train``.  Ranks come from a window per
    stratum; a stratum of most rows is spread by first ranking within hash ranges."""
    order = F.md5(F.col(id_).cast("string").cast("binary"))
    slot = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    rows = table.withColumn("_h", order).withColumn("_slot", slot)
    sizes = rows.groupBy(*strata, "_slot").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*strata).orderBy("_slot")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(*strata)))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata] + [F.col("a._slot") == F.col("b._slot")]
    joined = rows.alias("a").join(sizes.alias("b"), on).select("a.*", "_before", "_n")
    rank = F.row_number().over(Window.partitionBy(*strata, "_slot").orderBy("_h", id_)) + F.col("_before")
    n_val = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.floor(F.col("_n") * share))).otherwise(0)
    return joined.withColumn("split", F.when(rank <= n_val, "val").otherwise("train")).select(*table.columns, "split")


def oversampled(table: DataFrame, label: str, id_: str, columns: list[str]) -> DataFrame:
    """The smaller class filled up to the larger: each new row lies between a row of it and the next one by
    hash, at a hashed place; rows have ``synthetic`` set and keep their first parent's id."""
    n = {r[label]: r["n"] for r in table.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    marked = table.withColumn("synthetic", F.lit(False))
    if len(n) < 2 or min(n.values()) == max(n.values()) or min(n.values()) < 2:
        return marked
    few = min(n, key=n.get)
    copies = -(-(max(n.values()) - n[few]) // n[few])
    slot = F.pmod(F.xxhash64(F.col(id_)), F.lit(max(1, n[few] // 1000)))
    w = Window.partitionBy("_slot").orderBy(F.md5(F.col(id_).cast("string").cast("binary")), id_)
    rows = marked.where(F.col(label) == few).withColumn("_slot", slot)
    pairs = rows.withColumns({f"_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in columns})
    pairs = pairs.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    at = uniform(F.concat(F.col(id_).cast("string"), F.lit("#"), F.col("_c").cast("string")), "between")
    new = pairs.withColumn("_u", at).withColumns({c: F.col(c) + F.col("_u") * (F.col(f"_{c}") - F.col(c)) for c in columns}).withColumn("synthetic", F.lit(True))
    wanted = max(n.values()) - n[few] - (copies - 1) * n[few]  # of the last copies only so many
    last = new.where(F.col("_c") == copies)
    new = new.where((F.col("_c") < copies) | (F.col("_u") <= smallest(last, F.col("_u"), wanted)))
    return marked.unionByName(new.select(*marked.columns))


def augmented(table: DataFrame, id_: str, columns: list[str], times: int = 4, sigma: float = 0.05) -> DataFrame:
    """Each row and ``times`` copies whose columns, but the binary ones, get hashed normal noise, kept in 0..1;
    ``copy`` is 0 for the row itself."""
    rows = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times))))
    key = F.concat(F.col(id_).cast("string"), F.lit("#"), F.col("copy").cast("string"))
    noisy = {c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + sigma * normal(key, c)))) for c in columns if c not in BINARY}
    return rows.withColumns(noisy)


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, n, least, most, mean, deviation`` (of the population) of each column, in one pass."""
    stats = table.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("n", F.count), ("least", F.min), ("most", F.max), ("mean", F.avg), ("deviation", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"), *[F.round(F.col(f"{c}_{k}"), 6).alias(k) for k in ("least", "most", "mean", "deviation")]) for c in columns])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def first_of_each(table: DataFrame, group: str, k: int, order: list[str]) -> DataFrame:
    """At most ``k`` rows of each group, the first in order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return table.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
