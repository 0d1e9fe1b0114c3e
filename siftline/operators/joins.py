"""Joins of findings, lines, decisions and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A side is broadcast only if its estimated size is at most this; beyond it, the join shuffles.
BROADCAST_BYTES = 8 << 20


def fits(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of the size is within the bound of a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


#: Rows of one key beyond which a join deals them out in blocks of so many.
BLOCK = 4096


def large(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame | None:
    """``_g, _parts``: the groups of more than ``block`` rows and into how many blocks they go; None if there are
    none.  There is at most one for every ``block`` rows; so few that they fit are marked for broadcast."""
    found = cut(rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("_g", F.ceil(F.col("_n") / block).cast("int").alias("_parts")))
    n = found.count()
    return None if n == 0 else F.broadcast(found) if n * 64 <= BROADCAST_BYTES else found


def _parts(rows: DataFrame, key: str, groups: DataFrame | None, name: str) -> DataFrame:
    if groups is None:
        return rows.withColumn(name, F.lit(1))
    return rows.join(groups, F.col(key) == F.col("_g"), "left").withColumn(name, F.coalesce("_parts", F.lit(1))).drop("_g", "_parts")


def _dealt(rows: DataFrame, key: str, member: str, groups: DataFrame | None, name: str) -> DataFrame:
    return _parts(rows, key, groups, "_k").withColumn(name, F.pmod(F.xxhash64(member), F.col("_k")).cast("int")).drop("_k")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def with_unique(rows: DataFrame, unique: DataFrame, key: str, by: str, block: int = BLOCK, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``unique``, which has one row a key.  Keys of many rows are dealt out by ``by``,
    and their one row is repeated for each block."""
    groups = large(rows, key, block)
    if groups is None:
        return rows.join(unique, key, how)
    return _dealt(rows, key, by, groups, "_b").join(_parts(unique, key, groups, "_k").withColumn("_b", _every("_k")).drop("_k"), [key, "_b"], how).drop("_b")


def in_blocks(left: DataFrame, right: DataFrame, key: str, by: tuple[str, str], condition: Column, block: int = BLOCK) -> DataFrame:
    """The join of ``left`` and ``right`` (other columns of other names) on ``key`` and the condition, with keys of
    many rows on either side cut into pairs of blocks."""
    a, b = large(left, key, block), large(right, key, block)
    l, r = left.withColumnRenamed(key, "_l"), right.withColumnRenamed(key, "_r")
    if a is None and b is None:
        return l.join(r, (F.col("_l") == F.col("_r")) & condition).withColumnRenamed("_l", key).drop("_r")
    l = _parts(_dealt(l, "_l", by[0], a, "_i"), "_l", b, "_k").withColumn("_j", _every("_k")).drop("_k")
    r = _parts(_dealt(r, "_r", by[1], b, "_y"), "_r", a, "_k").withColumn("_x", _every("_k")).drop("_k")
    met = l.join(r, (F.col("_l") == F.col("_r")) & (F.col("_i") == F.col("_x")) & (F.col("_j") == F.col("_y")) & condition)
    return met.withColumnRenamed("_l", key).drop("_r", "_i", "_j", "_x", "_y")


def members(links: DataFrame, a: str, b: str, left: DataFrame, right: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """``member_a, member_b``: for each link of groups ``a`` and ``b`` every member of ``a`` in ``left`` with every
    member of ``b`` in ``right``, large groups in pairs of blocks.  Members of a group linked to itself come once,
    the smaller first."""
    x = large(left, group, block)
    y = x if left is right else large(right, group, block)
    asked = _parts(_parts(links.select(F.col(a).alias("_a"), F.col(b).alias("_c")), "_a", x, "_x"), "_c", y, "_y")
    asked = asked.select("_a", "_c", "_y", _every("_x").alias("_i")).select("_a", "_c", "_i", _every("_y").alias("_j"))
    side = lambda rows, groups, g, m, i: _dealt(rows.select(F.col(group).alias(g), F.col(member).alias(m)), g, m, groups, i)
    met = asked.join(side(left, x, "_a", "member_a", "_i"), ["_a", "_i"]).join(side(right, y, "_c", "member_b", "_j"), ["_c", "_j"])
    return met.where((F.col("_a") != F.col("_c")) | (F.col("member_a") < F.col("member_b"))).select("member_a", "member_b")


def within(rows: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """``member_a, member_b``, the smaller first: all pairs of members of one group."""
    several = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(group).alias("_s"), F.col(group).alias("_t"))
    return members(several, "_s", "_t", rows, rows, group, member, block)


def first_covering(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, order: str, id_: list[str], take: list[str], open_end: bool = True) -> DataFrame:
    """Each point with ``take`` of the first span in ``order`` of equal keys that covers it, from ``start``
    included to ``end`` excluded (null: open, if ``open_end``); nulls where none does."""
    until = F.col(end).isNull() if open_end else F.lit(False)
    near = points.select(*keys, *id_, at).join(small(spans.select(*keys, start, end, order, *[c for c in take if c not in (start, end, order)])), keys)
    near = near.where((F.col(at) >= F.col(start)) & (until | (F.col(at) < F.col(end))))
    best = near.groupBy(*id_).agg(F.min_by(F.struct(*take), F.struct(order)).alias("_b"))
    return points.join(best, id_, "left").select(*points.columns, *[F.col(f"_b.{c}").alias(c) for c in take])


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left lookup of unique keys; ``defaults`` fill what is missing."""
    joined = rows.join(small(dimension), key, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def nearest_within(targets: DataFrame, candidates: DataFrame, keys: list[str], id_: list[str], at: str, line: str, reach: int = 3) -> DataFrame:
    """Each target with the nearest candidate line of equal keys within ``reach`` of ``at``: the line itself,
    then one after, one before, two after and so on; targets without one keep a null ``line`` and ``delta``.

    Both sides are cut into bands of ``reach`` lines and joined on the bands that a target touches, so that the
    range join has equality keys, whatever the length of a file."""
    width = reach + 1
    band = lambda c: F.floor(c / width).cast("int")
    touched = F.explode(F.array_distinct(F.array(band(F.col(at) - reach), band(F.col(at)), band(F.col(at) + reach))))
    a = targets.select(*keys, *id_, at, touched.alias("_band"))
    b = candidates.select(*keys, F.col(line).alias("_line"), band(F.col(line)).alias("_band")).distinct()
    delta = F.col("_line") - F.col(at)
    near = a.join(b, [*keys, "_band"]).where(F.abs(delta) <= reach).withColumn("_d", delta)
    best = near.groupBy(*keys, *id_).agg(F.min_by(F.struct(F.col("_line").alias("line"), F.col("_d").alias("delta")), F.struct(F.abs("_d"), (F.col("_d") < 0).cast("int"))).alias("_b"))
    return targets.join(best, [*keys, *id_], "left").select(*targets.columns, F.col("_b.line").alias("nearest_line"), F.col("_b.delta").alias("delta"))


def tiered(rows: DataFrame, templates: DataFrame, id_: list[str], cwe: str, strategy: str, line: str | None = None) -> DataFrame:
    """Each row with its template: of those of its weakness and strategy, else its strategy, else its weakness,
    the first whose pattern the line matches, else the first.  ``templates`` has ``template_ord, cwe, strategy,
    pattern``.  Rows without any keep nulls."""
    t = templates.select(F.col("template_ord"), F.col("cwe").alias("_c"), F.col("strategy").alias("_s"), F.col("pattern").alias("_p"))
    same = F.coalesce(F.col(cwe) == F.col("_c"), F.lit(False))
    both = rows.join(small(t), F.col(cwe) == F.col("_c")).unionByName(rows.join(small(t), F.col(strategy) == F.col("_s")).where(~same))
    tier = F.when((F.col(cwe) == F.col("_c")) & (F.col(strategy) == F.col("_s")), 1).when(F.col(strategy) == F.col("_s"), 2).otherwise(3)
    # in the last tier the line does not count
    match = F.when(tier == 3, 0).when(F.coalesce(F.expr(f"regexp_like({line}, _p)"), F.lit(False)), 0).otherwise(1) if line else F.lit(0)
    best = both.groupBy(*id_).agg(F.min_by(F.struct("template_ord", tier.alias("tier")), F.struct(tier, match, "template_ord")).alias("_b"))
    return rows.join(best, id_, "left").select(*rows.columns, F.col("_b.template_ord").alias("template_ord"), F.col("_b.tier").alias("tier"))


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side and their ``fate``: fixed (before only), remaining or new (after only)."""
    both = before.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    seen = both.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    return seen.select(*keys, F.when(F.col("_a") == 0, "fixed").when(F.col("_b") == 0, "new").otherwise("remaining").alias("fate"))


def kept(before: DataFrame, after: DataFrame, keys: list[str], fixed: bool) -> DataFrame:
    """The rows before whose keys are gone after (``fixed``), or are still there."""
    return before.join(after.select(*keys).distinct(), keys, "left_anti" if fixed else "left_semi")


def by_path_or_name(rows: DataFrame, files: DataFrame, path: str, file: str) -> DataFrame:
    """Pairs of rows and files of equal path or equal base name: two equality joins instead of one on OR."""
    name = lambda c: F.element_at(F.split(c, r"[/\\]"), -1)
    a, b = rows.withColumn("_name", name(F.col(path))), files.withColumn("_fname", name(F.col(file)))
    exact = a.join(b, F.col(path) == F.col(file))
    other = a.join(b, (F.col("_name") == F.col("_fname")) & (F.col(path) != F.col(file)))
    return exact.unionByName(other).drop("_name", "_fname")


def prior(rows: DataFrame, keys: list[str], order: list[str], check: Column, reach: int = 3) -> Column:
    """True where one of the ``reach`` rows before passes the check."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, -1)
    return F.coalesce(F.max(check).over(w), F.lit(False))
