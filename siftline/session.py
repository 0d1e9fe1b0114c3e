"""The session's shared settings: the checkpoint folder, and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints go to the folder named in ``spark.checkpoint.dir``.

    Only where neither the session nor the context names one, and the master is this very machine, a
    temporary folder is taken; on a cluster that is an error, since executors could not share it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siftline-checkpoints-")
    sc.setCheckpointDir(named)
    # files of tables that nothing refers to any more are removed, unless the session says otherwise
    if not sc._jsc.sc().conf().contains(_CLEAN):
        sc._jsc.sc().conf().set(_CLEAN, "true")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: what follows reads the files and survives the
    loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def commonest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` of largest ``n``, at most ``most`` and nearly so many wherever there are more.

    Rows come in the order of ``n``; those that tie where the limit falls come by their hash, so that the choice
    depends on the rows alone.  The limit is found digit by digit (power of two, part of it, then twelve bits of
    the hash at a time): only histograms of a few thousand lines go to the driver."""
    level = F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    part = F.floor((F.col(n) / F.pow(F.lit(2.0), level) - 1) * 4096).cast("int")
    hash_ = F.xxhash64(*[F.col(c) for c in counts.columns if c != n])
    digits = [-level, -part, *[F.shiftrightunsigned(hash_, 52 - 12 * i).bitwiseAND(F.lit(4095).cast("bigint")).cast("int") for i in range(5)]]
    room, kept, here = most, F.lit(False), F.col(n) > 0
    for digit in digits:
        histogram = sorted(map(tuple, counts.where(here).groupBy(digit.alias("d")).agg(F.count("*").alias("k")).collect()))
        first = next((d for (d, _), total in zip(histogram, accumulate(k for _, k in histogram), strict=True) if total > room), None)
        kept |= here & (F.lit(True) if first is None else digit < first)
        room -= sum(k for d, k in histogram if first is None or d < first)
        if first is None or room <= most // 64:
            break
        here &= digit == first
    return counts.where(kept)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with none of the taken, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once a context, where ``PYTHONPATH`` does not already
    name its folder: Spark serves a zip of it to the executors."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    named = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root.parent in named or _SHIPPED.get(id(sc)) == sc.applicationId:
        return
    place = Path(tempfile.mkdtemp(prefix="siftline-")) / "siftline.zip"
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(place))
    _SHIPPED[id(sc)] = sc.applicationId


_SHIPPED: dict[int, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files make fewer partitions than there are cores, dealt out evenly; any other as it is.

    Small or badly written files would else leave a costly stage to one task; at scale, inputs have more splits
    than there are cores, and nothing is moved."""
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df
