"""An extension: the batch operators over streams of events and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import rules
from ..session import cut
from ..sources import parse


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, end`` of tumbling windows, ``by`` and ``n``.  On a stream, rows later than ``late`` after the
    latest seen are left out and a window's state is dropped then; on a table all rows count."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if events.isStreaming else rows
    return rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def read(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def once_each(findings: DataFrame, id_: str, at: str, late: str = "30 days") -> DataFrame:
    """Findings without redeliveries: the first of each id within the watermark."""
    rows = findings.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([id_]) if findings.isStreaming else rows.dropDuplicates([id_])


def scan_new_files(stream: DataFrame, into: str, checkpoint: str, key: str, text: str, lang: str):  # noqa: ANN201
    """Scans the files of each micro-batch with all rules and appends the findings; a batch that runs again
    overwrites its own folder."""
    def batch(rows: DataFrame, number: int) -> None:
        named = rows.withColumnRenamed(lang, "lang") if lang != "lang" else rows
        facts = cut(parse.facts(named, text=text, lang="lang", keep=(key,)))
        rules.scan(named, facts, key, text).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
