"""Streaming ingestion of run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.sources.logs import RESULT

KEY = ["log_id", "config_hash"]


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """New result files as a stream, with ``at`` (the result's own time, null if it has none) and ``source``."""
    raw = spark.readStream.schema(RESULT).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    return raw.withColumn("at", F.try_to_timestamp("metadata.timestamp_utc")).withColumn("source", F.col("_metadata.file_path")).where("log_id is not null")


def result_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """The first row per (log, configuration) inside the watermark, for sinks that cannot look back; later than ``delay`` is lost."""
    return arrivals(spark, path).where("at is not null").withWatermark("at", delay).dropDuplicatesWithinWatermark(KEY)


def committed(spark: SparkSession, table: str, before: int | None = None) -> list[str]:
    """The finished batch folders of ``table``, of batches below ``before`` if given."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and (before is None or int(name[9:]) < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(status.getPath().toString())
    return sorted(found)


def read_ingested(spark: SparkSession, table: str) -> DataFrame | None:
    """The ingested rows with their ``batch_id``; none before the first batch has been finished. Unfinished batches are not seen."""
    folders = committed(spark, table)
    return spark.read.option("basePath", table).parquet(*folders) if folders else None


def upsert(batch: DataFrame, batch_id: int, table: str) -> None:
    """Write a batch's new (log, configuration) rows to ``table/batch_id=...``.

    The first arrival counts: what earlier batches hold is left alone, in
    whatever order the results were made, and of several rows in a batch the
    one of the earliest time (none comes last), then source. Rows without a
    config_hash are all kept. A batch that is run again writes its own folder
    anew, from the same earlier batches: the table does not change.
    """
    spark = batch.sparkSession
    order = Window.partitionBy(*KEY).orderBy(F.col("at").asc_nulls_last(), "source")
    first = batch.withColumn("_r", F.when(F.col("config_hash").isNull(), 1).otherwise(F.row_number().over(order))).where("_r = 1").drop("_r")
    folders = committed(spark, table, batch_id)
    if folders:
        known = spark.read.parquet(*folders).select(*KEY)
        first = first.join(known, KEY, "left_anti").select(*batch.columns)
    first.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take all new result files of ``path`` into ``table``; late results count, known (log, configuration) pairs don't.

    The table is the state, so nothing is forgotten, and each batch reads two
    columns of it. Start it again with the same checkpoint for later files or
    after a failure.
    """
    return arrivals(spark, path).writeStream.foreachBatch(lambda batch, n: upsert(batch, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
