"""Process-log tables derived from the star-schema tables.

``event_log`` takes a user's day as a case; ``runs`` takes (supplier, part)
cells as discovery runs. Both use integer arithmetic only, so that any engine
derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, case_id, activity, ts, event_index from ``events``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "user_id")
    k = (F.col("user_id") % 8).cast("int")
    day = F.col("ts").cast("date")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    log = F.when(k < 3, F.concat(F.lit("log"), k.cast("string"))).when(k < 6, F.concat(F.lit("aug_log"), (k - 3).cast("string"), F.lit("__sub050__s1"))).otherwise(F.concat(F.lit("syn_gedi_t"), k.cast("string")))
    case = F.concat(F.col("user_id").cast("string"), F.lit("_"), day.cast("string"))
    return e.select(log.alias("log_id"), case.alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.row_number().over(order).alias("event_index"))


EVENT_LOG = """b AS (SELECT event_id, ts, event_type, user_id, CAST(user_id % 8 AS INT) AS k FROM events),
event_log AS (SELECT CASE WHEN k < 3 THEN concat('log', CAST(k AS VARCHAR)) WHEN k < 6 THEN concat('aug_log', CAST(k - 3 AS VARCHAR), '__sub050__s1') ELSE concat('syn_gedi_t', CAST(k AS VARCHAR)) END AS log_id,
  concat(CAST(user_id AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) AS case_id, event_type AS activity, ts,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS event_index FROM b)"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event logs of the logs that ``runs`` names: a user's day is a case of one of 24 logs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "user_id")
    k = (F.col("user_id") % 24).cast("int")
    day = F.col("ts").cast("date")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    case = F.concat(F.col("user_id").cast("string"), F.lit("_"), day.cast("string"))
    return e.select(run_log(k).alias("log_id"), case.alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.row_number().over(order).alias("event_index"))


def run_log(k: Column) -> Column:
    """The id of the k-th of the 24 logs of ``runs``: real, augmented, synthetic."""
    return F.when(k < 8, F.concat(F.lit("log"), k.cast("string"))).when(k < 16, F.concat(F.lit("aug_log"), (k - 8).cast("string"), F.lit("__noise005__s1"))).otherwise(F.concat(F.lit("syn_gedi_t"), k.cast("string")))


RUN_EVENTS = """e0 AS (SELECT event_id, ts, event_type, user_id, CAST(user_id % 24 AS INT) AS k FROM events),
run_events AS (SELECT CASE WHEN k < 8 THEN concat('log', CAST(k AS VARCHAR)) WHEN k < 16 THEN concat('aug_log', CAST(k - 8 AS VARCHAR), '__noise005__s1') ELSE concat('syn_gedi_t', CAST(k AS VARCHAR)) END AS log_id,
  concat(CAST(user_id AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) AS case_id, event_type AS activity, ts FROM e0)"""


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a lifecycle: long cases (one per user) of starts and completes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.concat(F.lit("log"), (F.col("user_id") % 8).cast("string")).alias("log_id"),
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.when(F.col("event_id") % 2 == 0, "start").otherwise("complete").alias("lifecycle"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.row_number().over(order).alias("event_index"),
    )


LIFECYCLE_LOG = """lifecycle_log AS (SELECT concat('log', CAST(user_id % 8 AS VARCHAR)) AS log_id, CAST(user_id AS VARCHAR) AS case_id, event_type AS activity,
  CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'complete' END AS lifecycle, ts, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS event_index FROM events)"""

MEASURES = ("fitness", "precision", "generalization", "simplicity")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery runs from ``lineitem``: log, configuration, status, measures, and given predictions ``pred_*``."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey")
    cells = li.groupBy((F.col("l_suppkey") % 24).cast("int").alias("k"), (F.col("l_partkey") % 40).cast("int").alias("c")).agg(F.sum("l_orderkey").cast("long").alias("h"), F.sum("l_partkey").cast("long").alias("g"))
    k, c, h, g = (F.col(x) for x in "kchg")
    status = F.when(h % 13 == 0, "timeout").when(h % 29 == 0, "failed").otherwise("success")
    d = cells.withColumn("status", status)
    ok = F.col("status") == "success"
    mille = lambda x: (x % 1000).cast("double") / 1000
    return d.select(
        run_log(k).alias("log_id"),
        F.concat(F.lit("alg"), (c % 4).cast("string")).alias("algorithm"),
        F.when(c % 4 != 0, c.cast("double") / 40).alias("p1"),
        F.when((c % 4 != 0) & (c % 4 != 1), (c % 5).cast("double")).alias("p2"),
        F.concat(F.lit("cfg"), c.cast("string")).alias("config_hash"),
        F.when(c < 4, "v6_baseline").when(c > 36, "v6_hpo").otherwise("v6_explore").alias("experiment_id"),
        "status",
        ((g % 600).cast("double") / 10).alias("runtime_seconds"),
        F.when(ok, mille(h * 7)).alias("fitness"),
        F.when(ok & (g % 11 != 0), mille(h * 13 + g)).alias("precision"),
        F.when(ok, mille(h * 17)).alias("generalization"),
        F.when(ok & (g % 23 != 0), mille(g * 19)).alias("simplicity"),
        mille(h * 31 + g * 5).alias("pred_fitness"),
        mille(h * 29 + g * 3).alias("pred_precision"),
        mille(h * 23 + g * 7).alias("pred_generalization"),
        mille(h * 19 + g * 11).alias("pred_simplicity"),
    )


RUNS = """c0 AS (SELECT CAST(l_suppkey % 24 AS INT) AS k, CAST(l_partkey % 40 AS INT) AS c, CAST(SUM(l_orderkey) AS BIGINT) AS h, CAST(SUM(l_partkey) AS BIGINT) AS g FROM lineitem GROUP BY 1, 2),
d0 AS (SELECT k, c, h, g, CASE WHEN h % 13 = 0 THEN 'timeout' WHEN h % 29 = 0 THEN 'failed' ELSE 'success' END AS status FROM c0),
runs AS (SELECT CASE WHEN k < 8 THEN concat('log', CAST(k AS VARCHAR)) WHEN k < 16 THEN concat('aug_log', CAST(k - 8 AS VARCHAR), '__noise005__s1') ELSE concat('syn_gedi_t', CAST(k AS VARCHAR)) END AS log_id,
  concat('alg', CAST(c % 4 AS VARCHAR)) AS algorithm, CASE WHEN c % 4 = 0 THEN NULL ELSE CAST(c AS DOUBLE) / 40 END AS p1,
  CASE WHEN c % 4 IN (0, 1) THEN NULL ELSE CAST(c % 5 AS DOUBLE) END AS p2, concat('cfg', CAST(c AS VARCHAR)) AS config_hash,
  CASE WHEN c < 4 THEN 'v6_baseline' WHEN c > 36 THEN 'v6_hpo' ELSE 'v6_explore' END AS experiment_id, status, CAST(g % 600 AS DOUBLE) / 10 AS runtime_seconds,
  CASE WHEN status = 'success' THEN CAST((h * 7) % 1000 AS DOUBLE) / 1000 END AS fitness,
  CASE WHEN status = 'success' AND g % 11 <> 0 THEN CAST((h * 13 + g) % 1000 AS DOUBLE) / 1000 END AS precision,
  CASE WHEN status = 'success' THEN CAST((h * 17) % 1000 AS DOUBLE) / 1000 END AS generalization,
  CASE WHEN status = 'success' AND g % 23 <> 0 THEN CAST((g * 19) % 1000 AS DOUBLE) / 1000 END AS simplicity,
  CAST((h * 31 + g * 5) % 1000 AS DOUBLE) / 1000 AS pred_fitness, CAST((h * 29 + g * 3) % 1000 AS DOUBLE) / 1000 AS pred_precision,
  CAST((h * 23 + g * 7) % 1000 AS DOUBLE) / 1000 AS pred_generalization, CAST((h * 19 + g * 11) % 1000 AS DOUBLE) / 1000 AS pred_simplicity FROM d0)"""
