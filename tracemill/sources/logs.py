"""Readers and writers of event logs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.clean import normalize_columns

_ATTR = "struct<_key:string,_value:string>"
_KINDS = ("string", "date", "int", "float", "boolean")
_FIELDS = ",".join(f"{k}:array<{_ATTR}>" for k in _KINDS)
TRACE = f"struct<{_FIELDS},event:array<struct<{_FIELDS}>>>"

RESULT = "experiment_id string, log_id string, status string, algorithm_name string, config_hash string, hyperparameters map<string,double>, metrics map<string,double>, metric_statuses map<string,struct<status:string,error:string>>, runtime_seconds double, metadata struct<timestamp_utc:string>"


def _attributes(of: str):
    """All direct attributes of an element as one map; of repeated keys the last counts."""
    lists = [F.coalesce(F.col(f"{of}{k}"), F.array().cast(f"array<{_ATTR}>")) for k in _KINDS]
    pairs = F.filter(F.concat(*lists), lambda x: x["_key"].isNotNull())
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["_key"]), F.create_map(x["_key"], x["_value"])))


def read_xes(spark: SparkSession, path: str, max_traces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, cases) of ``.xes`` and ``.xes.gz`` files.

    A log's id is its file name. A trace without a name is called by its
    1-based place in the file. Timestamps that don't parse are null.
    ``max_traces`` is for looking at a log: that many traces per file.
    """
    schema = T._parse_datatype_string(TRACE)
    raw = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)
    # a file is one split: XML records keep their order inside it
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    named = raw.withColumn("_place", place).withColumn("attrs", _attributes(""))
    if max_traces is not None:
        named = named.where(F.col("_place") <= max_traces)
    log = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.xes(\.gz)?$", "")
    named = named.select(log.alias("log_id"), F.coalesce(F.col("attrs").getItem("concept:name"), F.col("_place").cast("string")).alias("case_id"), "attrs", "event")
    cases = named.select("log_id", "case_id", F.coalesce(F.size("event"), F.lit(0)).alias("event_count"), "attrs")
    e = named.select("log_id", "case_id", F.posexplode("event").alias("pos", "e")).withColumn("attrs", _attributes("e."))
    item = F.col("attrs").getItem
    events = e.select("log_id", "case_id", (F.col("pos") + 1).alias("event_index"), item("concept:name").alias("activity"), F.try_to_timestamp(item("time:timestamp")).alias("ts"), item("lifecycle:transition").alias("lifecycle"), "attrs")
    return events, cases.withColumn("event_count", F.greatest("event_count", F.lit(0)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An event log by the suffix of its path: .xes, .xes.gz, .csv or .parquet."""
    name = path.rstrip("/").lower()
    if name.endswith((".xes", ".xes.gz")):
        return read_xes(spark, path)[0]
    if name.endswith(".parquet"):
        return normalize_columns(spark.read.parquet(path))
    if name.endswith(".csv"):
        raw = normalize_columns(spark.read.option("header", True).csv(path))
        return raw.withColumn("ts", F.try_to_timestamp("ts"))
    raise ValueError(f"not an event log: {path} (.xes, .xes.gz, .csv and .parquet are read)")


def read_headers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Extensions, classifiers (their keys split at blanks) and globals of XES files."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return {
        "extensions": read("extension", "_name string, _prefix string, _uri string").toDF("name", "prefix", "uri"),
        "classifiers": read("classifier", "_name string, _keys string").select(F.col("_name").alias("name"), F.split("_keys", " +").alias("keys")),
        "globals": read("global", f"_scope string, string array<{_ATTR}>, date array<{_ATTR}>").select(F.col("_scope").alias("scope"), F.transform(F.concat(F.coalesce("string", F.array().cast(f"array<{_ATTR}>")), F.coalesce("date", F.array().cast(f"array<{_ATTR}>"))), lambda x: x["_key"]).alias("keys")),
    }


def write_xes(log: DataFrame, path: str) -> None:
    """One XES file per log under ``path/log_id=...``: traces by case, events by time, then input order."""
    attr = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    step = F.struct(F.col("ts").isNull().alias("late"), "ts", "event_index", "activity")
    steps = F.array_sort(F.collect_list(step))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = F.transform("s", lambda x: F.struct(F.array(attr("concept:name", x["activity"]), attr("lifecycle:transition", F.lit("complete"))).alias("string"), F.array(attr("time:timestamp", stamp(x["ts"]))).alias("date")))
    rows = log.groupBy("log_id", "case_id").agg(steps.alias("s")).select("log_id", "case_id", F.array(attr("concept:name", F.col("case_id"))).alias("string"), event.alias("event"))
    rows = rows.repartition("log_id").sortWithinPartitions("log_id", "case_id").drop("case_id")
    rows.write.partitionBy("log_id").format("xml").option("rowTag", "trace").option("rootTag", "log").mode("overwrite").save(path)


def read_results(spark: SparkSession, paths: list[str], excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(results with ``source``, count of corrupt files) of JSON files below the paths."""
    schema = RESULT + ", _corrupt_record string"
    raw = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(paths).withColumn("source", F.col("_metadata.file_path"))
    for x in excludes:
        raw = raw.where(~F.col("source").contains(x))
    bad = raw.where("_corrupt_record is not null and log_id is null")
    return raw.where("log_id is not null").drop("_corrupt_record"), bad.agg(F.count("*").alias("corrupt"))


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_log_cache(log: DataFrame, path: str) -> None:
    """A columnar copy, required columns first and the rest sorted, by log."""
    first = [c for c in ("case_id", "activity", "ts") if c in log.columns]
    rest = sorted(c for c in log.columns if c not in first and c != "log_id")
    log.select("log_id", *first, *rest).write.mode("overwrite").option("compression", "zstd").partitionBy("log_id").parquet(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
