"""Data quality of event logs, manifests and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.traces import CASE

MIN_TRACES, MIN_ACTIVITIES, MIN_VARIANTS = 10, 3, 2


def validity_report(raw: DataFrame) -> DataFrame:
    """Missing values, timestamps that don't parse and suspicious labels, per log (text column ``ts_text``, parsed ``ts``)."""
    a = F.col("activity")
    suspicious = (F.length(a) > 256) | a.rlike(r"[\r\n\t]") | (F.trim(a) != a)
    n = F.count("*")
    return raw.groupBy("log_id").agg(
        n.alias("n_rows"),
        F.count_if(F.col("case_id").isNull()).alias("missing_case"),
        F.count_if(a.isNull()).alias("missing_activity"),
        F.count_if(F.col("ts_text").isNull()).alias("missing_time"),
        F.count_if(F.col("ts").isNull() & F.col("ts_text").isNotNull()).alias("parse_failures"),
        F.count_if(suspicious).alias("suspicious_labels"),
        (F.count_if(a.isNull()) * 100 / n).alias("missing_activity_percent"),
    )


def inspect_log(log: DataFrame, dfg: DataFrame, ordered: DataFrame) -> DataFrame:
    """Sizes and oddities of every log: repeated timestamps, disorder, one-event cases, longest trace."""
    w = Window.partitionBy(*CASE).orderBy("event_index")
    steps = log.withColumn("before", F.lag("ts").over(w))
    per_case = steps.groupBy(*CASE).agg(F.count("*").alias("n"), F.count_if(F.col("before") == F.col("ts")).alias("same"), F.max(F.when(F.col("ts") < F.col("before"), 1).otherwise(0)).alias("back"))
    cases = per_case.groupBy("log_id").agg(
        F.sum("n").alias("events"), F.count("*").alias("cases"), F.sum("same").alias("duplicate_timestamp_events"), F.sum("back").cast("long").alias("non_monotonic_cases"), F.count_if(F.col("n") == 1).alias("single_event_cases"), F.max("n").alias("max_trace_length")
    )
    acts = log.groupBy("log_id").agg(F.count_distinct("activity").alias("activities"))
    kinds = ordered.groupBy("log_id").agg(F.count_distinct("variant_hash").alias("variants"))
    arcs = dfg.groupBy("log_id").agg(F.count("*").alias("dfg_edges"))
    out = cases.join(acts, "log_id").join(kinds, "log_id").join(arcs, "log_id", "left").fillna(0, ["dfg_edges"])
    return out.withColumn("large_vocabulary", F.col("activities") > 500)


def lifecycle_pairs(log: DataFrame) -> DataFrame:
    """First-in first-out pairs of start and complete per (case, activity), with their duration in seconds.

    A running balance of starts and completes falls below its earlier minimum
    exactly at completes that nothing waits for; they consume nothing. The
    k-th other complete belongs to the k-th start.
    """
    keys = [*CASE, "activity"]
    w = Window.partitionBy(*keys).orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.lower("lifecycle")
    step = F.when(kind == "start", 1).when(kind == "complete", -1).otherwise(0)
    b = log.where(step != 0).withColumn("step", step).withColumn("balance", F.sum("step").over(w))
    b = b.withColumn("unmatched", F.greatest(F.lit(0), -F.min("balance").over(w)))
    prior = F.coalesce(F.lag("unmatched").over(Window.partitionBy(*keys).orderBy("event_index")), F.lit(0))
    b = b.withColumn("matched", (F.col("step") == -1) & (F.col("unmatched") == prior))
    order = Window.partitionBy(*keys, "step", "matched").orderBy("event_index")
    b = b.withColumn("k", F.row_number().over(order))
    s = b.where("step = 1").select(*keys, "k", F.col("ts").alias("start_ts"), F.col("event_index").alias("start_index"))
    c = b.where("matched").select(*keys, "k", F.col("ts").alias("complete_ts"), F.col("event_index").alias("complete_index"))
    return s.join(c, [*keys, "k"]).withColumn("duration_seconds", (F.unix_micros("complete_ts") - F.unix_micros("start_ts")) / F.lit(1e6))


def interval_quality(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """green, yellow or red per log by how well starts and completes pair, with reasons."""
    kind = F.lower("lifecycle")
    n = log.groupBy("log_id").agg(F.count_if(kind == "start").alias("starts"), F.count_if(kind == "complete").alias("completes"))
    p = pairs.groupBy("log_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("duration_seconds") < 0).alias("negative"), F.count_if(F.col("duration_seconds") == 0).alias("zero"))
    j = n.join(p, "log_id", "left").fillna(0, ["pairs", "negative", "zero"])
    total = F.col("starts") + F.col("completes")
    j = j.withColumn("pair_ratio", F.when(total > 0, 2 * F.col("pairs") / total)).withColumn("zero_ratio", F.when(F.col("pairs") > 0, F.col("zero") / F.col("pairs")))
    reasons = F.array_compact(F.array(F.when(F.col("pair_ratio") < 0.999, "low_pair_ratio"), F.when(F.col("negative") > 0, "negative_durations"), F.when(F.col("zero_ratio") > 0.01, "many_zero_durations")))
    j = j.withColumn("reasons", F.array_join(reasons, ","))
    level = F.when((F.col("pairs") == 0) | (F.col("negative") > 0), "red").when(F.col("reasons") != "", "yellow").otherwise("green")
    return j.withColumn("quality", level)


def lifecycle_values(log: DataFrame) -> DataFrame:
    return log.groupBy("log_id", F.coalesce(F.lower("lifecycle"), F.lit("<missing>")).alias("value")).agg(F.count("*").alias("n"))


def log_summary(log: DataFrame, ordered: DataFrame) -> DataFrame:
    """Events, cases, activities, time span, events per case and variants."""
    a = log.groupBy("log_id").agg(F.count("*").alias("events"), F.count_distinct("activity").alias("activities"), F.min("ts").alias("min_timestamp"), F.max("ts").alias("max_timestamp"))
    b = ordered.groupBy("log_id").agg(F.count("*").alias("cases"), F.bround(F.avg("n_events"), 3).alias("events_per_case_mean"), F.min("n_events").alias("events_per_case_min"), F.max("n_events").alias("events_per_case_max"), F.count_distinct("variant_hash").alias("variants"))
    return a.join(b, "log_id")


def child_rejection(traces: Column, activities: Column, variants: Column) -> Column:
    """The first reason to reject a child log, or null."""
    text = lambda what, n, least: F.concat(F.lit(f"too few {what}: "), n.cast("string"), F.lit(f" < {least}"))
    return F.when(traces < MIN_TRACES, text("traces", traces, MIN_TRACES)).when(activities < MIN_ACTIVITIES, text("activities", activities, MIN_ACTIVITIES)).when(variants < MIN_VARIANTS, text("variants", variants, MIN_VARIANTS))


def validate_child_logs(stats: DataFrame) -> DataFrame:
    """log_id, accepted and reason from log statistics."""
    out = stats.withColumn("reason", child_rejection(F.col("n_traces"), F.col("n_activities"), F.col("n_variants")))
    return out.select("log_id", F.col("reason").isNull().alias("accepted"), "reason")


def validate_manifest(manifest: DataFrame, required: tuple[str, ...], paths: tuple[str, ...], root: str) -> DataFrame:
    """(row_id, rule, value) for empty required fields, repeated header rows and paths outside ``root``."""
    found = []
    for c in required:
        found.append(manifest.where(F.coalesce(F.trim(c), F.lit("")) == "").select("row_id", F.lit(f"missing_{c}").alias("rule"), F.col(c).cast("string").alias("value")))
        found.append(manifest.where(F.col(c) == c).select("row_id", F.lit("header_row"), F.col(c).cast("string")))
    for c in paths:
        found.append(manifest.where(F.col(c).startswith("/") & ~F.col(c).startswith(root)).select("row_id", F.lit("path_outside_root"), F.col(c)))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def verify_inventory(inventory: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Issues of an inventory (log_id, kind, path, sha256): counts per kind, repeated ids, malformed hashes."""
    spark = inventory.sparkSession
    want = spark.createDataFrame(list(expected.items()), "kind string, expected long")
    got = inventory.groupBy("kind").agg(F.count("*").alias("n"))
    counts = want.join(got, "kind", "left").where(F.coalesce("n", F.lit(0)) != F.col("expected"))
    text = F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" of "), F.col("expected").cast("string"))
    issues = counts.select(F.lit("row_count").alias("rule"), F.col("kind").alias("subject"), text.alias("value"))
    twice = inventory.groupBy("log_id").agg(F.count("*").alias("n")).where("n > 1")
    issues = issues.union(twice.select(F.lit("repeated_id"), "log_id", F.col("n").cast("string")))
    return issues.union(inventory.where(~F.col("sha256").rlike("^[0-9a-f]{64}$")).select(F.lit("malformed_hash"), "log_id", "sha256"))


def receipts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, digest) of tables; the digest doesn't hang on row order."""
    rows = []
    for name, df in tables.items():
        row = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns))
        part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
        rows.append(df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "n_rows", "digest"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def compare_receipts(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose receipt is missing on a side or differs."""
    a, b = ledger.select("name", F.struct("n_rows", "digest").alias("x")), now.select("name", F.struct("n_rows", "digest").alias("y"))
    j = a.join(b, "name", "full_outer")
    state = F.when(F.col("x").isNull(), "unexpected").when(F.col("y").isNull(), "missing").when(F.col("x") != F.col("y"), "differs")
    return j.withColumn("state", state).where("state is not null").select("name", "state")


def declared_vs_observed(declared: DataFrame, stats: DataFrame) -> DataFrame:
    """Declared trace and event counts next to measured ones."""
    j = declared.join(stats, "log_id", "left")
    return j.select("log_id", "declared_traces", "n_traces", "declared_events", "n_events", F.coalesce((F.col("declared_traces") == F.col("n_traces")) & (F.col("declared_events") == F.col("n_events")), F.lit(False)).alias("agrees"))


