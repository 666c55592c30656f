"""Augmented child logs: coverage filters, subsamples, noise and truncation, for all logs at once.

Random choices come from hashes of (seed, keys): repeatable, and independent
of how Spark deals out the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import uniform
from tracemill.operators.inspect import validate_child_logs
from tracemill.operators.traces import CASE, distinct_variants, log_stats, traces


def _covering(counts: DataFrame, order: list, coverage: float) -> DataFrame:
    """Items (most frequent first) up to the one that reaches the coverage of ``n`` per log."""
    w = Window.partitionBy("log_id")
    run = F.sum("n").over(w.orderBy(F.desc("n"), *order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("before", run - F.col("n")).withColumn("total", F.sum("n").over(w)).where(F.col("before") < F.col("total") * coverage)


#: Characters of a tie's text (or hash) that bring it into a bucket.
BUCKET = 24


def _first_of_levels(kinds: DataFrame, levels: DataFrame, tie: str) -> DataFrame:
    """(log_id, variant_hash) of the first ``take`` variants, by ``tie``, of every level (log_id, n, m, take).

    Levels, at most the root of twice a log's cases each, are broadcast: most
    variants of a log are of one level. Those that are taken whole or not at all need no order. A log has one
    other level at most; its ties go into buckets by how they begin, buckets
    are counted, and only the variants of the bucket in which the level ends
    are ranked among each other.
    """
    found = kinds.join(F.broadcast(levels), ["log_id", "n"])
    whole = found.where(F.col("take") >= F.col("m")).select("log_id", "variant_hash")
    cut = found.where((F.col("take") > 0) & (F.col("take") < F.col("m"))).select("log_id", "variant_hash", "take", F.col(tie).alias("_tie"), F.substring(tie, 1, BUCKET).alias("_bucket"))
    sizes = cut.groupBy("log_id", "_bucket").agg(F.count("*").alias("_m"), F.max("take").alias("_take"))
    before = F.sum("_m").over(Window.partitionBy("log_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    sizes = sizes.withColumn("_left", F.col("_take") - before).where("_left > 0").select("log_id", "_bucket", "_m", "_left")
    near = cut.join(sizes, ["log_id", "_bucket"])
    rank = F.row_number().over(Window.partitionBy("log_id", "_bucket").orderBy("_tie", "variant_hash"))
    last = near.where("_left < _m").withColumn("_r", rank).where("_r <= _left")
    return whole.union(near.where("_left >= _m").select("log_id", "variant_hash")).union(last.select("log_id", "variant_hash"))


def filter_variant_coverage(log: DataFrame, coverage: float) -> DataFrame:
    """Cases of the most frequent variants (ties by their text) that cover the share of cases.

    The running sum goes over the distinct counts of variants, not the variants.
    """
    ordered = traces(log)
    kinds = distinct_variants(ordered).withColumn("text", F.array_join("trace", "\x1f"))
    by = Window.partitionBy("log_id")
    levels = kinds.groupBy("log_id", "n").agg(F.count("*").alias("m"))
    run = F.sum(F.col("n") * F.col("m")).over(by.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("m")
    levels = levels.withColumn("before", run).withColumn("total", F.sum(F.col("n") * F.col("m")).over(by))
    # variants are kept while what comes before them is less than the share
    take = F.least(F.greatest(F.ceil((F.col("total") * coverage - F.col("before")) / F.col("n")), F.lit(0)), F.col("m"))
    kept = _first_of_levels(kinds, levels.select("log_id", "n", "m", take.alias("take")), "text")
    cases = ordered.join(kept, ["log_id", "variant_hash"], "left_semi").select(*CASE)
    return log.join(cases, CASE, "left_semi")


def filter_top_activities(log: DataFrame, coverage: float) -> DataFrame:
    """Events of the most frequent activities that cover the share of events."""
    counts = log.where("activity is not null").groupBy("log_id", "activity").agg(F.count("*").alias("n"))
    return log.join(F.broadcast(_covering(counts, ["activity"], coverage).select("log_id", "activity")), ["log_id", "activity"], "left_semi")


def subsample_quotas(kinds: DataFrame, fraction: float) -> DataFrame:
    """Cases to keep of every variant: floors of the exact shares, the rest to the largest remainders (ties by count, then hash).

    A variant's share depends on its count alone, so shares and remainders are
    those of the distinct counts, and the rest is dealt out over these.
    """
    by = Window.partitionBy("log_id")
    exact = F.col("n") * F.lit(fraction)
    levels = kinds.groupBy("log_id", "n").agg(F.count("*").alias("m")).withColumn("base", F.floor(exact)).withColumn("remainder", F.round(exact - F.floor(exact), 9))
    total = F.greatest(F.bround(F.sum(F.col("n") * F.col("m")).over(by) * F.lit(fraction)).cast("long"), F.lit(1))
    levels = levels.withColumn("rest", total - F.sum(F.col("base") * F.col("m")).over(by))
    before = F.sum("m").over(by.orderBy(F.desc("remainder"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    levels = levels.withColumn("take", F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("m")))
    more = _first_of_levels(kinds, levels.select("log_id", "n", "m", "take"), "variant_hash").withColumn("more", F.lit(1))
    out = kinds.join(F.broadcast(levels.select("log_id", "n", "base")), ["log_id", "n"]).join(more, ["log_id", "variant_hash"], "left")
    return out.select("log_id", "variant_hash", "n", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


def subsample_variants(log: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Whole cases, as many of each variant as its quota, picked by hash."""
    ordered = traces(log)
    quotas = subsample_quotas(distinct_variants(ordered), fraction)
    rank = F.row_number().over(Window.partitionBy("log_id", "variant_hash").orderBy(F.xxhash64(F.lit(seed), "log_id", "case_id"), "case_id"))
    kept = ordered.withColumn("rank", rank).join(quotas.drop("n"), ["log_id", "variant_hash"]).where("rank <= quota").select(*CASE)
    return log.join(kept, CASE, "left_semi")


def inject_event_noise(log: DataFrame, probability: float, seed: int) -> DataFrame:
    """With the probability an event is skipped, doubled, followed by a random activity, or swaps its label with the next.

    An event that was swapped into is not drawn again: of a run of swap draws
    every second takes effect. Inserted events lie midway to the next event, or
    a second later. A case never loses all events: its first stays then. The
    activities of the logs are broadcast: a join by log, and the windows after
    it, would take all events of a log in one task.
    """
    by = Window.partitionBy(*CASE)
    w = by.orderBy("event_index")
    names = log.where("activity is not null").groupBy("log_id").agg(F.array_sort(F.collect_set("activity")).alias("names"))
    x = log.withColumn("u", uniform(seed, "log_id", "case_id", "event_index")).withColumn("v", uniform(seed + 1, "log_id", "case_id", "event_index"))
    drawn = F.when(F.col("u") < probability, F.floor(F.col("v") * 4)).otherwise(-1)
    x = x.withColumn("draw", drawn).withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_a", F.lead("activity").over(w)).withColumn("last", F.lead("event_index").over(w).isNull())
    x = x.withColumn("swap", (F.col("draw") == 3) & ~F.col("last"))
    # all windows share one sort: places in a run of swaps are distances from the event before it
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("place", F.row_number().over(w))
    start = F.coalesce(F.max(F.when(~F.col("swap"), F.col("place"))).over(upto), F.lit(0))
    x = x.withColumn("swap", F.col("swap") & ((F.col("place") - start) % 2 == 1))
    into = F.coalesce(F.lag("swap").over(w), F.lit(False))
    label = F.when(F.col("swap"), F.col("next_a")).when(into, F.lag("activity").over(w)).otherwise(F.col("activity"))
    x = x.withColumn("into", into).withColumn("new_a", label)
    act = F.when(F.col("into") | F.col("swap"), -1).otherwise(F.col("draw"))
    x = x.withColumn("act", act).withColumn("n_left", F.sum(F.when(F.col("act") == 0, 0).otherwise(1)).over(by))
    x = x.withColumn("act", F.when((F.col("n_left") == 0) & (F.col("place") == 1), -1).otherwise(F.col("act")))
    mid = F.timestamp_micros(F.coalesce(((F.unix_micros("ts") + F.unix_micros("next_ts")) / 2).cast("long"), F.unix_micros("ts") + 1_000_000))
    other = F.element_at("names", (F.floor(uniform(seed + 2, "log_id", "case_id", "event_index") * F.size("names")) + 1).cast("int"))
    same = F.struct(F.col("new_a").alias("activity"), "ts")
    more = lambda a: F.struct(a.alias("activity"), mid.alias("ts"))
    made = F.when(F.col("act") == 0, F.array().cast("array<struct<activity:string,ts:timestamp>>")).when(F.col("act") == 1, F.array(same, more(F.col("new_a")))).when(F.col("act") == 2, F.array(same, more(other))).otherwise(F.array(same))
    n_made = F.when(F.col("act") == 0, 0).when(F.col("act").isin(1, 2), 2).otherwise(1)
    x = x.withColumn("before", F.sum(n_made).over(upto) - n_made)
    out = x.join(F.broadcast(names), "log_id", "left").select(*CASE, "before", F.posexplode(made).alias("k", "e"))
    return out.select(*CASE, "e.activity", "e.ts", (F.col("before") + F.col("k") + 1).cast("int").alias("event_index"))


def truncate_traces(log: DataFrame, k: int) -> DataFrame:
    """The first ``k`` events of every case by time."""
    w = Window.partitionBy(*CASE).orderBy(F.col("ts").asc_nulls_last(), "event_index")
    return log.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


# Operator, parameter, kind of child and condition of the default plan.
PLAN = (
    ("variant_coverage", 0.8, False, "always"), ("subsample", 0.5, False, "always"), ("noise", 0.05, False, "always"), ("subsample", 0.25, False, "large"), ("truncate", 50.0, False, "long"),
    ("variant_coverage", 0.5, True, "stress"), ("noise", 0.2, True, "stress"), ("top_activities", 0.8, True, "stress"),
)


def token(operator: Column, value: Column) -> Column:
    short = F.when(operator == "variant_coverage", "cov").when(operator == "subsample", "sub").when(operator == "noise", "noise").when(operator == "truncate", "trunc").otherwise("top")
    return F.concat(short, F.lpad(F.bround(value * F.when(operator == "truncate", 1).otherwise(100)).cast("int").cast("string"), 3, "0"))


def child_seed(base: int, parent: Column, operator: Column, value: Column) -> Column:
    """A seed from the hash of base seed, parent, operator and parameter."""
    text = F.concat_ws("|", F.lit(str(base)), parent, operator, F.format_string("%.4f", value))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def augmentation_plan(stats: DataFrame, stress: bool = False, large: int = 10_000, long: float = 40.0, base_seed: int = 1) -> DataFrame:
    """The children planned for every parent, with id and seed."""
    spark = stats.sparkSession
    spec = F.broadcast(spark.createDataFrame(list(PLAN), "operator string, parameter double, stress boolean, condition string"))
    c = F.col("condition")
    holds = (c == "always") | ((c == "large") & (F.col("n_traces") >= large)) | ((c == "long") & (F.col("mean_trace_length") >= long)) | ((c == "stress") & F.lit(stress))
    out = stats.select(F.col("log_id").alias("parent"), "n_traces", "mean_trace_length").join(spec, holds)
    out = out.withColumn("seed", child_seed(base_seed, F.col("parent"), F.col("operator"), F.col("parameter")))
    return out.select("parent", "operator", "parameter", "stress", F.concat(F.lit("aug_"), "parent", F.lit("__"), token(F.col("operator"), F.col("parameter")), F.lit("__s"), F.col("seed").cast("string")).alias("log_id"), "seed")


def augment_logs(log: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The children of the three default operators of every parent, and a manifest of accepted and rejected ones."""
    made = {"cov080": filter_variant_coverage(log, 0.8), "sub050": subsample_variants(log, 0.5, seed), "noise005": inject_event_noise(log, 0.05, seed)}
    out = None
    for name, child in made.items():
        child = child.select(F.concat(F.lit("aug_"), "log_id", F.lit(f"__{name}__s{seed}")).alias("log_id"), "case_id", "activity", "ts", "event_index")
        out = child if out is None else out.unionByName(child)
    stats = log_stats(traces(out), out)
    manifest = stats.join(validate_child_logs(stats), "log_id")
    return out, manifest
