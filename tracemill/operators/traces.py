"""Cases, traces and variants of many logs at once.

Two orders are in use, as in the definitions: traces follow (timestamp, event
index), directly-follows pairs follow the event index alone. Null activities
are skipped in traces, but events with one still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import entropy, quantiles

CASE = ["log_id", "case_id"]


def in_time() -> Column:
    """Sort key by time: null timestamps last, then the event index."""
    return F.struct(F.col("ts").isNull().alias("late"), F.col("ts"), F.col("event_index"))


def case_features(log: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per case: event_count, first/last activity, unique activities, start, end, duration in hours.

    With a case table its rows are kept by a left join, so that a case without
    events has nulls.
    """
    named = F.when(F.col("activity").isNotNull(), in_time())
    out = log.groupBy(*CASE).agg(
        F.count("*").alias("event_count"),
        F.min_by("activity", named).alias("first_activity"),
        F.max_by("activity", named).alias("last_activity"),
        F.size(F.collect_set("activity")).cast("long").alias("unique_activities"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )
    out = out.withColumn("duration_hours", (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(3.6e9))
    return out if cases is None else cases.join(out, CASE, "left")


def traces(log: DataFrame) -> DataFrame:
    """log_id, case_id, n_events and the ordered activities as array ``trace``; ``variant_hash`` stands for it in shuffles."""
    steps = F.array_sort(F.collect_list(F.when(F.col("activity").isNotNull(), F.struct(in_time().alias("at"), "activity"))))
    out = log.groupBy(*CASE).agg(F.count("*").alias("n_events"), steps.alias("s"))
    return out.select(*CASE, "n_events", F.col("s.activity").alias("trace")).withColumn("variant_hash", F.sha2(F.array_join("trace", "\x1f"), 256))


def variants(log: DataFrame) -> DataFrame:
    """log_id, case_id and the variant as text, steps joined by `` > ``."""
    return traces(log).select(*CASE, F.array_join("trace", " > ").alias("variant"))


def parse_variant(text: Column) -> Column:
    """The steps of a variant's text: split at ``>``, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ">"), lambda x: F.trim(x)), lambda x: x != "")


def distinct_variants(ordered: DataFrame) -> DataFrame:
    """log_id, variant_hash, trace and n (its cases) of every distinct trace."""
    return ordered.groupBy("log_id", "variant_hash").agg(F.count("*").alias("n"), F.first("trace").alias("trace"))


def frequency_steps(kinds: DataFrame) -> DataFrame:
    """log_id, n, m and before: how many variants of a log have n cases, and how many have more.

    Variants of equal count are one row, so the window goes over the distinct
    counts of a log, of which there are fewer than the root of twice its cases.
    """
    steps = kinds.groupBy("log_id", "n").agg(F.count("*").alias("m"))
    by = Window.partitionBy("log_id").orderBy(F.desc("n"))
    return steps.withColumn("before", F.sum("m").over(by) - F.col("m"))


def variant_counts(kinds: DataFrame) -> DataFrame:
    """Shares of the most frequent variants per log; the cutoff of a percentage is truncated."""
    steps = frequency_steps(kinds).withColumn("v", F.sum("m").over(Window.partitionBy("log_id")))
    n, m = F.col("n"), F.col("m")
    all_n, all_m = F.sum(n * m), F.sum(m)
    taken = lambda upto: F.least(m, F.greatest(upto - F.col("before"), F.lit(0)))
    share = lambda upto: F.sum(n * taken(upto)) / all_n
    tops = [share(F.floor(F.col("v") * F.lit(p) / 100)).alias(f"ratio_top_{p}_variants") for p in (1, 5, 10, 20, 50, 75)]
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    spread = (big(m) * big(m * n * n) - big(m * n) * big(m * n)).cast("double") / (big(m) * big(m)).cast("double")
    return steps.groupBy("log_id").agg(
        all_n.alias("n_traces"),
        all_m.alias("n_unique_traces"),
        (all_m / all_n).alias("ratio_unique_traces_per_trace"),
        (F.max("n") / all_n).alias("ratio_most_common_variant"),
        *tops,
        share(F.lit(3)).alias("ratio_top_3_variants_custom"),
        (all_n / all_m).alias("mean_variant_occurrence"),
        F.sqrt(spread).alias("std_variant_occurrence"),
        F.greatest(F.log2(all_n) - F.sum(m * n * F.log2(n)) / all_n, F.lit(0.0)).alias("trace_entropy"),
    )


def log_stats(ordered: DataFrame, log: DataFrame) -> DataFrame:
    """traces, events, activities, variants and mean trace length per log."""
    a = ordered.groupBy("log_id").agg(F.count("*").alias("n_traces"), F.sum("n_events").alias("n_events"), F.count_distinct("variant_hash").alias("n_variants"), F.avg("n_events").alias("mean_trace_length"))
    return a.join(log.groupBy("log_id").agg(F.count_distinct("activity").alias("n_activities")), "log_id")


def trace_length_stats(ordered: DataFrame) -> DataFrame:
    return quantiles(ordered, ["log_id"], "n_events", "trace_len")


def activity_stats(log: DataFrame) -> DataFrame:
    """Moments, entropy and shares of the activity counts per log."""
    n = log.groupBy("log_id").agg(F.count("*").alias("n_events"))
    counts = log.where("activity is not null").groupBy("log_id", "activity").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.75)))
    out = counts.groupBy("log_id").agg(
        F.count("*").alias("n_unique_activities"),
        F.max("n").cast("double").alias("activities_max"),
        F.avg("n").alias("activities_mean"),
        F.stddev_pop("n").alias("activities_std"),
        (q[1] - q[0]).alias("activities_iqr"),
        entropy("n").alias("activity_entropy_custom"),
        F.avg(F.when(F.col("n") <= 1, 1.0).otherwise(0.0)).alias("rare_activity_ratio_custom"),
    )
    return out.join(n, "log_id").withColumn("most_common_activity_share_custom", F.col("activities_max") / F.col("n_events")).drop("n_events")


def end_point_stats(cases: DataFrame, column: str, prefix: str) -> DataFrame:
    """Distinct values, moments, entropy and top share of first or last activities (``prefix`` start or end)."""
    total = cases.groupBy("log_id").agg(F.count("*").alias("n_traces"))
    counts = cases.where(F.col(column).isNotNull()).groupBy("log_id", column).agg(F.count("*").alias("n"))
    out = counts.groupBy("log_id").agg(
        F.count("*").alias(f"n_unique_{prefix}_activities"),
        F.max("n").cast("double").alias(f"{prefix}_activities_max"),
        F.avg("n").alias(f"{prefix}_activities_mean"),
        F.stddev_pop("n").alias(f"{prefix}_activities_std"),
        entropy("n").alias(f"{prefix}_event_entropy_custom"),
    )
    return out.join(total, "log_id").withColumn(f"most_common_{prefix}_share_custom", F.col(f"{prefix}_activities_max") / F.col("n_traces")).drop("n_traces")


def repetition_sums() -> tuple[Column, Column]:
    """Aggregates of a log's variants (trace, n): see ``repetition``."""
    t = F.col("trace")
    runs = F.size(F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))
    kinds_n = F.size(F.array_distinct(t))
    n = F.sum("n")
    return (F.sum(F.col("n") * (F.size(t) - kinds_n)) / n).alias("avg_event_repetition_intra_trace"), (F.sum(F.when(runs > kinds_n, F.col("n")).otherwise(0)) / n).alias("relative_number_of_traces_with_repetition")


def repetition(kinds: DataFrame) -> DataFrame:
    """Repeats per trace and the share of traces where an activity recurs after another one.

    Such a trace has more runs of equal activities than distinct activities.
    """
    return kinds.groupBy("log_id").agg(*repetition_sums())


def length_two_loops_sum() -> Column:
    """Aggregate of a log's variants (trace, n): see ``length_two_loops``."""
    t = F.col("trace")
    found = F.size(F.filter(t, lambda x, i: (x == F.get(t, i + 2)) & (x != F.get(t, i + 1))))
    return F.sum(F.col("n") * found).alias("length_two_loops_custom")


def length_two_loops(kinds: DataFrame) -> DataFrame:
    """Number of steps a, b, a with a <> b over all traces of a log."""
    return kinds.groupBy("log_id").agg(length_two_loops_sum())


def prefixes(kinds: DataFrame) -> DataFrame:
    """log_id, n, k, state, at, next: every prefix of every variant, its last activity and the one that follows.

    A prefix is known by 128 bits that are folded step by step: each step adds
    the hash of its place and activity to those before (by exclusive or), so
    that a trace gives a key of fixed size a step, however long it is. The
    variants lie by (log_id, variant_hash) already; the window only sorts.
    """
    by = Window.partitionBy("log_id", "variant_hash").orderBy("k")
    steps = kinds.select("log_id", "variant_hash", "n", F.posexplode("trace").alias("k", "at"))
    fold = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "k", "at")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("log_id", "n", (F.col("k") + 1).alias("k"), F.struct(fold(1).alias("a"), fold(2).alias("b"), "k").alias("state"), "at", F.lead("at").over(by).alias("next"))


def prefix_entropies(kinds: DataFrame, ks: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Entropy of all prefixes of the distinct traces, and of the first k steps over all traces that are so long."""
    counts = prefixes(kinds).groupBy("log_id", "k", "state").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    counts = counts.select("log_id", "kinds", *(F.when(F.col("k") == k, F.col("n")).alias(f"n{k}") for k in ks))
    return counts.groupBy("log_id").agg(entropy("kinds").alias("prefix_entropy"), *(entropy(f"n{k}").alias(f"prefix_entropy_{k}_custom") for k in ks))


def prefix_entropy(kinds: DataFrame) -> DataFrame:
    """Entropy of all prefixes of the distinct traces."""
    return prefix_entropies(kinds, ())


def prefix_entropy_k(kinds: DataFrame, k: int) -> DataFrame:
    """Entropy of the first ``k`` steps over all traces that are so long."""
    return prefix_entropies(kinds, (k,)).drop("prefix_entropy").where(F.col(f"prefix_entropy_{k}_custom").isNotNull())
