"""The 48-feature vector of every log, and other per-log feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import entropy
from tracemill.operators import dfg as G
from tracemill.operators import traces as T

# The features in their canonical order.
FEATURE_NAMES = (
    "rs4pd_distinct_traces rs4pd_total_traces rs4pd_trace_length_avg rs4pd_repetitions_intra_trace_avg rs4pd_distinct_events rs4pd_total_events "
    "rs4pd_start_events rs4pd_end_events rs4pd_flow_entropy rs4pd_flow_concurrency_ratio rs4pd_flow_density rs4pd_length_one_loops_count "
    "ratio_unique_traces_per_trace ratio_most_common_variant ratio_top_1_variants ratio_top_5_variants ratio_top_10_variants ratio_top_3_variants_custom trace_entropy "
    "trace_len_min trace_len_max trace_len_median trace_len_std trace_len_iqr trace_len_p90_custom "
    "start_activities_max end_activities_max start_event_entropy_custom end_event_entropy_custom most_common_start_share_custom most_common_end_share_custom "
    "activity_entropy_custom most_common_activity_share_custom rare_activity_ratio_custom "
    "number_of_arcs average_node_degree maximum_node_degree density dfg_entropy_variable_degree dfg_edge_entropy_custom top_dfg_edge_share_custom "
    "length_one_loops relative_number_of_traces_with_repetition avg_event_repetition_intra_trace length_two_loops_custom "
    "prefix_entropy prefix_entropy_2_custom prefix_entropy_3_custom"
).split()


def _cases(log: DataFrame) -> DataFrame:
    """log_id, n_events, trace, arcs and variant_hash of every case, from one grouping of the events.

    The trace follows time and skips null activities; arcs follow the event
    index and a null breaks them.
    """
    step = F.struct("event_index", F.col("ts").isNull().alias("late"), "ts", "activity")
    cases = log.groupBy(*T.CASE).agg(F.collect_list(step).alias("steps"))
    timed = F.transform(F.filter("steps", lambda x: x["activity"].isNotNull()), lambda x: F.struct(x["late"], x["ts"], x["event_index"], x["activity"]))
    filed = F.transform(F.array_sort("steps"), lambda x: x["activity"])
    cases = cases.select("log_id", F.size("steps").alias("n_events"), F.transform(F.array_sort(timed), lambda x: x["activity"]).alias("trace"), filed.alias("filed"))
    f = F.col("filed")
    arcs = F.filter(F.transform(f, lambda x, i: F.struct(x.alias("source"), F.get(f, i + 1).alias("target"))), lambda p: p["source"].isNotNull() & p["target"].isNotNull())
    return cases.select("log_id", "n_events", "trace", arcs.alias("arcs"), F.sha2(F.array_join("trace", "\x1f"), 256).alias("variant_hash"))


def _whole(n: str, x: str) -> tuple[Column, Column]:
    """Mean and population variance of integers ``x`` that each stand ``n`` times, from exact sums."""
    d = lambda c: F.sum(c.cast("decimal(38,0)"))
    total, one, two = d(F.col(n)), d(F.col(n) * F.col(x)), d(F.col(n) * F.col(x) * F.col(x))
    return one.cast("double") / total.cast("double"), (total * two - one * one).cast("double") / (total * total).cast("double")


def _lengths(cases: DataFrame) -> DataFrame:
    """Sizes of a log and the distribution of its case lengths, by a histogram."""
    hist = cases.groupBy("log_id", "n_events").agg(F.count("*").alias("m"))
    q = F.percentile("n_events", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))), F.col("m"))
    mean, variance = _whole("m", "n_events")
    out = hist.groupBy("log_id").agg(
        F.sum("m").alias("rs4pd_total_traces"), F.sum(F.col("m") * F.col("n_events")).alias("rs4pd_total_events"), mean.alias("rs4pd_trace_length_avg"), variance.alias("trace_len_variance"),
        F.min("n_events").cast("double").alias("trace_len_min"), F.max("n_events").cast("double").alias("trace_len_max"), q.alias("q"),
    )
    q = F.col("q")
    more = {"trace_len_mean": F.col("rs4pd_trace_length_avg"), "trace_len_std": F.sqrt("trace_len_variance"), "trace_len_q1": q[0], "trace_len_median": q[1], "trace_len_q3": q[2], "trace_len_iqr": q[2] - q[0], "trace_len_p90_custom": q[3]}
    return out.withColumns(more).drop("q")


def _labels(kinds: DataFrame) -> DataFrame:
    """Counts of activities, first and last activities: one explode of the variants, one grouping."""
    t = F.col("trace")
    tagged = lambda tag, x: F.struct(F.lit(tag).alias("tag"), x.alias("key"))
    ends = F.when(F.size(t) > 0, F.array(tagged("s", F.get(t, F.lit(0))), tagged("e", F.element_at(t, -1)))).otherwise(F.array().cast("array<struct<tag:string,key:string>>"))
    counts = kinds.select("log_id", "n", F.explode(F.concat(F.transform(t, lambda x: tagged("a", x)), ends)).alias("k")).groupBy("log_id", "k").agg(F.sum("n").alias("n"))
    counts = counts.select("log_id", *(F.when(F.col("k.tag") == g, F.col("n")).alias(g) for g in "ase"))
    q = F.percentile("a", F.array(F.lit(0.25), F.lit(0.75)))
    aggregates = [F.count("a").alias("n_unique_activities"), (q[1] - q[0]).alias("activities_iqr"), entropy("a").alias("activity_entropy_custom"), F.avg(F.when(F.col("a") <= 1, 1.0).when(F.col("a").isNotNull(), 0.0)).alias("rare_activity_ratio_custom")]
    for c, name in (("a", "activities"), ("s", "start_activities"), ("e", "end_activities")):
        aggregates += [F.max(c).cast("double").alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    for c, name in (("s", "start"), ("e", "end")):
        aggregates += [F.count(c).alias(f"n_unique_{name}_activities"), entropy(c).alias(f"{name}_event_entropy_custom")]
    return counts.groupBy("log_id").agg(*aggregates)


def _arcs(cases: DataFrame) -> list[DataFrame]:
    """Sums over the arcs of each log's graph, its two-way pairs and its degrees."""
    arcs = cases.select("log_id", F.explode("arcs").alias("p")).groupBy("log_id", "p.source", "p.target").agg(F.count("*").alias("n"))
    whole = arcs.groupBy("log_id").agg(F.count("*").alias("arcs"), F.count_if(F.col("source") == F.col("target")).alias("loops"), entropy("n").alias("rs4pd_flow_entropy"), F.max("n").alias("top"), F.sum("n").alias("total"), F.count_if(F.col("n") <= 1).alias("rare"))
    both = arcs.where("source <> target").groupBy("log_id", F.least("source", "target"), F.greatest("source", "target")).agg((F.count("*") == 2).alias("two_way")).groupBy("log_id").agg(F.count_if("two_way").alias("both_n"))
    ends = F.array(F.struct(F.col("source").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degrees = arcs.select("log_id", F.explode(ends).alias("e")).groupBy("log_id", "e.x").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")).withColumn("d", F.col("o") + F.col("i"))
    degrees = degrees.groupBy("log_id").agg(F.max("d").alias("maximum_node_degree"), F.max("i").alias("max_in_degree_custom"), F.max("o").alias("max_out_degree_custom"), entropy("d").alias("dfg_entropy_variable_degree"))
    return [whole, both, degrees]


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Per-log parts as one row a log: their union grouped once, instead of a join for each."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("log_id").agg(*(F.max(c).alias(c) for c in rows.columns if c != "log_id"))


def extended_features(log: DataFrame) -> DataFrame:
    """All features of every log in one row per log, null where undefined.

    Events are shuffled once, to their cases; cases collapse to variants, case
    lengths and arcs, all combined before they are shuffled, and what follows
    works on those. Nothing is cached: branches share the exchanges.
    """
    cases = _cases(log)
    kinds = T.distinct_variants(cases)
    loops = kinds.groupBy("log_id").agg(*T.repetition_sums(), T.length_two_loops_sum())
    out = _one_row([_lengths(cases), _labels(kinds), *_arcs(cases), T.variant_counts(kinds), loops, T.prefix_entropies(kinds)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, arcs = F.col("n_unique_activities"), zero("arcs")
    has, some = F.col("arcs").isNotNull(), a > 0
    possible = a * (a - 1) / 2
    share = lambda part, of: F.when(F.col(of) > 0, F.col(part) / F.col(of))
    out = out.withColumns(
        {
            "rs4pd_distinct_traces": F.col("n_unique_traces"),
            "rs4pd_distinct_events": zero("n_unique_activities"),
            "rs4pd_start_events": zero("n_unique_start_activities"),
            "rs4pd_end_events": zero("n_unique_end_activities"),
            "rs4pd_repetitions_intra_trace_avg": F.col("avg_event_repetition_intra_trace"),
            "most_common_activity_share_custom": share("activities_max", "rs4pd_total_events"),
            "most_common_start_share_custom": share("start_activities_max", "rs4pd_total_traces"),
            "most_common_end_share_custom": share("end_activities_max", "rs4pd_total_traces"),
            "rs4pd_flow_concurrency_ratio": F.when(has, F.when(possible > 0, zero("both_n") / possible).otherwise(0.0)),
            "rs4pd_flow_density": F.when(has & some, arcs / (a * a)),
            "rs4pd_length_one_loops_count": F.col("loops"),
            "dfg_edge_entropy_custom": F.col("rs4pd_flow_entropy"),
            "top_dfg_edge_share_custom": share("top", "total"),
            "rare_dfg_edge_ratio_custom": share("rare", "arcs"),
            "length_one_loops": F.when(some, F.col("loops") / a),
            "number_of_nodes": F.when(some, a),
            "number_of_arcs": arcs,
            "average_node_degree": F.when(some, 2 * arcs / a).otherwise(0.0),
            "avg_in_degree_custom": F.when(some, arcs / a),
            "avg_out_degree_custom": F.when(some, arcs / a),
            "maximum_node_degree": zero("maximum_node_degree"),
            "max_in_degree_custom": F.when(some, zero("max_in_degree_custom")),
            "max_out_degree_custom": F.when(some, zero("max_out_degree_custom")),
            "density": F.when(a > 1, arcs / (a * (a - 1))).otherwise(0.0),
            "structure": F.when(some, 1 - arcs / (a * a)),
        }
    )
    return out.drop("arcs", "loops", "top", "total", "rare", "both_n")


def log_features(log: DataFrame) -> DataFrame:
    """log_id and the 48 canonical features as doubles."""
    return extended_features(log).select("log_id", *(F.col(c).cast("double").alias(c) for c in FEATURE_NAMES))


def six_axes(log: DataFrame) -> DataFrame:
    """traces, mean length, activities, variant ratio, graph density and repetition prevalence; pairs follow time here."""
    ordered = T.traces(log)
    kinds = T.distinct_variants(ordered)
    t = F.col("trace")
    steps = kinds.select("log_id", F.explode(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(F.get(t, i).alias("s"), x.alias("t")))).alias("p"))
    arcs = steps.distinct().groupBy("log_id").agg(F.count("*").alias("arcs"))
    repeated = F.size(t) > F.size(F.array_distinct(t))
    v = kinds.groupBy("log_id").agg(F.count("*").alias("v"), F.sum("n").alias("num_traces"), F.sum(F.when(repeated, F.col("n")).otherwise(0)).alias("r"))
    length = ordered.groupBy("log_id").agg(F.avg("n_events").alias("avg_trace_length"))
    acts = G.activities(log).groupBy("log_id").agg(F.count("*").alias("num_activities"))
    j = v.join(length, "log_id").join(acts, "log_id", "left").join(arcs, "log_id", "left")
    a = F.col("num_activities")
    return j.select(
        "log_id",
        F.col("num_traces").cast("double").alias("num_traces"),
        "avg_trace_length",
        F.coalesce(a, F.lit(0)).cast("double").alias("num_activities"),
        (F.col("v") / F.col("num_traces")).alias("variant_ratio"),
        F.coalesce(F.col("arcs") / (a * a), F.lit(0.0)).alias("dfg_density"),
        (F.col("r") / F.col("num_traces")).alias("repetition_prevalence"),
    )


def distribution_features(values: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Moments and a ten-bin density of a positive count column per key.

    mode is the smallest of the most frequent values; skewness and kurtosis
    (minus 3) are population moments; the bins cut [min, max] evenly.
    """
    by = Window.partitionBy(*keys)
    counts = values.groupBy(*keys, F.col(col).cast("double").alias("x")).agg(F.count("*").alias("n"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    n = F.sum("n")
    m1 = F.sum(F.col("n") * F.col("x")) / n
    flat = counts.groupBy(*keys).agg(
        n.alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        m1.alias("mean"),
        q.alias("q"),
        F.max_by("x", F.struct("n", -F.col("x"))).alias("mode"),
        F.exp(F.sum(F.col("n") * F.log("x")) / n).alias("gmean"),
        (n / F.sum(F.col("n") / F.col("x"))).alias("hmean"),
    )
    d = counts.join(flat.select(*keys, "mean", "min", "max", F.col("n").alias("all_n")), keys)
    dev = F.col("x") - F.col("mean")
    width = F.when(F.col("max") > F.col("min"), F.least(F.floor((F.col("x") - F.col("min")) * 10 / (F.col("max") - F.col("min"))), F.lit(9))).otherwise(0)
    more = d.withColumn("bin", width).groupBy(*keys).agg(
        *(((F.sum(F.col("n") * dev**k)) / F.max("all_n")).alias(f"m{k}") for k in (2, 3, 4)),
        *((F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) / F.max("all_n")).alias(f"hist_{b}") for b in range(10)),
    )
    j = flat.join(more, keys)
    std = F.sqrt("m2")
    return j.select(
        *keys, "min", "max", "mean", F.col("q")[1].alias("median"), "mode", std.alias("std"), F.col("m2").alias("variance"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "gmean", "hmean", F.when(F.col("m2") > 0, F.col("m3") / (F.col("m2") * std)).alias("skewness"),
        F.when(F.col("m2") > 0, F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurtosis"), (std / F.col("mean")).alias("cv"), *(f"hist_{b}" for b in range(10)),
    )


def feature_cache(log: DataFrame, cached: DataFrame) -> DataFrame:
    """``cached`` feature rows, and fresh ones for the logs that it lacks.

    The ids of the cached logs, one a row of features, are broadcast: a join by
    log would bring all events of a log to one task.
    """
    missing = log.join(F.broadcast(cached.select("log_id").distinct()), "log_id", "left_anti")
    return cached.unionByName(log_features(missing))


def distribution_table(log: DataFrame) -> DataFrame:
    """log_id and the distribution features of case lengths, variant counts and activity counts, one column each (null where undefined)."""
    cases = _cases(log)
    counts = {"length": cases.select("log_id", F.col("n_events").alias("x")), "variant": T.distinct_variants(cases).select("log_id", F.col("n").alias("x")), "activity": log.where("activity is not null").groupBy("log_id", "activity").agg(F.count("*").alias("x")).select("log_id", "x")}
    values = reduce(lambda a, b: a.union(b), (c.select("log_id", F.lit(name).alias("of"), F.col("x").cast("long").alias("x")) for name, c in counts.items()))
    long = distribution_features(values, ["log_id", "of"], "x")
    columns = [c for c in long.columns if c not in ("log_id", "of")]
    return long.groupBy("log_id").agg(*(F.max(F.when(F.col("of") == name, F.col(c))).cast("double").alias(f"{name}_{c}") for name in counts for c in columns))
