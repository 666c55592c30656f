"""Model discovery and quality as operators over directly-follows tables.

Dependency measures and footprints follow the published definitions; kept
graphs are judged by the pairs and traces they allow, by escaping edges, by
how often arcs were seen and by their degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.nearest import written
from tracemill.operators.traces import prefixes

ARC = ["log_id", "source", "target"]


def reverse(dfg: DataFrame, n: str = "back") -> DataFrame:
    return dfg.select("log_id", F.col("target").alias("source"), F.col("source").alias("target"), F.col("n").alias(n))


def footprint(dfg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relation of every activity pair of a log: ``->``, ``<-``, ``||`` or ``#``. Pairs are within an alphabet, not a group of data rows."""
    a = nodes.select("log_id", F.col("activity").alias("source"))
    pairs = a.join(nodes.select("log_id", F.col("activity").alias("target")), "log_id")
    j = pairs.join(dfg.select(*ARC, "n"), ARC, "left").join(reverse(dfg), ARC, "left")
    there, back = F.col("n").isNotNull(), F.col("back").isNotNull()
    return j.select(*ARC, F.when(there & back, "||").when(there, "->").when(back, "<-").otherwise("#").alias("relation"))


def dependency_graph(dfg: DataFrame, starts_dep: float = 0.5, min_count: int = 1) -> DataFrame:
    """Arcs with their dependency ((ab - ba) / (ab + ba + 1), or aa / (aa + 1) for self loops), at least ``starts_dep``."""
    j = dfg.join(reverse(dfg), ARC, "left").fillna(0, ["back"])
    loop = F.col("source") == F.col("target")
    dep = F.when(loop, F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("back")) / (F.col("n") + F.col("back") + 1))
    return j.withColumn("dependency", dep).where((F.col("dependency") >= starts_dep) & (F.col("n") >= min_count)).select(*ARC, "n", "dependency")


def length_two_dependency(kinds: DataFrame, least: float = 0.0) -> DataFrame:
    """(log_id, a, b, measure) for steps a, b, a: (aba + bab) / (aba + bab + 1), at least ``least``."""
    t = F.col("trace")
    hits = F.filter(F.transform(t, lambda x, i: F.when((x == F.get(t, i + 2)) & (x != F.get(t, i + 1)), F.struct(x.alias("a"), F.get(t, i + 1).alias("b")))), lambda x: x.isNotNull())
    n = kinds.select("log_id", "n", F.explode(hits).alias("h")).groupBy("log_id", "h.a", "h.b").agg(F.sum("n").alias("n"))
    back = n.select("log_id", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    both = n.join(back, ["log_id", "a", "b"], "full_outer").withColumn("k", F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)))
    return both.select("log_id", "a", "b", (F.col("k") / (F.col("k") + 1)).alias("measure")).where(F.col("measure") >= least)


def and_measure(dfg: DataFrame, least: float = 0.0) -> DataFrame:
    """(log_id, source, b, c, measure) of two successors b < c: (bc + cb) / (source b + source c + 1), at least ``least``.

    Pairs are within the successors of one activity, which the alphabet bounds.
    """
    x = dfg.select("log_id", "source", F.col("target").alias("b"), F.col("n").alias("nb"))
    y = dfg.select("log_id", "source", F.col("target").alias("c"), F.col("n").alias("nc"))
    pairs = x.join(y, ["log_id", "source"]).where("b < c")
    there = dfg.select("log_id", F.col("source").alias("b"), F.col("target").alias("c"), F.col("n").alias("bc"))
    back = dfg.select("log_id", F.col("source").alias("c"), F.col("target").alias("b"), F.col("n").alias("cb"))
    j = pairs.join(there, ["log_id", "b", "c"], "left").join(back, ["log_id", "b", "c"], "left")
    m = (F.coalesce("bc", F.lit(0)) + F.coalesce("cb", F.lit(0))) / (F.col("nb") + F.col("nc") + 1)
    return j.select("log_id", "source", "b", "c", m.alias("measure")).where(F.col("measure") >= least)


def filter_dfg(dfg: DataFrame, noise: float) -> DataFrame:
    """Arcs with at least the share ``noise`` of the most frequent arc that leaves the same source."""
    top = F.max("n").over(Window.partitionBy("log_id", "source"))
    return dfg.withColumn("top", top).where(F.col("n") >= F.col("top") * noise).drop("top")


def sweep_filter(dfg: DataFrame, noises: DataFrame) -> DataFrame:
    """The kept arcs of every noise setting (config_hash, noise) in one table; settings are a handful."""
    top = dfg.withColumn("top", F.max("n").over(Window.partitionBy("log_id", "source")))
    return top.crossJoin(F.broadcast(noises)).where(F.col("n") >= F.col("top") * F.col("noise")).select("config_hash", *ARC, "n")


def dfg_fitness(kinds: DataFrame, dfg: DataFrame, kept: DataFrame) -> DataFrame:
    """Per (configuration, log): share of observed pairs and of whole traces that the kept arcs allow."""
    total = dfg.groupBy("log_id").agg(F.sum("n").alias("pairs"))
    pairs = kept.groupBy("config_hash", "log_id").agg(F.sum("n").alias("ok")).join(total, "log_id").select("config_hash", "log_id", (F.col("ok") / F.col("pairs")).alias("pair_fitness"))
    t = F.col("trace")
    steps = kinds.select("log_id", "variant_hash", "n", F.array_distinct(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(F.get(t, i).alias("source"), x.alias("target")))).alias("steps"))
    need = steps.select("log_id", "variant_hash", F.explode("steps").alias("e")).select("log_id", "variant_hash", "e.source", "e.target")
    met = need.join(kept.select("config_hash", *ARC), ARC).groupBy("config_hash", "log_id", "variant_hash").agg(F.count("*").alias("met"))
    whole = steps.select("log_id", "variant_hash", "n", F.size("steps").alias("need"))
    all_n = whole.groupBy("log_id").agg(F.sum("n").alias("traces"), F.sum(F.when(F.col("need") == 0, F.col("n")).otherwise(0)).alias("short"))
    good = met.join(whole, ["log_id", "variant_hash"]).where("met = need").groupBy("config_hash", "log_id").agg(F.sum("n").alias("good"))
    return pairs.join(all_n, "log_id").join(good, ["config_hash", "log_id"], "left").select("config_hash", "log_id", "pair_fitness", ((F.coalesce("good", F.lit(0)) + F.col("short")) / F.col("traces")).alias("trace_fitness"))


def prefix_states(kinds: DataFrame) -> DataFrame:
    """(log_id, state, at, n, seen): prefixes of traces by hash, their last activity, how often reached, and what followed."""
    x = prefixes(kinds)
    return x.groupBy("log_id", "state", "at").agg(F.sum("n").alias("n"), F.collect_set("next").alias("seen"))


def dfg_precision(kinds: DataFrame, kept: DataFrame) -> DataFrame:
    """1 - the weighted share of allowed steps that no trace takes from a prefix (escaping edges)."""
    out = kept.groupBy("config_hash", "log_id", F.col("source").alias("at")).agg(F.collect_set("target").alias("allowed"))
    j = prefix_states(kinds).join(out, ["log_id", "at"])
    escaping = F.size(F.array_except("allowed", "seen"))
    return j.groupBy("config_hash", "log_id").agg((1 - F.sum(F.col("n") * escaping) / F.sum(F.col("n") * F.size("allowed"))).alias("precision"))


def dfg_generalization(kept: DataFrame) -> DataFrame:
    return kept.groupBy("config_hash", "log_id").agg((1 - F.avg(1 / F.sqrt("n"))).alias("generalization"))


def dfg_simplicity(kept: DataFrame) -> DataFrame:
    """1 / (1 + max(mean degree - 2, 0)) over the activities that kept arcs touch."""
    ends = kept.select("config_hash", "log_id", F.col("source").alias("a")).union(kept.select("config_hash", "log_id", "target"))
    deg = ends.groupBy("config_hash", "log_id", "a").agg(F.count("*").alias("d"))
    return deg.groupBy("config_hash", "log_id").agg((1 / (1 + F.greatest(F.avg("d") - 2, F.lit(0.0)))).alias("simplicity"))


def sweep(kinds: DataFrame, dfg: DataFrame, noises: DataFrame) -> DataFrame:
    """The four measures of every (log, configuration), with a status.

    Variants, arcs and kept arcs serve several measures: they are written once,
    so that none is derived anew.
    """
    kinds, dfg = written(kinds.select("log_id", "variant_hash", "trace", "n")), written(dfg)
    kept = written(sweep_filter(dfg, noises))
    key = ["config_hash", "log_id"]
    j = dfg_fitness(kinds, dfg, kept).join(dfg_precision(kinds, kept), key, "left").join(dfg_generalization(kept), key, "left").join(dfg_simplicity(kept), key, "left")
    status = F.when(F.col("precision").isNull() | F.col("simplicity").isNull(), "partial").otherwise("success")
    return j.select(*key, F.col("trace_fitness").alias("fitness"), "pair_fitness", "precision", "generalization", "simplicity", status.alias("status"))
