"""Directly-follows graphs of many logs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import entropy


def pairs(log: DataFrame) -> DataFrame:
    """Consecutive activities of every case in event order; a pair with a null is left out and not bridged."""
    w = Window.partitionBy("log_id", "case_id").orderBy("event_index")
    return log.select("log_id", "case_id", F.col("activity").alias("source"), F.lead("activity").over(w).alias("target")).where("source is not null and target is not null")


def directly_follows(log: DataFrame) -> DataFrame:
    """log_id, source, target, n."""
    return pairs(log).groupBy("log_id", "source", "target").agg(F.count("*").alias("n"))


def activities(log: DataFrame) -> DataFrame:
    """Distinct activities per log."""
    return log.where("activity is not null").select("log_id", "activity").distinct()


def flow_features(dfg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge entropy, concurrency, density over n squared, self loops and edge shares per log."""
    size = nodes.groupBy("log_id").agg(F.count("*").alias("a"))
    back = dfg.select("log_id", F.col("source").alias("target"), F.col("target").alias("source"))
    both = dfg.where("source < target").join(back, ["log_id", "source", "target"], "left_semi").groupBy("log_id").agg(F.count("*").alias("both_n"))
    loops = F.count_if(F.col("source") == F.col("target"))
    e = dfg.groupBy("log_id").agg(F.count("*").alias("arcs"), loops.alias("loops"), entropy("n").alias("entropy"), F.max("n").alias("top"), F.sum("n").alias("total"), F.count_if(F.col("n") <= 1).alias("rare"))
    j = size.join(e, "log_id", "left").join(both, "log_id", "left")
    possible = F.col("a") * (F.col("a") - 1) / 2
    has = F.col("arcs").isNotNull()
    return j.select(
        "log_id",
        F.col("entropy").alias("rs4pd_flow_entropy"),
        F.when(has, F.when(possible > 0, F.coalesce("both_n", F.lit(0)) / possible).otherwise(0.0)).alias("rs4pd_flow_concurrency_ratio"),
        (F.col("arcs") / (F.col("a") * F.col("a"))).alias("rs4pd_flow_density"),
        F.col("loops").alias("rs4pd_length_one_loops_count"),
        F.col("entropy").alias("dfg_edge_entropy_custom"),
        (F.col("top") / F.col("total")).alias("top_dfg_edge_share_custom"),
        (F.col("rare") / F.col("arcs")).alias("rare_dfg_edge_ratio_custom"),
        (F.col("loops") / F.col("a")).alias("length_one_loops"),
    )


def graph_metrics(dfg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, arcs, degrees, density and degree entropy per log; a self loop counts twice."""
    ends = dfg.select("log_id", F.col("source").alias("activity"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(dfg.select("log_id", "target", F.lit(0), F.lit(1)))
    deg = nodes.join(ends.groupBy("log_id", "activity").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), ["log_id", "activity"], "left").fillna(0, ["o", "i"])
    deg = deg.withColumn("d", F.col("o") + F.col("i"))
    g = deg.groupBy("log_id").agg(F.count("*").alias("a"), F.sum("o").alias("arcs"), F.max("d").alias("d"), F.max("i").alias("i"), F.max("o").alias("o"), entropy("d").alias("e"))
    a, arcs = F.col("a"), F.col("arcs")
    return g.select(
        "log_id",
        a.alias("number_of_nodes"),
        arcs.alias("number_of_arcs"),
        (2 * arcs / a).alias("average_node_degree"),
        F.col("d").alias("maximum_node_degree"),
        (arcs / a).alias("avg_in_degree_custom"),
        (arcs / a).alias("avg_out_degree_custom"),
        F.col("i").alias("max_in_degree_custom"),
        F.col("o").alias("max_out_degree_custom"),
        F.when(a > 1, arcs / (a * (a - 1))).otherwise(0.0).alias("density"),
        (1 - arcs / (a * a)).alias("structure"),
        F.col("e").alias("dfg_entropy_variable_degree"),
    )


def reliable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def weak_components(dfg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weakly connected components per log, by spreading the smallest label over all logs at once.

    A label is an activity of the same component, so every round also takes
    the label's own label (long paths need few rounds), until nothing changes.
    """
    links = dfg.select("log_id", F.col("source").alias("x"), F.col("target").alias("y")).where("x <> y")
    links = reliable(links.union(links.select("log_id", "y", "x")).distinct())
    labels = nodes.select("log_id", F.col("activity").alias("x"), F.col("activity").alias("label"))
    while True:
        near = labels.withColumnRenamed("x", "y").join(links, ["log_id", "y"]).groupBy("log_id", "x").agg(F.min("label").alias("m"))
        new = reliable(labels.join(near, ["log_id", "x"], "left").select("log_id", "x", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        jump = new.groupBy("log_id", F.col("x").alias("label")).agg(F.min("label").alias("further"))
        labels = reliable(new.join(jump, ["log_id", "label"], "left").select("log_id", "x", F.least("label", "further").alias("label")))
    return labels.groupBy("log_id").agg(F.count_distinct("label").alias("weakly_connected_components_custom"))
