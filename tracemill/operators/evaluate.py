"""Weightings, rankings, baselines and evaluation of recommended configurations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.clean import log_family, log_population

MEASURES = ("fitness", "precision", "generalization", "simplicity")
CELL = ["log_id", "weighting"]


def parse_weights(text: str) -> dict[str, float]:
    """``fitness=0.5,precision=0.5`` or four numbers in the order of MEASURES; others are zero."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if all("=" not in p for p in parts):
        if len(parts) != len(MEASURES):
            raise ValueError("four weights are needed")
        return dict(zip(MEASURES, map(float, parts)))
    given = {k.strip(): float(v) for k, v in (p.split("=") for p in parts)}
    unknown = sorted(set(given) - set(MEASURES))
    if unknown:
        raise ValueError(f"unknown measures: {', '.join(unknown)}")
    return {m: given.get(m, 0.0) for m in MEASURES}


def weight_sets() -> dict[str, tuple[float, ...]]:
    """The 15 named weightings: equal, single measures, pairs and four mixes."""
    out = {"equal": (0.25,) * 4}
    for m in MEASURES:
        out[m[:4]] = tuple(float(x == m) for x in MEASURES)
    for a, b in combinations(MEASURES, 2):
        out[f"{a[:3]}+{b[:3]}"] = tuple(float(x in (a, b)) for x in MEASURES)
    return out | {"mix-fit": (0.4, 0.3, 0.1, 0.2), "mix-prec": (0.2, 0.4, 0.3, 0.1), "mix-simp": (0.3, 0.1, 0.2, 0.4), "mix-gen": (0.1, 0.2, 0.4, 0.3)}


def weight_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *w) for n, w in weight_sets().items()], "weighting string, w_fitness double, w_precision double, w_generalization double, w_simplicity double")


def weighted(df: DataFrame, prefix: str = "", name: str = "score") -> DataFrame:
    """Every row under every weighting, with the composite of the (prefixed) measures; a weight total of zero counts as one.

    The weightings are fifteen rows, so their product with the runs is linear.
    """
    grid = F.broadcast(weight_grid(df.sparkSession))
    total = sum((F.col(f"w_{m}") for m in MEASURES), F.lit(0.0))
    sums = sum((F.col(f"{prefix}{m}") * F.col(f"w_{m}") for m in MEASURES), F.lit(0.0))
    return df.crossJoin(grid).withColumn(name, sums / F.when(total == 0, 1.0).otherwise(total)).drop(*(f"w_{m}" for m in MEASURES))


def complete(runs: DataFrame) -> DataFrame:
    return runs.dropna(subset=list(MEASURES))


def leave_one_family_out(logs: DataFrame) -> DataFrame:
    """(test_log, train_log) of different families; the logs are a table of hundreds of rows."""
    f = logs.select("log_id").distinct().withColumn("family", log_family(F.col("log_id")))
    test = f.toDF("test_log", "test_family")
    return test.join(F.broadcast(f.toDF("train_log", "train_family")), F.col("test_family") != F.col("train_family")).select("test_log", "train_log")


def grouped_kfold(logs: DataFrame, k: int = 5) -> DataFrame:
    """log_id, family, fold; families stay together, the largest are dealt out in snakes."""
    f = logs.select("log_id").distinct().withColumn("family", log_family(F.col("log_id")))
    sizes = f.groupBy("family").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.orderBy(F.desc("n"), "family")) - 1  # families, not rows of data
    lap, at = F.floor(r / k), r % k
    return f.join(sizes.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")).select("family", "fold"), "family").select("log_id", "family", "fold")


def scale(scores: DataFrame, score: str = "score") -> DataFrame:
    """Best and worst score of every (log, weighting)."""
    return scores.groupBy(*CELL).agg(F.max(score).alias("best"), F.min(score).alias("worst"))


def accuracy(score: Column) -> Column:
    """Min-max accuracy; 1 where all scores are equal."""
    return F.when(F.col("best") == F.col("worst"), 1.0).otherwise((score - F.col("worst")) / (F.col("best") - F.col("worst")))


def minmax_accuracy(scores: DataFrame, picks: DataFrame) -> DataFrame:
    """Accuracy of picked scores (log, weighting, method, score) on the scale of all."""
    return picks.join(scale(scores), CELL).withColumn("accuracy", accuracy(F.col("score")))


def model_picks(scores: DataFrame, predicted: str = "predicted", k: int = 1, method: str = "model") -> DataFrame:
    """The best real score among the ``k`` configurations of the highest predicted score."""
    r = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc(predicted), "config_hash"))
    return scores.withColumn("r", r).where(F.col("r") <= k).groupBy(*CELL).agg(F.max("score").alias("score")).withColumn("method", F.lit(method))


def acc_at_k(runs: DataFrame, k: int) -> DataFrame:
    """Per measure the mean accuracy of the best real value among the ``k`` predicted highest."""
    out = None
    for m in MEASURES:
        w = Window.partitionBy("log_id")
        x = runs.withColumn("best", F.max(m).over(w)).withColumn("worst", F.min(m).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(f"pred_{m}"), "config_hash")))
        top = x.where(F.col("r") <= k).groupBy("log_id", "best", "worst").agg(F.max(m).alias("v"))
        row = top.agg(F.avg(accuracy(F.col("v"))).alias("accuracy")).select(F.lit(m).alias("measure"), "accuracy")
        out = row if out is None else out.union(row)
    return out


def regression_error(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R2 of predictions per measure (and the columns of ``by``)."""
    long = None
    for m in MEASURES:
        part = runs.where(F.col(m).isNotNull() & F.col(f"pred_{m}").isNotNull()).select(*by, F.lit(m).alias("measure"), F.col(m).alias("y"), F.col(f"pred_{m}").alias("p"))
        long = part if long is None else long.union(part)
    e = F.col("y") - F.col("p")
    return long.groupBy(*by, "measure").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count("*"))).alias("r2"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; null with fewer than three pairs or a constant side."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = Window.partitionBy(*keys)

    def rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    r = x.withColumn("_ra", rank(a)).withColumn("_rb", rank(b))
    fine = (F.count("*") >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return r.groupBy(*keys).agg(F.count("*").alias("n_configs"), F.when(fine, F.corr("_ra", "_rb")).alias("rho"))


def working(runs: DataFrame) -> DataFrame:
    """Rows that are not failures (not all measures zero)."""
    zero = F.lit(True)
    for m in MEASURES:
        zero = zero & (F.col(m) == 0)
    return runs.where(~zero)


def group_report(acc: DataFrame) -> DataFrame:
    """Mean accuracy per (population, weighting, method), with ``combined`` populations and MEAN weightings."""
    x = acc.withColumn("population", log_population(F.col("log_id")))
    x = x.withColumn("population", F.explode(F.array("population", F.lit("combined")))).withColumn("weighting", F.explode(F.array("weighting", F.lit("MEAN"))))
    return x.groupBy("population", "weighting", "method").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("n"))


def win_tie_loss(acc: DataFrame, baseline: str, tolerance: float = 1e-9) -> DataFrame:
    """How often every method beats, equals and loses to the baseline over (log, weighting)."""
    base = acc.where(F.col("method") == baseline).select(*CELL, F.col("accuracy").alias("base"))
    j = acc.where(F.col("method") != baseline).join(base, CELL)
    d = F.col("accuracy") - F.col("base")
    return j.groupBy("method").agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def default_ground_truth(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per (log, algorithm) the complete row nearest to the default configuration; a null hyper-parameter costs nothing."""
    j = complete(runs).join(F.broadcast(defaults.select("algorithm", F.col("p1").alias("d1"), F.col("p2").alias("d2"))), "algorithm")
    cost = sum((F.coalesce((F.col(p) - F.col(d)) ** 2, F.lit(0.0)) for p, d in (("p1", "d1"), ("p2", "d2"))), F.lit(0.0))
    r = F.row_number().over(Window.partitionBy("log_id", "algorithm").orderBy(F.round(cost, 9), "config_hash"))
    return j.withColumn("_r", r).where("_r = 1").drop("_r", "d1", "d2")


def default_representatives(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """One row per (log, algorithm): recorded baselines first, then empty parameters, distance to the default, equal-weight score."""
    j = runs.join(F.broadcast(defaults.select("algorithm", F.col("p1").alias("d1"), F.col("p2").alias("d2"))), "algorithm", "left")
    one = lambda p, d: F.when(F.col(d).isNull(), F.when(F.col(p).isNotNull(), 0.01).otherwise(0.0)).otherwise(F.coalesce((F.col(p) - F.col(d)) ** 2, F.lit(10.0)))
    none = F.col("d1").isNull() & F.col("d2").isNull()
    present = F.col("p1").isNotNull().cast("int") + F.col("p2").isNotNull().cast("int")
    far = F.when(none, present.cast("double")).otherwise(F.sqrt(one("p1", "d1") + one("p2", "d2")))
    score = sum((F.col(m) for m in MEASURES), F.lit(0.0)) / 4
    order = [F.desc(F.col("experiment_id").contains("baseline")), F.desc(present == 0), F.round(far, 9), F.round(score, 9).desc_nulls_last(), "config_hash"]
    return j.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "algorithm").orderBy(*order))).where("_r = 1").drop("_r", "d1", "d2")


def oracle_ladder(runs: DataFrame, defaults: DataFrame, shared: list[str]) -> DataFrame:
    """Mean accuracy of the best default, the best shared tuned and the best of all configurations; flat cells are skipped."""
    full = weighted(complete(runs))
    cell = full.groupBy(*CELL).agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.max(F.when(F.col("algorithm").isin(*shared), F.col("score"))).alias("shared"))
    best = weighted(default_ground_truth(runs, defaults)).groupBy(*CELL).agg(F.max("score").alias("deft"))
    j = cell.join(best, CELL).where("best - worst >= 1e-9")
    acc = lambda c: F.avg((F.col(c) - F.col("worst")) / (F.col("best") - F.col("worst")))
    one = j.agg(acc("deft").alias("d"), acc("shared").alias("s"), F.count("*").alias("n_cells"))
    rows = F.array(F.struct(F.lit("oracle_best_of_defaults").alias("rung"), F.col("d").alias("accuracy")), F.struct(F.lit("oracle_best_shared_tuned").alias("rung"), F.col("s").alias("accuracy")), F.struct(F.lit("oracle_full_grid").alias("rung"), F.lit(1.0).alias("accuracy")))
    return one.select(F.explode(rows).alias("r"), "n_cells").select("r.*", "n_cells")


def tuning_headroom(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per algorithm the mean gain of its best over its default configuration, in parts of the cell's range."""
    full = weighted(complete(runs))
    cell = scale(full).where("best - worst >= 1e-9")
    best = full.groupBy(*CELL, "algorithm").agg(F.max("score").alias("top"))
    deft = weighted(default_ground_truth(runs, defaults)).select(*CELL, "algorithm", F.col("score").alias("deft"))
    j = best.join(deft, [*CELL, "algorithm"]).join(cell, CELL)
    return j.groupBy("algorithm").agg(F.avg((F.col("top") - F.col("deft")) / (F.col("best") - F.col("worst"))).alias("tuning_headroom"), F.count("*").alias("n_cells"))


def menu_gap(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """1 - accuracy of the best default per (log, weighting), and the algorithm of the best configuration."""
    full = weighted(complete(runs))
    cell = full.groupBy(*CELL).agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.max_by("algorithm", F.struct(F.round("score", 9), F.col("algorithm"))).alias("best_algorithm"))
    best = weighted(default_ground_truth(runs, defaults)).groupBy(*CELL).agg(F.max("score").alias("deft"))
    return cell.join(best, CELL).where("best - worst >= 1e-9").select(*CELL, (1 - (F.col("deft") - F.col("worst")) / (F.col("best") - F.col("worst"))).alias("menu_gap"), "best_algorithm")


def observed_search_space(runs: DataFrame, parameters: list[str]) -> DataFrame:
    """Per algorithm the parameters that vary: integer or float, least, greatest."""
    long = runs.unpivot(["algorithm"], parameters, "parameter", "value").where("value is not null")
    g = long.groupBy("algorithm", "parameter").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and(F.col("value") == F.floor("value")).alias("whole"))
    return g.where("low < high").select("algorithm", "parameter", F.when(F.col("whole"), "int").otherwise("float").alias("kind"), "low", "high")


def winning_algorithm(runs: DataFrame) -> DataFrame:
    """The algorithm of the best score per (log, weighting), ties to the first name; how many distinct winners a log has."""
    top = weighted(complete(runs)).groupBy(*CELL, "algorithm").agg(F.round(F.max("score"), 9).alias("score"))
    r = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("score"), "algorithm"))
    won = top.withColumn("r", r).where("r = 1").drop("r")
    n = won.groupBy("log_id").agg(F.count_distinct("algorithm").alias("distinct_winners"))
    return won.join(n, "log_id").withColumn("population", log_population(F.col("log_id")))


def headroom(runs: DataFrame) -> DataFrame:
    """Best minus worst score per log, averaged over the weightings."""
    return scale(weighted(complete(runs))).groupBy("log_id").agg(F.avg(F.col("best") - F.col("worst")).alias("headroom"))


def log_inventory(runs: DataFrame) -> DataFrame:
    """Rows per log by kind: complete, zero, partial; gradable logs; a row of totals."""
    some = F.lit(False)
    every = F.lit(True)
    zero = F.lit(True)
    for m in MEASURES:
        some, every, zero = some | F.col(m).isNotNull(), every & F.col(m).isNotNull(), zero & (F.coalesce(m, F.lit(1.0)) == 0)
    out = runs.rollup("log_id").agg(F.count("*").alias("rows_total"), F.count_if(every).alias("complete"), F.count_if(zero).alias("zeros"), F.count_if(some & ~every).alias("partial"))
    return out.withColumn("log_id", F.coalesce("log_id", F.lit("TOTAL"))).withColumn("gradable", F.col("complete") > 0)


def regret_and_rank(full: DataFrame, action: DataFrame, chosen: DataFrame) -> DataFrame:
    """Regret, accuracy and rank of a chosen score against all and against the allowed candidates per cell."""
    out = chosen.select(*CELL, F.col("score").alias("real_score"))
    for name, pool in (("full", full), ("action", action)):
        j = pool.select(*CELL, "score").join(chosen.select(*CELL, F.col("score").alias("own")), CELL)
        g = j.groupBy(*CELL).agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.count_if(F.col("score") > F.col("own") + 1e-12).alias("above"), F.count("*").alias(f"n_{name}_configs"), F.max("own").alias("own"))
        g = g.select(*CELL, (F.col("best") - F.col("own")).alias(f"regret_{name}"), accuracy(F.col("own")).alias(f"accuracy_{name}"), (F.col("above") + 1).alias(f"rank_{name}"), f"n_{name}_configs")
        out = out.join(g, CELL)
    return out


def rank_target(runs: DataFrame) -> DataFrame:
    """Per log the minimum ranks of runtime (ascending) and of the measures (descending), and their mean."""
    w = Window.partitionBy("log_id")
    x = complete(runs.where("status = 'success'")).where("runtime_seconds is not null")
    x = x.withColumn("runtime_rank", F.rank().over(w.orderBy("runtime_seconds")))
    for m in MEASURES:
        x = x.withColumn(f"{m}_rank", F.rank().over(w.orderBy(F.desc(m))))
    ranks = ["runtime_rank", *(f"{m}_rank" for m in MEASURES)]
    return x.select("log_id", "algorithm", "config_hash", *ranks, (sum((F.col(r) for r in ranks), F.lit(0)) / 5).alias("target_final_rank"))


def unique_best_label(ranked: DataFrame, label: str = "config_hash") -> DataFrame:
    """The label of the least rank per log; logs where labels tie are left out."""
    least = F.min("target_final_rank").over(Window.partitionBy("log_id"))
    best = ranked.withColumn("_m", least).where("target_final_rank = _m")
    return best.groupBy("log_id").agg(F.count("*").alias("n"), F.first(label).alias("label")).where("n = 1").select("log_id", "label")


def best_train_config(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (test log, weighting) the real score of the configuration with the best mean over the training logs that the test log also ran; else the test mean.

    Leave-one-family-out means are the totals less the family's own part.
    """
    s = scores.withColumn("family", log_family(F.col("log_id")))
    every = s.groupBy("weighting", "config_hash").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    own = s.groupBy("weighting", "config_hash", "family").agg(F.sum("score").alias("fs"), F.count("score").alias("fn"))
    j = s.join(own, ["weighting", "config_hash", "family"]).join(every, ["weighting", "config_hash"])
    train = F.when(F.col("n") > F.col("fn"), F.round((F.col("s") - F.col("fs")) / (F.col("n") - F.col("fn")), 9))
    r = j.withColumn("train", train)
    known = F.when(F.col("train").isNotNull(), F.struct("train", "config_hash"))
    out = r.groupBy(*CELL).agg(F.max_by("score", known).alias("pick"), F.avg("score").alias("mean"))
    tests = pairs.select(F.col("test_log").alias("log_id")).distinct()
    return out.join(tests, "log_id", "left_semi").select(*CELL, F.coalesce("pick", "mean").alias("score")).withColumn("method", F.lit("best_train_config"))


def nearest_training_log(features: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Per test log the nearest training log by standardized features, nulls filled with the training median (medians and stds over the training logs)."""
    long = features.unpivot(["log_id"], columns, "f", "v")
    by_test = pairs.join(F.broadcast(long.withColumnRenamed("log_id", "train_log")), "train_log")
    stats = by_test.groupBy("test_log", "f").agg(F.percentile("v", 0.5).alias("med"))
    filled = by_test.join(stats, ["test_log", "f"]).withColumn("v", F.coalesce("v", "med", F.lit(0.0)))
    sd = filled.groupBy("test_log", "f").agg(F.max("med").alias("med"), F.stddev_pop("v").alias("sd"))
    own = long.withColumnRenamed("log_id", "test_log").withColumnRenamed("v", "q").join(sd, ["test_log", "f"]).withColumn("q", F.coalesce("q", "med", F.lit(0.0)))
    step = F.when(F.col("sd") > 0, (F.col("v") - F.col("q")) / F.col("sd")).otherwise(F.col("v") - F.col("q"))
    d = filled.drop("med").join(own.select("test_log", "f", "q", "sd"), ["test_log", "f"]).groupBy("test_log", "train_log").agg(F.round(F.sqrt(F.sum(step * step)), 9).alias("distance"))
    return d.groupBy("test_log").agg(F.min(F.struct("distance", "train_log")).alias("m")).select("test_log", F.col("m.train_log").alias("nearest_log"), F.col("m.distance").alias("distance"))


def knn_transfer(scores: DataFrame, nearest: DataFrame) -> DataFrame:
    """The nearest training log's best configuration that the test log also ran, by its real score there; else the test mean."""
    near = scores.select(F.col("log_id").alias("nearest_log"), "weighting", "config_hash", F.round("score", 9).alias("there"))
    j = scores.join(nearest.select(F.col("test_log").alias("log_id"), "nearest_log"), "log_id").join(near, ["nearest_log", "weighting", "config_hash"], "left")
    known = F.when(F.col("there").isNotNull(), F.struct("there", "config_hash"))
    out = j.groupBy(*CELL).agg(F.max_by("score", known).alias("pick"), F.avg("score").alias("mean"))
    return out.select(*CELL, F.coalesce("pick", "mean").alias("score")).withColumn("method", F.lit("knn_transfer"))
