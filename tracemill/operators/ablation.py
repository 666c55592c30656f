"""Ablation of recommenders: model, feature set, training data and action space, families held out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.clean import log_family, log_population, regime
from tracemill.operators.evaluate import MEASURES, complete, default_representatives, grouped_kfold, model_picks, regret_and_rank, weighted
from tracemill.operators.models import imputation, impute, predict_measures, train_surrogate, variant_classifier
from tracemill.operators.surrogates import Registry, side_by_side


@dataclass(frozen=True)
class Setup:
    """One recommender: what it is, what it sees, what it learns from and what it may choose."""

    kind: str
    features: str
    data: str
    actions: str
    trees: int
    seed: int


# The eleven setups. Classifiers name an algorithm, regressors a configuration. Features are those of
# the distributions of counts, or of the log. Data are an outside table of labelled logs, it with the real logs, the
# real logs, those with synthetic ones, or all. Actions are the base algorithms or all, by their defaults or all configurations.
SETUPS = {
    "B0": Setup("classifier", "distribution", "outside", "base_default", 100, 10),
    "B1": Setup("classifier", "distribution", "outside_real", "base_default", 100, 10),
    "B2": Setup("classifier", "log", "real", "base_default", 100, 10),
    "B3": Setup("classifier", "log", "real_synthetic", "base_default", 100, 10),
    "B4": Setup("classifier", "log", "full", "base_default", 100, 10),
    "C0": Setup("regressor", "distribution", "real", "base_default", 200, 42),
    "C1": Setup("regressor", "log", "real", "base_default", 200, 42),
    "C2": Setup("regressor", "log", "full", "base_default", 200, 42),
    "C3": Setup("regressor", "log", "full", "base_tuned", 200, 42),
    "C4": Setup("regressor", "log", "full", "all_default", 200, 42),
    "C5": Setup("regressor", "log", "full", "all_tuned", 200, 42),
}


@dataclass(frozen=True)
class Inputs:
    """runs (log_id, algorithm, config_hash, parameters, measures), features by set (log_id, columns), outside (log_id, label, distribution columns)."""

    runs: DataFrame
    parameters: list[str]
    defaults: DataFrame
    features: dict[str, DataFrame]
    outside: DataFrame
    base: tuple[str, ...]

    def columns(self, name: str) -> list[str]:
        return [c for c in self.features[name].columns if c != "log_id"]


def action_rows(inputs: Inputs, rows: DataFrame, actions: str) -> DataFrame:
    """The rows of an action space: algorithms, and their default representatives or all configurations."""
    algorithms, which = actions.split("_")
    if algorithms == "base":
        rows = rows.where(F.col("algorithm").isin(*inputs.base))
    return default_representatives(rows, inputs.defaults).select(*rows.columns) if which == "default" else rows


def labels(inputs: Inputs, rows: DataFrame, actions: str) -> DataFrame:
    """(log_id, label): the algorithm of the best mean measure in the action space; a log where the best tie has none."""
    scored = action_rows(inputs, complete(rows), actions).withColumn("s", F.round(sum((F.col(m) for m in MEASURES), F.lit(0.0)) / len(MEASURES), 9))
    best = scored.withColumn("top", F.max("s").over(Window.partitionBy("log_id"))).where("s = top")
    return best.groupBy("log_id").agg(F.count("*").alias("n"), F.min("algorithm").alias("label")).where("n = 1").select("log_id", "label")


def predict_offered(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(log_id, predicted): the most probable label among those of the row's array ``allowed``; null if it has none of them."""
    known = model.stages[0].labels
    out = model.transform(rows.withColumn("label", F.lit(known[0]))).withColumn("_p", vector_to_array("probability"))
    options = F.array(*(F.struct(F.col("_p")[i].alias("p"), F.lit(x).alias("label")) for i, x in enumerate(known)))
    return out.select("log_id", F.array_max(F.filter(options, lambda o: F.array_contains(F.col("allowed"), o["label"])))["label"].alias("predicted"))


def _train(inputs: Inputs, setup: Setup, tagged: DataFrame, fold: int) -> DataFrame | None:
    """Training rows of a setup with its features, without the families of a fold; nothing where they can't tell anything apart."""
    others = tagged.where(F.col("fold") != fold).drop("fold")
    feats = inputs.features[setup.features]
    if setup.kind == "regressor":
        rows = action_rows(inputs, regime(others, setup.data), setup.actions).join(feats, "log_id")
        what = "algorithm"
    else:
        outside = setup.data.startswith("outside")
        rows = None
        if outside:
            held = tagged.where(F.col("fold") == fold).select(log_family(F.col("log_id")).alias("family")).distinct()
            rows = inputs.outside.withColumn("family", log_family(F.col("log_id"))).join(held, "family", "left_anti").drop("family")
        if setup.data != "outside":
            own = labels(inputs, regime(others, "real" if outside else setup.data), setup.actions).join(feats, "log_id")
            rows = own if rows is None else rows.select(*own.columns).unionByName(own)
        what = "label"
    size = [F.count(m) for m in MEASURES] if setup.kind == "regressor" else [F.count("*")]
    kinds, *sizes = rows.agg(F.count_distinct(what), *size).first()
    # a forest takes the algorithm as a category (with one more for unknown ones) and needs more rows than categories
    return rows if kinds >= 2 and min(sizes) >= kinds + 2 else None


def _choices(inputs: Inputs, setup: Setup, tagged: DataFrame, fold: int, cache: Registry) -> DataFrame | None:
    """(log_id, weighting, config_hash, score) of what a setup recommends for the real logs of a fold."""
    test = complete(tagged.where((F.col("fold") == fold) & (log_population(F.col("log_id")) == "real"))).drop("fold")
    feats, columns = inputs.features[setup.features], inputs.columns(setup.features)
    candidates = action_rows(inputs, test, setup.actions)
    own = columns + (inputs.parameters if setup.kind == "regressor" else [])

    def fit():
        train = _train(inputs, setup, tagged, fold)
        if train is None:
            return None
        train = train.persist(StorageLevel.DISK_ONLY)
        try:
            medians = imputation(train, own)
            rows = impute(train, medians)
            n = train.count()
            if setup.kind == "classifier":
                return medians, variant_classifier(rows, own, trees=setup.trees, seed=setup.seed), n
            return medians, train_surrogate(rows.where(" or ".join(f"{m} is not null" for m in MEASURES)), own, trees=setup.trees, depth=6, seed=setup.seed), n
        finally:
            train.unpersist()

    fitted = cache.get((setup, fold), fit)
    if fitted is None:
        return None
    medians, model, n = fitted
    real = weighted(candidates).select("log_id", "weighting", "algorithm", "config_hash", "score")
    if setup.kind == "classifier":
        rows = impute(candidates.select("log_id").distinct().join(feats, "log_id"), medians)
        # algorithms a log, not rows: what its candidates offer
        offered = candidates.groupBy("log_id").agg(F.collect_set("algorithm").alias("allowed"))
        picked = real.join(predict_offered(model, rows.join(offered, "log_id")), "log_id").where("algorithm = predicted")
    else:
        guess = predict_measures(model, impute(candidates.join(feats, "log_id"), medians))
        guess = weighted(guess, "pred_", "predicted").select("log_id", "weighting", "config_hash", F.round("predicted", 9).alias("predicted"))
        order = F.row_number().over(Window.partitionBy("log_id", "weighting").orderBy(F.desc("predicted"), "config_hash"))
        picked = real.join(guess, ["log_id", "weighting", "config_hash"]).withColumn("_r", order).where("_r = 1")
    return picked.select("log_id", "weighting", "config_hash", "score", F.lit(n).alias("n_train"))


def ablation_matrix(inputs: Inputs, setups: dict[str, Setup] = SETUPS, folds: int = 5, cache: Registry | None = None, threads: int = 4) -> DataFrame:
    """A row a setup: its axes, mean and median accuracy and regret against all configurations and its own actions, cells and training rows.

    Families stay on one side of a fold. The driver loops over setups and folds,
    which are a design, several at a time; each is fitted once, and predictions
    serve all weightings. A setup that cannot be trained has no cells and null
    figures.
    """
    cache = cache if cache is not None else Registry()
    part = grouped_kfold(inputs.runs, folds).select("log_id", "fold")
    tagged = inputs.runs.join(part, "log_id").persist(StorageLevel.DISK_ONLY)
    spark = inputs.runs.sparkSession
    try:
        names = sorted(r["fold"] for r in tagged.where(log_population(F.col("log_id")) == "real").select("fold").distinct().collect())
        work = [(name, setup, fold) for name, setup in setups.items() for fold in names]

        def grade(name: str, setup: Setup, fold: int) -> list[tuple]:
            chosen = _choices(inputs, setup, tagged, fold, cache)
            if chosen is None:
                return []
            full = weighted(complete(tagged)).select("log_id", "weighting", "score")
            action = weighted(action_rows(inputs, complete(tagged), setup.actions)).select("log_id", "weighting", "score")
            graded = regret_and_rank(full, action, chosen).join(chosen.select("log_id", "weighting", "n_train"), ["log_id", "weighting"])
            # a row a real log and weighting: bounded by the design
            return [(name, fold, *r) for r in graded.select("log_id", "weighting", "accuracy_full", "accuracy_action", "regret_full", "regret_action", "n_train").collect()]

        cells = [row for rows in side_by_side([lambda w=w: grade(*w) for w in work], threads) for row in rows]
    finally:
        tagged.unpersist()
    graded = spark.createDataFrame(cells, "setup string, fold int, log_id string, weighting string, accuracy_full double, accuracy_action double, regret_full double, regret_action double, n_train long")
    axes = spark.createDataFrame([(n, s.kind, s.features, s.data, s.actions) for n, s in setups.items()], "setup string, kind string, features string, data string, actions string")
    figures = [f(F.col(c)).alias(f"{n}_{c}") for c in ("accuracy_full", "accuracy_action", "regret_full", "regret_action") for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, F.lit(0.5))))]
    out = axes.join(graded.groupBy("setup").agg(*figures, F.count("*").alias("n_cells"), F.avg("n_train").alias("mean_train_rows")), "setup", "left")
    return out.fillna(0, ["n_cells"])
