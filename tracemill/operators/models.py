"""Surrogate models of quality measures, and recommendations from them (pyspark.ml)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.evaluate import MEASURES, model_picks, weighted
from tracemill.sources.scratch import scratch


def imputation(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the training rows; a column without values gets zero. One number per column comes to the driver."""
    row = train.agg(*(F.percentile(c, 0.5).alias(c) for c in columns)).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def _assemble(columns: list[str], label: str | None = "algorithm") -> list:
    stages = [StringIndexer(inputCol=label, outputCol="_code", handleInvalid="keep", stringOrderType="alphabetAsc")] if label else []
    return [*stages, VectorAssembler(inputCols=[*columns, *(["_code"] if label else [])], outputCol="_x")]


def train_surrogate(train: DataFrame, columns: list[str], trees: int = 200, depth: int = 12, boosted: bool = False, measures: tuple[str, ...] = MEASURES, seed: int = 42) -> dict[str, PipelineModel]:
    """One forest (or boosted trees) per measure, on the rows that have it."""
    out = {}
    for m in measures:
        kind = GBTRegressor(maxIter=trees, maxDepth=min(depth, 5), seed=seed, labelCol=m, featuresCol="_x", predictionCol=f"pred_{m}") if boosted else RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, labelCol=m, featuresCol="_x", predictionCol=f"pred_{m}")
        out[m] = Pipeline(stages=[*_assemble(columns), kind]).fit(train.where(F.col(m).isNotNull()))
    return out


def predict_measures(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """``pred_*`` for every measure, clamped to [0, 1]."""
    for m, model in models.items():
        rows = model.transform(rows.drop("_x", "_code")).drop("_x", "_code")
        rows = rows.withColumn(f"pred_{m}", F.least(F.greatest(F.col(f"pred_{m}"), F.lit(0.0)), F.lit(1.0)))
    return rows


def variant_classifier(train: DataFrame, columns: list[str], label: str = "label", trees: int = 50, seed: int = 42) -> PipelineModel:
    """A forest over one best label per log.

    The fitted model is written and read back: its training summary holds the
    session, and could not go to tasks once that has observed anything.
    """
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[idx, *_assemble(columns, None), RandomForestClassifier(numTrees=trees, seed=seed, labelCol="_y", featuresCol="_x")]).fit(train)
    path = scratch(train.sparkSession)
    model.write().save(path)
    return PipelineModel.load(path)


def predict_allowed(model: PipelineModel, rows: DataFrame, allowed: list[str], label: str = "label") -> DataFrame:
    """The most probable label among the allowed ones."""
    labels = model.stages[0].labels
    out = rows.withColumn(label, F.lit(labels[0])) if label not in rows.columns else rows
    out = model.transform(out).withColumn("_p", vector_to_array("probability"))
    options = [F.struct(F.col("_p")[i].alias("p"), F.lit(x).alias("label")) for i, x in enumerate(labels) if x in allowed]
    return out.select("log_id", F.array_max(F.array(*options))["label"].alias("predicted"))


def feature_importance(models: dict[str, PipelineModel], columns: list[str], groups: dict[str, str], like: DataFrame) -> DataFrame:
    """(measure, feature, group, importance); groups name log features, hyper-parameters and the algorithm."""
    rows = []
    for m, model in models.items():
        weights = model.stages[-1].featureImportances.toArray()
        rows += [(m, c, groups.get(c, "feature"), float(w)) for c, w in zip([*columns, "algorithm"], weights)]
    return like.sparkSession.createDataFrame(rows, "measure string, feature string, group string, importance double")


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for m, model in models.items():
        model.write().overwrite().save(f"{path}/{m}")


def load_models(path: str) -> dict[str, PipelineModel]:
    return {m: PipelineModel.load(f"{path}/{m}") for m in MEASURES}


def leave_one_out_predictions(rows: DataFrame, columns: list[str], folds: DataFrame, trees: int = 20) -> DataFrame:
    """Predictions for the rows of every fold from models of the others; only the fits loop on the driver."""
    out = None
    tagged = rows.join(folds.select("log_id", "fold"), "log_id").persist(StorageLevel.DISK_ONLY)
    try:
        for (fold,) in sorted(tagged.select("fold").distinct().collect()):
            train = tagged.where(F.col("fold") != fold)
            medians = imputation(train, columns)
            models = train_surrogate(impute(train, medians), columns, trees=trees, depth=8)
            part = predict_measures(models, impute(rows.join(folds.where(F.col("fold") == fold).select("log_id", "fold"), "log_id"), medians))
            out = part if out is None else out.unionByName(part)
    finally:
        tagged.unpersist()
    return out


def fair_fight(predicted: DataFrame, systems: dict[str, str], least: int = 2) -> DataFrame:
    """Picks of several systems (name -> prefix of its predictions) on shared candidates.

    A candidate counts if every system predicts all of its measures, and a log
    if it has ``least`` such candidates: with one there is nothing to choose.
    """
    shared = predicted.dropna(subset=[f"{prefix}{m}" for prefix in systems.values() for m in MEASURES])
    enough = shared.groupBy("log_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shared = shared.join(enough.select("log_id"), "log_id", "left_semi")
    real = weighted(shared)
    out = None
    for name, prefix in systems.items():
        guess = weighted(shared, prefix, "predicted").select("log_id", "weighting", "config_hash", F.round("predicted", 9).alias("predicted"))
        part = model_picks(real.join(guess, ["log_id", "weighting", "config_hash"]), method=name)
        out = part if out is None else out.unionByName(part)
    return out
