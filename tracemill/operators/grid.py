"""Experiment grids and their results: configurations, manifests, aggregation, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import uniform
from tracemill.operators.evaluate import MEASURES


def expand_grid(spark: SparkSession, space: dict[str, list[float]], conditional: list[tuple[str, float, dict[str, list[float]]]] = ()) -> DataFrame:
    """Every combination of the value lists; a branch (parameter, value, lists) multiplies the rows that match it, others get nulls."""
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, values in space.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    for parameter, value, lists in conditional:
        hit = F.col(parameter) == value
        for name, values in lists.items():
            out = out.withColumn(name, F.explode(F.when(hit, F.array(*(F.lit(float(v)) for v in values))).otherwise(F.array(F.lit(None).cast("double")))))
    return out.drop("_one")


def config_hash(parameters: list[str], algorithm: str = "algorithm") -> Column:
    """A hash of the algorithm and its parameters in name order; fields that only steer a run don't enter."""
    parts = [F.concat(F.lit(f"{p}="), F.when(F.col(p).isNull(), "_").otherwise(F.format_string("%.6f", F.col(p)))) for p in sorted(parameters)]
    return F.substring(F.sha2(F.concat_ws("|", F.col(algorithm), *parts), 256), 1, 16)


def build_manifest(logs: DataFrame, configs: DataFrame, parameters: list[str]) -> DataFrame:
    """One row per log and configuration. The configurations are a design of bounded size."""
    c = configs.withColumn("config_hash", config_hash(parameters))
    out = logs.select("log_id").distinct().crossJoin(F.broadcast(c))
    return out.withColumn("row_id", F.substring(F.sha2(F.concat_ws("|", "log_id", "config_hash"), 256), 1, 16))


def sample_lhs(spark: SparkSession, dims: dict[str, tuple], n: int, seed: int) -> DataFrame:
    """``n`` configurations with one draw per stratum and dimension.

    dims: name -> ("choice", [values]) or ("float" | "int", low, high, "linear" | "log").
    """
    out = spark.range(n)
    for name, spec in dims.items():
        w = Window.orderBy(F.xxhash64(F.lit(seed), F.lit(name), "id"))  # n design points
        u = (F.row_number().over(w) - 1 + uniform(seed + 1, F.lit(name), "id")) / n
        if spec[0] == "choice":
            value = F.element_at(F.array(*map(F.lit, spec[1])), (F.floor(u * len(spec[1])) + 1).cast("int"))
        else:
            _, low, high, how = spec
            value = F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))) if how == "log" else F.lit(float(low)) + u * (high - low)
            if spec[0] == "int":
                value = F.least(F.greatest(F.bround(value), F.lit(float(low))), F.lit(float(high)))
        out = out.withColumn(name, value)
    return out


def validate_params(configs: DataFrame, spec: DataFrame, parameters: list[str]) -> DataFrame:
    """(config_hash, parameter, value, rule): unknown parameters, values outside the range, fractions of integers.

    spec: algorithm, parameter, kind (int or float), low, high.
    """
    long = configs.unpivot(["config_hash", "algorithm"], parameters, "parameter", "value").where("value is not null")
    j = long.join(F.broadcast(spec), ["algorithm", "parameter"], "left")
    v = F.col("value")
    rule = F.when(F.col("kind").isNull(), "unknown").when((v < F.col("low")) | (v > F.col("high")), "out_of_range").when((F.col("kind") == "int") & (v != F.floor(v)), "not_an_integer")
    return j.withColumn("rule", rule).where("rule is not null").select("config_hash", "parameter", "value", "rule")


def metric_manifest(manifest: DataFrame) -> DataFrame:
    """Every manifest row as a metric job, with the model path that its run writes; hash and order stay."""
    return manifest.withColumns({"job": F.lit("metrics"), "model_path": F.concat_ws("/", F.lit("models"), "log_id", F.concat("config_hash", F.lit(".pnml")))})


def any_measure() -> Column:
    out = F.lit(False)
    for m in MEASURES:
        out = out | F.col(m).isNotNull()
    return out


def all_measures() -> Column:
    out = F.lit(True)
    for m in MEASURES:
        out = out & F.col(m).isNotNull()
    return out


def aggregate_runs(runs: DataFrame, order: str = "source", features: DataFrame | None = None) -> DataFrame:
    """Training rows: measured successes, once per (log, configuration), and all-zero rows for failures.

    A failure counts only on logs with at least one complete run, and only if
    its configuration has no measured row there. Rows without a config_hash are
    all kept. With ``features`` (log_id and columns) every row gets its log's,
    nulls if it has none. One window picks the row of a configuration, measured
    ones first, and one over the log's picked rows sees whether it has a
    complete run: the runs are read once.
    """
    good = (F.col("status") == "success") & any_measure()
    place = F.row_number().over(Window.partitionBy("log_id", "config_hash").orderBy(F.desc("_good"), order))
    picked = runs.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_r", F.when(F.col("config_hash").isNull(), 1).otherwise(place)).where("_r = 1")
    done = F.max(F.col("_good") & all_measures()).over(Window.partitionBy("log_id"))
    kept = picked.withColumn("_done", done).where("_good or _done")
    zero = {m: F.when(F.col("_good"), F.col(m)).otherwise(F.lit(0.0)) for m in MEASURES}
    out = kept.withColumns(zero).withColumn("failed", ~F.col("_good")).drop("_good", "_r", "_done")
    return out if features is None else out.join(features, "log_id", "left")


def skip_reasons(runs: DataFrame) -> DataFrame:
    """How many rows don't train, by reason."""
    reason = F.when(F.col("status") != "success", F.concat(F.lit("status_"), "status")).when(~any_measure(), "no_measure").when(~all_measures(), "partial").otherwise("complete")
    return runs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def attach_metrics(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Every manifest row with its measures; a missing result gives zeros with status missing_model."""
    j = manifest.join(results.withColumn("_found", F.lit(True)), ["log_id", "config_hash"], "left")
    ok = F.coalesce(F.col("_found") & (F.col("status") == "success"), F.lit(False))
    out = j.withColumns({m: F.when(ok, F.coalesce(m, F.lit(0.0))).otherwise(0.0) for m in MEASURES})
    return out.withColumn("metric_status", F.when(ok, "success").otherwise("missing_model")).withColumn("status", F.when(F.col("_found"), F.col("status")).otherwise("success_missing")).drop("_found")


def pending_runs(manifest: DataFrame, results: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows still to compute: no result yet, or a placeholder whose source has appeared since."""
    have = results.select("log_id", "config_hash", F.col("metric_status").alias("_s"))
    src = sources.select("log_id", "config_hash").distinct().withColumn("_src", F.lit(True))
    j = manifest.join(have, ["log_id", "config_hash"], "left").join(src, ["log_id", "config_hash"], "left")
    return j.where(F.col("_s").isNull() | ((F.col("_s") == "missing_model") & F.col("_src").isNotNull())).drop("_s", "_src")


def best_config_per_pair(runs: DataFrame) -> DataFrame:
    """Per (log, algorithm) the complete success of the best mean measure; ties by runtime (none is last), then hash."""
    x = runs.where((F.col("status") == "success") & all_measures())
    score = F.round(sum((F.col(m) for m in MEASURES), F.lit(0.0)) / 4, 9)
    r = F.row_number().over(Window.partitionBy("log_id", "algorithm").orderBy(F.desc("score"), F.coalesce("runtime_seconds", F.lit(float("inf"))), "config_hash"))
    return x.withColumn("score", score).withColumn("_r", r).where("_r = 1").select("log_id", "algorithm", "config_hash", "score", "runtime_seconds")


def objective(runs: DataFrame, weights: dict[str, float], failed: float = 0.0) -> DataFrame:
    """Weighted mean of the weighted measures, or the failed value if the status is bad or one of them is missing."""
    used = {m: w for m, w in weights.items() if w}
    fine = F.col("status") == "success"
    for m in used:
        fine = fine & F.col(m).isNotNull()
    total = sum(used.values()) or 1.0
    value = sum((F.coalesce(m, F.lit(0.0)) * w for m, w in used.items()), F.lit(0.0)) / total
    return runs.withColumn("objective", F.when(fine, value).otherwise(F.lit(failed)))


def study_summary(trials: DataFrame) -> DataFrame:
    """Per (log, algorithm): trials by status, the best one, and total runtime."""
    order = F.struct(F.round("objective", 9), F.col("config_hash"))
    return trials.groupBy("log_id", "algorithm").agg(F.count("*").alias("n_trials"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_failed"), F.max_by("config_hash", order).alias("best_config"), F.max("objective").alias("best_objective"), F.sum("runtime_seconds").alias("runtime_seconds"))


def consistent_trials(trials: DataFrame, parameters: list[str]) -> DataFrame:
    """(log_id, stated_hash, ok): whether a trial's stated hash is that of its parameters."""
    return trials.select("log_id", "stated_hash", (F.col("stated_hash") == config_hash(parameters)).alias("ok"))


def accepted_log_refs(tables: list[DataFrame], stress: bool = True) -> DataFrame:
    """Accepted logs of several inventories (log_id, status, stress), once each."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    out = out.where("status = 'accepted'")
    return (out if stress else out.where("not stress")).select("log_id").distinct()


def run_status_summary(runs: DataFrame) -> DataFrame:
    """Runs by status per algorithm, and over all."""
    kinds = ("success", "failed", "timeout")
    out = runs.rollup("algorithm").agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds), F.count("*").alias("total"))
    return out.withColumn("algorithm", F.coalesce("algorithm", F.lit("TOTAL")))


def flatten_results(results: DataFrame, metrics: list[str], parameters: list[str]) -> DataFrame:
    """Nested results as wide rows: ``metric_*``, ``metric_status_*``, ``param_*`` and the metadata fields."""
    return results.select(
        "experiment_id", "log_id", "status", "algorithm_name", "runtime_seconds",
        *(F.col("metrics").getItem(m).alias(f"metric_{m}") for m in metrics), *(F.col("metric_statuses").getItem(m)["status"].alias(f"metric_status_{m}") for m in metrics),
        *(F.col("hyperparameters").getItem(p).alias(f"param_{p}") for p in parameters), F.col("metadata.timestamp_utc").alias("metadata_timestamp_utc"),
    )


def manifest_upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; rows with status skipped_existing never do."""
    real = new.where("status <> 'skipped_existing'")
    only_new = new.where("status = 'skipped_existing'").join(existing.select(*key), key, "left_anti")
    incoming = real.unionByName(only_new.select(*real.columns))
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)
