"""Queries over models, sources, sinks and the stream (groups M, S, X and parts of V)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracemill.operators import ablation as A
from tracemill.operators import evaluate as V
from tracemill.operators import grid as E
from tracemill.operators import models as L
from tracemill.operators import surrogates as U
from tracemill.operators.features import FEATURE_NAMES, distribution_table, log_features, six_axes
from tracemill.operators.timing import time_extraction
from tracemill.plans.base import register
from tracemill.plans.evaluation_queries import BASE, defaults, scores
from tracemill.plans.grid_queries import ALL, ANY, nested
from tracemill.sources import logs as S
from tracemill.sources import xes_document as X
from tracemill.sources.scratch import scratch, written
from tracemill.sources.views import event_log, lifecycle_log, run_events, runs
from tracemill.streaming import ingest as I

COLUMNS = ["p1", "p2", "runtime_seconds"]
#: What is known of a run before it: its log's features and its parameters.
LEARN = [*FEATURE_NAMES, "p1", "p2"]
TREES = 10  # the default of the operators is 200; a query that only shows them takes fewer
GROUPS = {"p1": "hyper_parameter", "p2": "hyper_parameter", "algorithm": "algorithm"}
PREDICTED = [f"pred_{m}" for m in V.MEASURES]


def training(s, d):
    r = V.complete(runs(s, d)).drop(*PREDICTED)
    return L.impute(r, L.imputation(r, COLUMNS))


def sourced(s, d):
    return runs(s, d).drop(*PREDICTED).withColumn("source", F.col("config_hash"))


register("E7_training_rows", lambda s, d: E.aggregate_runs(sourced(s, d), features=log_features(run_events(s, d))).select("log_id", "config_hash", "failed", *V.MEASURES, "rs4pd_total_traces", "rs4pd_total_events", "rs4pd_distinct_events"), f"""WITH ft AS (SELECT log_id, CAST(count(DISTINCT case_id) AS DOUBLE) AS rs4pd_total_traces, CAST(count(*) AS DOUBLE) AS rs4pd_total_events, CAST(count(DISTINCT activity) AS DOUBLE) AS rs4pd_distinct_events FROM run_events GROUP BY 1),
ok AS (SELECT *, status = 'success' AND {ANY} AS good FROM runs), dn AS (SELECT DISTINCT log_id FROM ok WHERE good AND {ALL})
SELECT log_id, config_hash, NOT good AS failed, {", ".join(f"CASE WHEN good THEN {m} ELSE 0 END AS {m}" for m in V.MEASURES)}, rs4pd_total_traces, rs4pd_total_events, rs4pd_distinct_events FROM ok LEFT JOIN ft USING (log_id) WHERE good OR log_id IN (SELECT log_id FROM dn)""", " ".join((*V.MEASURES, "rs4pd_total_traces", "rs4pd_total_events", "rs4pd_distinct_events")))


def learned(s, d):
    """Training rows with their logs' features, and the medians that filled them."""
    rows = written(E.aggregate_runs(sourced(s, d), features=log_features(run_events(s, d))))
    medians = L.imputation(rows, LEARN)
    return L.impute(rows, medians), medians


def fitted(s, d):
    rows, medians = learned(s, d)
    return L.train_surrogate(rows, LEARN, trees=TREES, depth=6), rows, medians


register("M3_impute_median", lambda s, d: training(s, d).select("log_id", "config_hash", *COLUMNS), BASE + ",\nmd AS (SELECT quantile_cont(p1, 0.5) AS a, quantile_cont(p2, 0.5) AS b, quantile_cont(runtime_seconds, 0.5) AS c FROM cr)\nSELECT log_id, config_hash, coalesce(p1, a) AS p1, coalesce(p2, b) AS p2, coalesce(runtime_seconds, c) AS runtime_seconds FROM cr, md", "p1 p2 runtime_seconds")


def predicted(s, d):
    models, rows, _ = fitted(s, d)
    return U.blended(U.tree_predictions(models, rows), dict.fromkeys(V.MEASURES, 0.25))


register("M4_M5_surrogate", lambda s, d: predicted(s, d).select("log_id", "config_hash", *PREDICTED, *(f"std_{m}" for m in V.MEASURES), "composite", "std", "confidence"))


def recommended(s, d):
    models, rows, medians = fitted(s, d)
    configs = rows.groupBy("config_hash", "algorithm").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    logs = rows.groupBy("log_id").agg(*(F.min(c).alias(c) for c in FEATURE_NAMES))
    return U.recommend(models, configs, logs, {"fitness": 0.5, "precision": 0.5}, 5, medians)


register("M6_recommend", recommended)


def grouped(s, d):
    rows, _ = learned(s, d)
    return U.train_by_group(rows, LEARN, trees=5).predict(rows).select("log_id", "config_hash", *PREDICTED, *(f"by_{m}" for m in V.MEASURES))


register("M7_boosted_surrogates", grouped)


def classified(s, d):
    rows, medians = learned(s, d)
    x = rows.groupBy("log_id").agg(*(F.min(c).alias(c) for c in FEATURE_NAMES))
    labels = V.unique_best_label(V.rank_target(training(s, d)), "algorithm")
    return L.predict_allowed(L.variant_classifier(x.join(labels, "log_id"), list(FEATURE_NAMES), trees=TREES), x, ["alg0", "alg1", "alg2"])


register("M8_variant_classifier", classified)
register("M11_feature_importance", lambda s, d: L.feature_importance(fitted(s, d)[0], LEARN, GROUPS, runs(s, d)))


def saved(s, d):
    models, rows, _ = fitted(s, d)
    path = scratch(s)
    L.save_models(models, path)
    return L.predict_measures(L.load_models(path), rows).select("log_id", "config_hash", "pred_fitness")


register("M12_save_load", saved)


def folded(s, d):
    rows, _ = learned(s, d)
    return L.leave_one_out_predictions(V.complete(rows.where("not failed")), LEARN, V.grouped_kfold(rows, 3), trees=5)


def matrix(s, d):
    """All eleven setups; the outside table has the synthetic logs under other names."""
    log = run_events(s, d)
    feats = {"log": written(log_features(log)), "distribution": written(distribution_table(log))}
    every = written(sourced(s, d).join(feats["log"].select("log_id"), "log_id", "left_semi"))
    inputs = A.Inputs(every, ["p1", "p2"], defaults(s), feats, None, ("alg0", "alg1", "alg2"))
    labelled = A.labels(inputs, every.where("log_id like 'syn%'"), "base_default").join(feats["distribution"], "log_id")
    outside = written(labelled.withColumn("log_id", F.concat(F.lit("other_"), "log_id")))
    few = {n: replace(x, trees=3) for n, x in A.SETUPS.items()}
    out = A.ablation_matrix(replace(inputs, outside=outside), few, folds=2)
    return out.select("setup", "kind", "features", "data", "actions", "n_cells", "mean_accuracy_full", "median_accuracy_full", "mean_accuracy_action", "mean_regret_full", "mean_train_rows")


def given(s, d):
    """Complete runs with the given predictions and, as another system, their complement."""
    return V.complete(runs(s, d)).withColumns({f"other_{m}": 1 - F.col(f"pred_{m}") for m in V.MEASURES})


register("V10_fair_fight", lambda s, d: V.win_tie_loss(V.minmax_accuracy(V.weighted(given(s, d)), L.fair_fight(given(s, d), {"model": "pred_", "other": "other_"})).withColumn("accuracy", F.round("accuracy", 9)), "model"))
register("V12_menu_delta", lambda s, d: V.minmax_accuracy(scores(s, d), V.model_picks(scores(s, d)).unionByName(V.model_picks(scores(s, d).join(runs(s, d).where("experiment_id <> 'v6_hpo'").select("log_id", "config_hash"), ["log_id", "config_hash"], "left_semi"), method="grid_menu")).unionByName(V.model_picks(scores(s, d).join(V.default_ground_truth(runs(s, d), defaults(s)).select("log_id", "config_hash"), ["log_id", "config_hash"], "left_semi"), method="defaults"))).groupBy("method").agg(F.avg("accuracy").alias("accuracy"), F.avg("score").alias("realised"), F.count("*").alias("n_cells")), BASE + """,
de AS (SELECT log_id, config_hash FROM (SELECT cr.*, row_number() OVER (PARTITION BY log_id, algorithm ORDER BY round(coalesce((p1 - d1) ** 2, 0) + coalesce((p2 - d2) ** 2, 0), 9), config_hash) AS rn FROM cr JOIN (SELECT * FROM (VALUES ('alg0', NULL, NULL), ('alg1', 0.5e0, NULL), ('alg2', 0.5e0, 2.0e0), ('alg3', 0.25e0, 1.0e0)) t(algorithm, d1, d2)) USING (algorithm)) WHERE rn = 1),
mn AS (SELECT 'model' AS method, sc.* FROM sc UNION ALL SELECT 'grid_menu', sc.* FROM sc WHERE config_hash NOT IN (SELECT config_hash FROM cr WHERE experiment_id = 'v6_hpo') UNION ALL SELECT 'defaults', sc.* FROM sc SEMI JOIN de USING (log_id, config_hash)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, log_id, weighting ORDER BY round(predicted, 9) DESC, config_hash) AS r FROM mn) WHERE r = 1)
SELECT method, avg(CASE WHEN best = worst THEN 1 ELSE (score - worst) / (best - worst) END) AS accuracy, avg(score) AS realised, count(*) AS n_cells FROM pk JOIN ce USING (log_id, weighting) GROUP BY 1""", "accuracy realised")
register("V5_folded_regression_error", lambda s, d: V.regression_error(folded(s, d)))
register("V23_ablation_matrix", matrix)


def xes_back(s, d):
    path = scratch(s)
    S.write_xes(event_log(s, d), path)
    return S.read_xes(s, f"{path}/*/*.xml")[0]


register("S1_S8_xes_round_trip", lambda s, d: xes_back(s, d).groupBy("case_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "activity"))), lambda x: x["activity"]), " > ").alias("variant")), "SELECT case_id, count(*) AS n, string_agg(activity, ' > ' ORDER BY ts NULLS LAST, event_index) AS variant FROM event_log GROUP BY 1")


def csv_back(s, d):
    path = scratch(s) + ".csv"
    event_log(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", True).csv(path)
    return S.read_log(s, path).select("log_id", "case_id", "activity", "ts", F.col("event_index").cast("int").alias("event_index"))


register("S2_log_scan_csv", csv_back, "SELECT * FROM event_log")


def dataset_back(s, d):
    path = scratch(s)
    r = runs(s, d).select("log_id", "config_hash", "p1", "fitness")
    S.write_dataset(r, path)
    return S.read_dataset(s, path, "log_id string, config_hash string, p1 double, fitness double")


register("S5_dataset_round_trip", dataset_back, "SELECT log_id, config_hash, p1, fitness FROM runs", "p1 fitness")


def cache_back(s, d):
    path = scratch(s)
    S.write_log_cache(event_log(s, d), path)
    return s.read.parquet(path).select("log_id", "case_id", "activity", "ts", "event_index")


register("S6_log_cache", cache_back, "SELECT * FROM event_log")


def headers(s, d):
    """Headers that follow from a log: fixed extensions and a classifier, defaults by its first case and activity."""
    h = lifecycle_log(s, d).groupBy("log_id").agg(F.min("case_id").alias("c"), F.min("activity").alias("a"))
    fixed = [("extension", "Concept", "concept", "http://www.xes-standard.org/concept.xesext"), ("extension", "Lifecycle", "lifecycle", "http://www.xes-standard.org/lifecycle.xesext"), ("classifier", "Activity & step", None, "concept:name lifecycle:transition")]
    parts = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("part", "name", "detail", "value"), row))) for row in fixed]
    parts += [F.struct(F.lit("global").alias("part"), F.lit("concept:name").alias("name"), F.lit(scope).alias("detail"), F.col(c).alias("value")) for scope, c in (("trace", "c"), ("event", "a"))]
    return h.select("log_id", F.explode(F.array(*parts)).alias("p")).select("log_id", "p.*")


def documents(s, d):
    path = scratch(s)
    X.write_document(lifecycle_log(s, d), path, headers(s, d), lifecycle="keep", files=2)
    return f"{path}/*/*/*"


register("S3_header_tables", lambda s, d: X.header_table(s, documents(s, d)), """WITH h AS (SELECT log_id, min(case_id) AS c, min(activity) AS a FROM lifecycle_log GROUP BY 1)
SELECT log_id, part, name, detail, CASE value WHEN '?c' THEN c WHEN '?a' THEN a ELSE value END AS value FROM h, (VALUES ('extension', 'Concept', 'concept', 'http://www.xes-standard.org/concept.xesext'), ('extension', 'Lifecycle', 'lifecycle', 'http://www.xes-standard.org/lifecycle.xesext'), ('classifier', 'Activity & step', NULL, 'concept:name lifecycle:transition'), ('global', 'concept:name', 'trace', '?c'), ('global', 'concept:name', 'event', '?a'), ('trace', 'concept:name', NULL, NULL), ('event', 'concept:name', NULL, NULL), ('event', 'time:timestamp', NULL, NULL), ('event', 'lifecycle:transition', NULL, NULL)) t(part, name, detail, value)""".replace("\nSELECT log_id, part", "\nSELECT log_id, part"))
register("S8_xes_lifecycle", lambda s, d: S.read_xes(s, documents(s, d))[0].groupBy("case_id", "lifecycle", "activity").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "SELECT case_id, lifecycle, activity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM lifecycle_log GROUP BY ALL")


def write_results(df, path, by="log_id"):
    """Results as JSON, an array of them in a file for each value of ``by``."""
    arrays = df.groupBy(by).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    arrays.withColumn("of", F.col(by)).select("of", "value").repartition("of").write.partitionBy("of").text(path)


def json_back(s, d):
    path = scratch(s)
    write_results(nested(s, d).withColumn("config_hash", F.lit("c")), path + "/good")
    write_results(nested(s, d).withColumn("config_hash", F.lit("c")), path + "/left_out")
    s.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(path + "/bad")
    found, corrupt = S.read_results(s, [path], ("left_out",))
    return found.groupBy("log_id", "status").agg(F.count("*").alias("n")).unionByName(corrupt.select(F.lit("corrupt files").alias("log_id"), F.lit(None).cast("string").alias("status"), F.col("corrupt").alias("n")))


register("S4_results_scan", json_back, "SELECT log_id, status, count(*) AS n FROM runs GROUP BY 1, 2 UNION ALL SELECT 'corrupt files', NULL, 1")


def checksummed(s, d):
    """A file a log with its case ids in order, a line each."""
    path = scratch(s)
    lines = event_log(s, d).select("log_id", "case_id").distinct().repartition("log_id").sortWithinPartitions("log_id", "case_id")
    lines.write.partitionBy("log_id").text(path)
    f = S.file_checksums(s, path)
    return f.select(F.regexp_extract("path", "log_id=([^/]+)", 1).alias("log_id"), "size", "sha256")


register("S7_file_checksums", checksummed, "WITH t AS (SELECT log_id, string_agg(case_id || chr(10), '' ORDER BY case_id) AS body FROM (SELECT DISTINCT log_id, case_id FROM event_log) GROUP BY 1)\nSELECT log_id, strlen(body) AS size, sha256(body) AS sha256 FROM t")


def streamed(s, d):
    """Two waves of result files through the stream: the second repeats runs with other values, earlier times and new runs."""
    src, table, mark = scratch(s), scratch(s), scratch(s)
    r = nested(s, d)
    write_results(r.where("algorithm_name <> 'alg2'"), f"{src}/first")
    I.ingest(s, src, table, mark).awaitTermination()
    late = r.where("algorithm_name in ('alg1', 'alg2')").withColumn("status", F.when(F.col("algorithm_name") == "alg1", "repeated").otherwise(F.col("status")))
    write_results(late.withColumn("metadata", F.col("metadata").withField("timestamp_utc", F.lit("2001-01-01T00:00:00Z"))), f"{src}/second")
    I.ingest(s, src, table, mark).awaitTermination()
    return I.read_ingested(s, table).select("log_id", "config_hash", "status", F.col("metrics")["fitness"].alias("fitness"), "batch_id")


register("X1_result_stream", streamed, "SELECT log_id, config_hash, status, fitness, CASE WHEN algorithm = 'alg2' THEN 1 ELSE 0 END AS batch_id FROM runs", "fitness")


def timed(s, d):
    log = event_log(s, d)
    ids = [r[0] for r in log.select("log_id").distinct().orderBy("log_id").collect()]
    out = time_extraction(log, six_axes, ids)
    # seconds differ from run to run: the query shows that they were measured
    return out.select("log_id", "n_events", "n_cases", "n_features", ((F.col("seconds") > 0) & (F.col("events_per_second") > 0)).alias("measured"))


register("V24_time_extraction", timed, "SELECT log_id, count(*) AS n_events, count(DISTINCT case_id) AS n_cases, 6 AS n_features, true AS measured FROM event_log GROUP BY 1")
