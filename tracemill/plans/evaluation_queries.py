"""Queries over runs: weightings, baselines and evaluation (groups M and V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import evaluate as V
from tracemill.operators.clean import log_family
from tracemill.plans.base import register
from tracemill.plans.space_queries import FEATS, small_features
from tracemill.sources.views import runs

M = V.MEASURES
GRID = "wg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w[0]}e0, {w[1]}e0, {w[2]}e0, {w[3]}e0)" for n, w in V.weight_sets().items()) + ") t(weighting, w_fitness, w_precision, w_generalization, w_simplicity))"
COMP = "cr AS (SELECT * FROM runs WHERE fitness IS NOT NULL AND precision IS NOT NULL AND generalization IS NOT NULL AND simplicity IS NOT NULL)"
_S = "({p}fitness * w_fitness + {p}precision * w_precision + {p}generalization * w_generalization + {p}simplicity * w_simplicity) / (w_fitness + w_precision + w_generalization + w_simplicity)"
SC = f"sc AS (SELECT log_id, weighting, algorithm, config_hash, {_S.format(p='')} AS score, {_S.format(p='pred_')} AS predicted FROM cr, wg)"
CELLS = "ce AS (SELECT log_id, weighting, max(score) AS best, min(score) AS worst FROM sc GROUP BY 1, 2)"
ACC = "CASE WHEN best = worst THEN 1 ELSE ({0} - worst) / (best - worst) END"
FAM = "CASE WHEN starts_with(log_id, 'aug_') THEN split_part(substr(log_id, 5), '__', 1) ELSE log_id END"
POP = "CASE WHEN starts_with(log_id, 'syn_gedi') THEN 'gedi' WHEN starts_with(log_id, 'aug_') THEN 'augmented' WHEN starts_with(log_id, 'syn_') THEN 'synth' ELSE 'real' END"
BASE = "WITH " + ",\n".join((GRID, COMP, SC, CELLS))


def scores(s, d):
    c = V.weighted(V.complete(runs(s, d)))
    p = V.weighted(V.complete(runs(s, d)), "pred_", "predicted").select("log_id", "weighting", "config_hash", "predicted")
    return c.join(p, ["log_id", "weighting", "config_hash"]).select("log_id", "weighting", "algorithm", "config_hash", "score", F.round("predicted", 9).alias("predicted"))


def picks(s, d):
    x = scores(s, d)
    return V.model_picks(x, k=1).unionByName(V.model_picks(x, k=3, method="model_top3"))


def accuracies(s, d):
    return V.minmax_accuracy(scores(s, d), picks(s, d)).withColumn("accuracy", F.round("accuracy", 9))


def defaults(s, d=None):
    return s.createDataFrame([("alg0", None, None), ("alg1", 0.5, None), ("alg2", 0.5, 2.0), ("alg3", 0.25, 1.0)], "algorithm string, p1 double, p2 double")


DEF = "df AS (SELECT * FROM (VALUES ('alg0', NULL, NULL), ('alg1', 0.5e0, NULL), ('alg2', 0.5e0, 2.0e0), ('alg3', 0.25e0, 1.0e0)) t(algorithm, d1, d2))"
GT = "gt AS (SELECT * FROM (SELECT cr.*, row_number() OVER (PARTITION BY log_id, algorithm ORDER BY round(coalesce((p1 - d1) ** 2, 0) + coalesce((p2 - d2) ** 2, 0), 9), config_hash) AS rn FROM cr JOIN df USING (algorithm)) WHERE rn = 1)"
GS = f"gs AS (SELECT log_id, weighting, algorithm, {_S.format(p='')} AS deft FROM gt, wg)"
PICK = """rk AS (SELECT *, row_number() OVER (PARTITION BY log_id, weighting ORDER BY round(predicted, 9) DESC, config_hash) AS r FROM sc),
pk AS (SELECT log_id, weighting, 'model' AS method, max(score) AS score FROM rk WHERE r <= 1 GROUP BY 1, 2 UNION ALL SELECT log_id, weighting, 'model_top3', max(score) FROM rk WHERE r <= 3 GROUP BY 1, 2),
ac AS (SELECT log_id, weighting, method, score, best, worst, """ + ACC.format("score") + " AS accuracy FROM pk JOIN ce USING (log_id, weighting))"

register("M1_weight_grid", lambda s, d: V.weighted(runs(s, d).select("log_id", *(F.lit(1.0).alias(m) for m in M))).groupBy("log_id", "weighting").agg(F.count("*").alias("n"), F.max("score").alias("total")), "WITH " + GRID + "\nSELECT log_id, weighting, count(*) AS n, 1.0 AS total FROM runs, wg GROUP BY 1, 2", "total")
register("M2_composite", lambda s, d: scores(s, d).select("log_id", "weighting", "config_hash", "score"), BASE + "\nSELECT log_id, weighting, config_hash, score FROM sc", "score")
register("V1_leave_one_family_out", lambda s, d: V.leave_one_family_out(runs(s, d)), f"WITH f AS (SELECT DISTINCT log_id, {FAM} AS family FROM runs)\nSELECT a.log_id AS test_log, b.log_id AS train_log FROM f a JOIN f b ON a.family <> b.family")
register("V2_grouped_kfold", lambda s, d: V.grouped_kfold(runs(s, d)), f"""WITH f AS (SELECT DISTINCT log_id, {FAM} AS family FROM runs), z AS (SELECT family, row_number() OVER (ORDER BY count(*) DESC, family) - 1 AS r FROM f GROUP BY 1)
SELECT log_id, family, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM f JOIN z USING (family)""")
register("V3_minmax_accuracy", accuracies, BASE + ",\n" + PICK + "\nSELECT * FROM ac", "score best worst accuracy")
register("V4_acc_at_3", lambda s, d: V.acc_at_k(V.complete(runs(s, d)), 3), "WITH " + COMP + ",\n" + ",\n".join(f"a{i} AS (SELECT '{m}' AS measure, avg(CASE WHEN b = w THEN 1 ELSE (v - w) / (b - w) END) AS accuracy FROM (SELECT log_id, any_value(b) AS b, any_value(w) AS w, max({m}) AS v FROM (SELECT log_id, {m}, max({m}) OVER (PARTITION BY log_id) AS b, min({m}) OVER (PARTITION BY log_id) AS w, row_number() OVER (PARTITION BY log_id ORDER BY pred_{m} DESC, config_hash) AS r FROM cr) WHERE r <= 3 GROUP BY 1))" for i, m in enumerate(M)) + "\nSELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3", "accuracy")
_LNG = "lg AS (" + " UNION ALL ".join(f"SELECT algorithm, '{m}' AS measure, {m} AS y, pred_{m} AS p FROM runs WHERE {m} IS NOT NULL" for m in M) + ")"
_E = "count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2"
register("V5_regression_error", lambda s, d: V.regression_error(runs(s, d)), f"WITH {_LNG}\nSELECT measure, {_E} FROM lg GROUP BY 1", "mae rmse r2")
register("V5_regression_error_by_algorithm", lambda s, d: V.regression_error(runs(s, d), ("algorithm",)), f"WITH {_LNG}\nSELECT algorithm, measure, {_E} FROM lg GROUP BY 1, 2", "mae rmse r2")
register("V6_spearman", lambda s, d: V.spearman(V.working(V.complete(runs(s, d))), ["log_id"], "pred_fitness", "fitness"), "WITH " + COMP + """,
w AS (SELECT * FROM cr WHERE NOT (fitness = 0 AND precision = 0 AND generalization = 0 AND simplicity = 0)),
r AS (SELECT log_id, fitness AS y, pred_fitness AS p, rank() OVER (PARTITION BY log_id ORDER BY fitness) + (count(*) OVER (PARTITION BY log_id, fitness) - 1) / 2 AS ra, rank() OVER (PARTITION BY log_id ORDER BY pred_fitness) + (count(*) OVER (PARTITION BY log_id, pred_fitness) - 1) / 2 AS rb FROM w)
SELECT log_id, count(*) AS n_configs, CASE WHEN count(*) >= 3 AND min(y) < max(y) AND min(p) < max(p) THEN corr(ra, rb) END AS rho FROM r GROUP BY 1""", "rho")
register("V7_group_report", lambda s, d: V.group_report(accuracies(s, d)), BASE + ",\n" + PICK + f""",
x AS (SELECT {POP} AS population, weighting, method, accuracy FROM ac), y AS (SELECT population, weighting, method, accuracy FROM x UNION ALL SELECT 'combined', weighting, method, accuracy FROM x),
z AS (SELECT * FROM y UNION ALL SELECT population, 'MEAN', method, accuracy FROM y)
SELECT population, weighting, method, avg(accuracy) AS accuracy, count(*) AS n FROM z GROUP BY 1, 2, 3""", "accuracy")
register("V8_win_tie_loss", lambda s, d: V.win_tie_loss(accuracies(s, d), "model"), BASE + ",\n" + PICK + """
SELECT a.method, count(*) FILTER (WHERE a.accuracy - b.accuracy > 1e-9) AS wins, count(*) FILTER (WHERE abs(a.accuracy - b.accuracy) <= 1e-9) AS ties, count(*) FILTER (WHERE a.accuracy - b.accuracy < -1e-9) AS losses FROM ac a JOIN ac b USING (log_id, weighting) WHERE b.method = 'model' AND a.method <> 'model' GROUP BY 1""")
register("V9_default_ground_truth", lambda s, d: V.default_ground_truth(runs(s, d), defaults(s)).select("log_id", "algorithm", "config_hash", *M), "WITH " + ",\n".join((COMP, DEF, GT)) + "\nSELECT log_id, algorithm, config_hash, fitness, precision, generalization, simplicity FROM gt", " ".join(M))
_FAR = "CASE WHEN d1 IS NULL AND d2 IS NULL THEN CAST((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT AS DOUBLE) ELSE sqrt(CASE WHEN d1 IS NULL THEN CASE WHEN p1 IS NOT NULL THEN 0.01 ELSE 0 END ELSE coalesce((p1 - d1) ** 2, 10) END + CASE WHEN d2 IS NULL THEN CASE WHEN p2 IS NOT NULL THEN 0.01 ELSE 0 END ELSE coalesce((p2 - d2) ** 2, 10) END) END"
register("V11_default_representatives", lambda s, d: V.default_representatives(runs(s, d), defaults(s)).select("log_id", "algorithm", "config_hash"), "WITH " + DEF + f""",
r AS (SELECT log_id, algorithm, config_hash, row_number() OVER (PARTITION BY log_id, algorithm ORDER BY contains(experiment_id, 'baseline') DESC, (p1 IS NULL AND p2 IS NULL) DESC, round({_FAR}, 9), round((fitness + precision + generalization + simplicity) / 4, 9) DESC NULLS LAST, config_hash) AS rn FROM runs LEFT JOIN df USING (algorithm))
SELECT log_id, algorithm, config_hash FROM r WHERE rn = 1""")
register("V13_oracle_ladder", lambda s, d: V.oracle_ladder(runs(s, d), defaults(s), ["alg0", "alg1"]), BASE + ",\n" + ",\n".join((DEF, GT, GS)) + """,
sh AS (SELECT log_id, weighting, max(score) AS shared FROM sc WHERE algorithm IN ('alg0', 'alg1') GROUP BY 1, 2), de AS (SELECT log_id, weighting, max(deft) AS deft FROM gs GROUP BY 1, 2),
j AS (SELECT * FROM ce JOIN de USING (log_id, weighting) LEFT JOIN sh USING (log_id, weighting) WHERE best - worst >= 1e-9),
u AS (SELECT 'oracle_best_of_defaults' AS rung, avg((deft - worst) / (best - worst)) AS accuracy, count(*) AS n_cells FROM j UNION ALL SELECT 'oracle_best_shared_tuned', avg((shared - worst) / (best - worst)), count(*) FROM j UNION ALL SELECT 'oracle_full_grid', 1, count(*) FROM j)
SELECT * FROM u""", "accuracy")
register("V14_tuning_headroom", lambda s, d: V.tuning_headroom(runs(s, d), defaults(s)), BASE + ",\n" + ",\n".join((DEF, GT, GS)) + """,
b AS (SELECT log_id, weighting, algorithm, max(score) AS top FROM sc GROUP BY 1, 2, 3)
SELECT algorithm, avg((top - deft) / (best - worst)) AS tuning_headroom, count(*) AS n_cells FROM b JOIN gs USING (log_id, weighting, algorithm) JOIN ce USING (log_id, weighting) WHERE best - worst >= 1e-9 GROUP BY 1""", "tuning_headroom")
register("V15_menu_gap", lambda s, d: V.menu_gap(runs(s, d), defaults(s)), BASE + ",\n" + ",\n".join((DEF, GT, GS)) + """,
b AS (SELECT log_id, weighting, algorithm AS best_algorithm FROM (SELECT *, row_number() OVER (PARTITION BY log_id, weighting ORDER BY round(score, 9) DESC, algorithm DESC) AS r FROM sc) WHERE r = 1), de AS (SELECT log_id, weighting, max(deft) AS deft FROM gs GROUP BY 1, 2)
SELECT log_id, weighting, 1 - (deft - worst) / (best - worst) AS menu_gap, best_algorithm FROM ce JOIN de USING (log_id, weighting) JOIN b USING (log_id, weighting) WHERE best - worst >= 1e-9""", "menu_gap")
register("V16_observed_search_space", lambda s, d: V.observed_search_space(runs(s, d), ["p1", "p2"]), """WITH l AS (SELECT algorithm, 'p1' AS parameter, p1 AS v FROM runs WHERE p1 IS NOT NULL UNION ALL SELECT algorithm, 'p2', p2 FROM runs WHERE p2 IS NOT NULL)
SELECT algorithm, parameter, CASE WHEN bool_and(v = floor(v)) THEN 'int' ELSE 'float' END AS kind, min(v) AS low, max(v) AS high FROM l GROUP BY 1, 2 HAVING min(v) < max(v)""", "low high")
register("V17_winning_algorithm", lambda s, d: V.winning_algorithm(runs(s, d)), BASE + f""",
t AS (SELECT log_id, weighting, algorithm, round(max(score), 9) AS score FROM sc GROUP BY 1, 2, 3), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, weighting ORDER BY score DESC, algorithm) AS r FROM t) WHERE r = 1), n AS (SELECT log_id, count(DISTINCT algorithm) AS distinct_winners FROM w GROUP BY 1)
SELECT log_id, weighting, algorithm, score, distinct_winners, {POP} AS population FROM w JOIN n USING (log_id)""", "score")
register("V18_headroom", lambda s, d: V.headroom(runs(s, d)), BASE + "\nSELECT log_id, avg(best - worst) AS headroom FROM ce GROUP BY 1", "headroom")
register("V19_log_inventory", lambda s, d: V.log_inventory(runs(s, d)), """WITH x AS (SELECT log_id, (fitness IS NOT NULL)::INT + (precision IS NOT NULL)::INT + (generalization IS NOT NULL)::INT + (simplicity IS NOT NULL)::INT AS k, coalesce(fitness, 1) = 0 AND coalesce(precision, 1) = 0 AND coalesce(generalization, 1) = 0 AND coalesce(simplicity, 1) = 0 AS z FROM runs)
SELECT coalesce(log_id, 'TOTAL') AS log_id, count(*) AS rows_total, count(*) FILTER (WHERE k = 4) AS complete, count(*) FILTER (WHERE z) AS zeros, count(*) FILTER (WHERE k BETWEEN 1 AND 3) AS partial, count(*) FILTER (WHERE k = 4) > 0 AS gradable FROM x GROUP BY ROLLUP (log_id)""")
register("V20_regret_and_rank", lambda s, d: V.regret_and_rank(scores(s, d), scores(s, d).where("algorithm in ('alg0', 'alg2')"), V.model_picks(scores(s, d).where("algorithm in ('alg0', 'alg2')"))), BASE + """,
a AS (SELECT * FROM sc WHERE algorithm IN ('alg0', 'alg2')),
p AS (SELECT log_id, weighting, score AS own FROM (SELECT *, row_number() OVER (PARTITION BY log_id, weighting ORDER BY round(predicted, 9) DESC, config_hash) AS r FROM a) WHERE r = 1),
f1 AS (SELECT log_id, weighting, max(score) - any_value(own) AS regret_full, CASE WHEN max(score) = min(score) THEN 1 ELSE (any_value(own) - min(score)) / (max(score) - min(score)) END AS accuracy_full, count(*) FILTER (WHERE score > own + 1e-12) + 1 AS rank_full, count(*) AS n_full_configs FROM sc JOIN p USING (log_id, weighting) GROUP BY 1, 2),
f2 AS (SELECT log_id, weighting, max(score) - any_value(own) AS regret_action, CASE WHEN max(score) = min(score) THEN 1 ELSE (any_value(own) - min(score)) / (max(score) - min(score)) END AS accuracy_action, count(*) FILTER (WHERE score > own + 1e-12) + 1 AS rank_action, count(*) AS n_action_configs FROM a JOIN p USING (log_id, weighting) GROUP BY 1, 2)
SELECT log_id, weighting, own AS real_score, f1.* EXCLUDE (log_id, weighting), f2.* EXCLUDE (log_id, weighting) FROM p JOIN f1 USING (log_id, weighting) JOIN f2 USING (log_id, weighting)""", "real_score regret_full accuracy_full regret_action accuracy_action")
RANKS = """rt AS (SELECT log_id, algorithm, config_hash, rank() OVER (PARTITION BY log_id ORDER BY runtime_seconds) AS runtime_rank, """ + ", ".join(f"rank() OVER (PARTITION BY log_id ORDER BY {m} DESC) AS {m}_rank" for m in M) + """ FROM cr WHERE status = 'success' AND runtime_seconds IS NOT NULL),
rf AS (SELECT *, (runtime_rank + fitness_rank + precision_rank + generalization_rank + simplicity_rank) / 5 AS target_final_rank FROM rt)"""
_INTS = "* REPLACE (" + ", ".join(f"CAST({c} AS INT) AS {c}" for c in ("runtime_rank", *(f"{m}_rank" for m in M))) + ")"
register("V21_rank_target", lambda s, d: V.rank_target(runs(s, d)), "WITH " + COMP + ",\n" + RANKS + f"\nSELECT {_INTS} FROM rf", "target_final_rank")
register("V22_unique_best_label", lambda s, d: V.unique_best_label(V.rank_target(runs(s, d))), "WITH " + COMP + ",\n" + RANKS + """,
b AS (SELECT *, min(target_final_rank) OVER (PARTITION BY log_id) AS m FROM rf)
SELECT log_id, any_value(config_hash) AS label FROM b WHERE target_final_rank = m GROUP BY 1 HAVING count(*) = 1""")
_TR = f"fs AS (SELECT *, {FAM} AS family FROM sc)"
register("M10_best_train_config", lambda s, d: V.best_train_config(scores(s, d), V.leave_one_family_out(runs(s, d))), BASE + ",\n" + _TR + """,
ev AS (SELECT weighting, config_hash, sum(score) AS s, count(*) AS n FROM fs GROUP BY 1, 2), ow AS (SELECT weighting, config_hash, family, sum(score) AS s2, count(*) AS n2 FROM fs GROUP BY 1, 2, 3),
tr AS (SELECT fs.log_id, fs.weighting, fs.config_hash, fs.score, CASE WHEN n > n2 THEN round((s - s2) / (n - n2), 9) END AS t FROM fs JOIN ev USING (weighting, config_hash) JOIN ow USING (weighting, config_hash, family)),
rk AS (SELECT *, row_number() OVER (PARTITION BY log_id, weighting ORDER BY t DESC NULLS LAST, config_hash DESC) AS r, avg(score) OVER (PARTITION BY log_id, weighting) AS mean FROM tr)
SELECT log_id, weighting, CASE WHEN t IS NOT NULL THEN score ELSE mean END AS score, 'best_train_config' AS method FROM rk WHERE r = 1""", "score")
_COLS = ["n_events", "n_cases", "spread"]


def nearest(s, d):
    f = small_features(s, d)
    return V.nearest_training_log(f, V.leave_one_family_out(f), _COLS)


_NEAR = FEATS + f""",
fa AS (SELECT log_id, {FAM} AS family FROM f), pr AS (SELECT a.log_id AS test_log, b.log_id AS train_log FROM fa a JOIN fa b ON a.family <> b.family),
l AS (""" + " UNION ALL ".join(f"SELECT log_id, '{c}' AS k, {c} AS v FROM f" for c in _COLS) + """),
bt AS (SELECT test_log, train_log, k, v, quantile_cont(v, 0.5) OVER (PARTITION BY test_log, k) AS med FROM pr JOIN l ON l.log_id = train_log),
fi AS (SELECT test_log, train_log, k, coalesce(v, med) AS v, med, stddev_pop(coalesce(v, med)) OVER (PARTITION BY test_log, k) AS sd FROM bt),
dd AS (SELECT test_log, train_log, round(sqrt(sum((CASE WHEN sd > 0 THEN (fi.v - coalesce(l.v, med)) / sd ELSE fi.v - coalesce(l.v, med) END) ** 2)), 9) AS distance FROM fi JOIN l ON l.log_id = test_log AND l.k = fi.k GROUP BY 1, 2),
ne AS (SELECT test_log, train_log AS nearest_log, distance FROM (SELECT *, row_number() OVER (PARTITION BY test_log ORDER BY distance, train_log) AS r FROM dd) WHERE r = 1)"""
register("M9_nearest_training_log", nearest, "WITH " + _NEAR + "\nSELECT * FROM ne", "distance")
register("M9_knn_transfer", lambda s, d: V.knn_transfer(scores(s, d).withColumn("log_id", F.regexp_replace("log_id", "__noise005__s1|t1[0-9]$", "")), nearest(s, d).select(F.regexp_replace("test_log", "__sub050__s1", "").alias("test_log"), F.regexp_replace("nearest_log", "__sub050__s1", "").alias("nearest_log"))))
register("V23_family_summary", lambda s, d: accuracies(s, d).withColumn("family", log_family(F.col("log_id"))).groupBy("family", "method").agg(F.avg("accuracy").alias("mean_accuracy"), F.percentile("accuracy", 0.5).alias("median_accuracy")), BASE + ",\n" + PICK + f"""
SELECT {FAM} AS family, method, avg(accuracy) AS mean_accuracy, quantile_cont(accuracy, 0.5) AS median_accuracy FROM ac GROUP BY 1, 2""", "mean_accuracy median_accuracy")
