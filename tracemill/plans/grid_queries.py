"""Queries over experiment grids, results and discovery (groups E, W and S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import dfg as G
from tracemill.operators import discovery as W
from tracemill.operators import grid as E
from tracemill.operators import metadata as D
from tracemill.operators import sampling as P
from tracemill.operators.evaluate import MEASURES as M
from tracemill.plans.base import register
from tracemill.plans.trace_queries import DFG, TRACES, kinds
from tracemill.sources.views import event_log, runs

ANY = "(fitness IS NOT NULL OR precision IS NOT NULL OR generalization IS NOT NULL OR simplicity IS NOT NULL)"
ALL = "(fitness IS NOT NULL AND precision IS NOT NULL AND generalization IS NOT NULL AND simplicity IS NOT NULL)"
PARAMS = ["p1", "p2"]


def configs(s):
    g = E.expand_grid(s, {"p1": [0.1, 0.5, 0.9], "kind": [0, 1]}, [("kind", 1.0, {"p2": [1, 2]})])
    return g.withColumn("algorithm", F.concat(F.lit("alg"), F.col("kind").cast("int").cast("string")))


CFG = """cf AS (SELECT p1, kind, p2, concat('alg', CAST(CAST(kind AS INT) AS VARCHAR)) AS algorithm FROM (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS p1), (SELECT * FROM (VALUES (0e0, NULL), (1e0, 1e0), (1e0, 2e0)) t(kind, p2)))"""
HASH = "substr(sha256(concat_ws('|', algorithm, concat('p1=', coalesce(printf('%.6f', p1), '_')), concat('p2=', coalesce(printf('%.6f', p2), '_')))), 1, 16)"
register("E1_expand_grid", lambda s, d: runs(s, d).select("log_id").distinct().crossJoin(configs(s)), "WITH " + CFG + "\nSELECT log_id, p1, kind, p2, algorithm FROM (SELECT DISTINCT log_id FROM runs), cf", "p1 kind p2")
register("E2_sample_lhs", lambda s, d: runs(s, d).select("log_id").distinct().crossJoin(E.sample_lhs(s, {"t": ("float", 0.001, 1.0, "log"), "k": ("int", 1, 9, "linear"), "mode": ("choice", ["x", "y", "z"])}, 60, 3)))
SPACE = {"noise": {"type": "float", "min": 0.0, "max": 1.0}, "mode": ["x", "y"]}
BRANCHES = [({"mode": "x"}, {"alpha": {"type": "float", "min": 0.001, "max": 1.0, "scale": "log"}, "k": [1, 2, 3, 4]}), ({"mode": "y"}, {"beta": {"type": "float", "min": 0.0, "max": 3.0}}), ({"mode": "x", "k": 3}, {"gamma": {"type": "float", "min": 0.0, "max": 1.0}})]


def branched(s, d):
    return P.conditional_lhs(runs(s, d).select("log_id"), SPACE, BRANCHES, n=40, seed=7)


register("E2_conditional_lhs", branched)
register("E2_conditional_strata", lambda s, d: P.strata(branched(s, d), ["log_id"], SPACE, BRANCHES), """WITH st AS (SELECT * FROM (SELECT 0 AS branch, 'noise' AS parameter, unnest(range(40)) AS stratum, 1 AS n) UNION ALL SELECT 0, 'mode', unnest(range(2)), 20
 UNION ALL SELECT 1, 'alpha', unnest(range(20)), 1 UNION ALL SELECT 1, 'k', unnest(range(4)), 5 UNION ALL SELECT 2, 'beta', unnest(range(20)), 1 UNION ALL SELECT 3, 'gamma', unnest(range(5)), 1)
SELECT log_id, branch, parameter, stratum, n FROM (SELECT DISTINCT log_id FROM runs), st""")
register("E3_build_manifest", lambda s, d: E.build_manifest(runs(s, d), configs(s), PARAMS).select("log_id", "algorithm", "config_hash", "row_id"), "WITH " + CFG + f""",
h AS (SELECT algorithm, {HASH} AS config_hash FROM cf)
SELECT log_id, algorithm, config_hash, substr(sha256(concat_ws('|', log_id, config_hash)), 1, 16) AS row_id FROM (SELECT DISTINCT log_id FROM runs), h""")


def spec(s):
    return s.createDataFrame([("alg1", "p1", "float", 0.0, 0.5), ("alg2", "p1", "float", 0.0, 1.0), ("alg2", "p2", "int", 0.0, 3.0), ("alg3", "p2", "int", 0.0, 4.0)], "algorithm string, parameter string, kind string, low double, high double")


register("E4_validate_params", lambda s, d: E.validate_params(runs(s, d), spec(s), PARAMS), """WITH sp AS (SELECT * FROM (VALUES ('alg1', 'p1', 'float', 0e0, 0.5e0), ('alg2', 'p1', 'float', 0e0, 1e0), ('alg2', 'p2', 'int', 0e0, 3e0), ('alg3', 'p2', 'int', 0e0, 4e0)) t(algorithm, parameter, kind, low, high)),
l AS (SELECT config_hash, algorithm, 'p1' AS parameter, p1 AS value FROM runs WHERE p1 IS NOT NULL UNION ALL SELECT config_hash, algorithm, 'p2', p2 FROM runs WHERE p2 IS NOT NULL),
r AS (SELECT config_hash, parameter, value, CASE WHEN kind IS NULL THEN 'unknown' WHEN value < low OR value > high THEN 'out_of_range' WHEN kind = 'int' AND value <> floor(value) THEN 'not_an_integer' END AS rule FROM l LEFT JOIN sp USING (algorithm, parameter))
SELECT * FROM r WHERE rule IS NOT NULL""", "value")
register("E5_metric_manifest", lambda s, d: E.metric_manifest(runs(s, d).select("log_id", "config_hash")), "SELECT log_id, config_hash, 'metrics' AS job, concat_ws('/', 'models', log_id, concat(config_hash, '.pnml')) AS model_path FROM runs")


def nested(s, d):
    """Runs as nested results, as JSON files hold them."""
    r = runs(s, d)
    metric = F.map_from_arrays(F.array(*map(F.lit, M)), F.array(*M))
    state = F.map_from_arrays(F.array(*map(F.lit, M)), F.array(*(F.struct(F.when(F.col(m).isNull(), "missing").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error")) for m in M)))
    return r.select("experiment_id", "log_id", "config_hash", "status", F.col("algorithm").alias("algorithm_name"), "runtime_seconds", metric.alias("metrics"), state.alias("metric_statuses"), F.map_from_arrays(F.array(F.lit("p1"), F.lit("p2")), F.array("p1", "p2")).alias("hyperparameters"), F.struct(F.lit("2026-01-01T00:00:00Z").alias("timestamp_utc")).alias("metadata"))


register("E6_flatten_results", lambda s, d: E.flatten_results(nested(s, d), list(M), PARAMS), "SELECT experiment_id, log_id, status, algorithm AS algorithm_name, runtime_seconds, " + ", ".join(f"{m} AS metric_{m}, CASE WHEN {m} IS NULL THEN 'missing' ELSE 'success' END AS metric_status_{m}" for m in M) + ", p1 AS param_p1, p2 AS param_p2, '2026-01-01T00:00:00Z' AS metadata_timestamp_utc FROM runs", "runtime_seconds param_p1 param_p2 " + " ".join(f"metric_{m}" for m in M))


def described(s, d):
    """Runs with metadata as open JSON: objects at several depths, arrays, nulls and a text that is none."""
    r = runs(s, d).select("log_id", "config_hash", "algorithm", "status", "runtime_seconds", "p1")
    timings = F.struct(F.struct(F.col("runtime_seconds").alias("wall"), F.struct(F.col("config_hash").alias("who"), F.col("p1").alias("deep")).alias("inner")).alias("total"), F.array(F.lit(1), F.lit(2)).alias("steps"))
    meta = F.to_json(F.struct(timings.alias("timings"), F.struct((F.col("status") == "success").alias("fine")).alias("slurm"), F.lit("x").alias("other")), {"ignoreNullFields": "false"})
    source = F.when(F.col("algorithm") == "alg3", F.lit("no JSON")).otherwise(F.concat(F.lit('{"l1": {"l2": {"l3": {"l4": {"of": "'), "log_id", F.lit('"}}}}, "empty": {}}')))
    return r.select("log_id", "config_hash", meta.alias("metadata"), source.alias("source_metadata"))


register("E6_recursive_metadata", lambda s, d: D.flatten_metadata(described(s, d), ["log_id", "config_hash"]), """SELECT log_id, config_hash, 'timing_total_wall' AS path, CASE WHEN runtime_seconds = floor(runtime_seconds) THEN CAST(CAST(runtime_seconds AS BIGINT) AS VARCHAR) ELSE CAST(runtime_seconds AS VARCHAR) END AS value, 'number' AS kind FROM runs
UNION ALL SELECT log_id, config_hash, 'timing_total_inner_who', config_hash, 'string' FROM runs UNION ALL SELECT log_id, config_hash, 'timing_total_inner_deep', CAST(p1 AS VARCHAR), CASE WHEN p1 IS NULL THEN 'null' ELSE 'number' END FROM runs
UNION ALL SELECT log_id, config_hash, 'slurm_fine', CAST(status = 'success' AS VARCHAR), 'boolean' FROM runs UNION ALL SELECT log_id, config_hash, 'source_l1_l2_l3_l4_of', log_id, 'string' FROM runs WHERE algorithm <> 'alg3'""".replace("\nUNION", " UNION"))


def doubled(s, d):
    """Runs with a second, later result of some configurations and some hashes missing."""
    r = runs(s, d).select("log_id", "algorithm", "config_hash", "status", *M)
    first = r.withColumn("source", F.concat(F.lit("a/"), "log_id", F.lit("/"), "config_hash"))
    again = r.where("algorithm = 'alg1'").withColumn("fitness", F.lit(0.5)).withColumn("status", F.lit("success")).withColumn("source", F.concat(F.lit("b/"), "log_id", F.lit("/"), "config_hash"))
    out = first.unionByName(again)
    return out.withColumn("config_hash", F.when((F.col("algorithm") == "alg2") & F.col("source").startswith("a/log1/"), None).otherwise(F.col("config_hash")))


TWICE = """u AS (SELECT log_id, algorithm, config_hash, status, fitness, precision, generalization, simplicity, concat('a/', log_id, '/', config_hash) AS source FROM runs
 UNION ALL SELECT log_id, algorithm, config_hash, 'success', 0.5, precision, generalization, simplicity, concat('b/', log_id, '/', config_hash) FROM runs WHERE algorithm = 'alg1'),
v AS (SELECT * REPLACE (CASE WHEN algorithm = 'alg2' AND starts_with(source, 'a/log1/') THEN NULL ELSE config_hash END AS config_hash) FROM u)"""
AGG = TWICE + f""",
g0 AS (SELECT * FROM v WHERE status = 'success' AND {ANY}), b0 AS (SELECT * FROM v WHERE NOT (status = 'success' AND {ANY})),
g AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY log_id, config_hash ORDER BY source) AS r FROM g0) WHERE r = 1 OR config_hash IS NULL),
b AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY log_id, config_hash ORDER BY source) AS r FROM b0) WHERE r = 1 OR config_hash IS NULL),
dn AS (SELECT DISTINCT log_id FROM g WHERE {ALL}),
z AS (SELECT * FROM b WHERE log_id IN (SELECT log_id FROM dn) AND NOT EXISTS (SELECT 1 FROM g WHERE g.log_id = b.log_id AND g.config_hash = b.config_hash))"""
register("E7_aggregate_runs", lambda s, d: E.aggregate_runs(doubled(s, d)), "WITH " + AGG + "\nSELECT *, false AS failed FROM g UNION ALL SELECT log_id, algorithm, config_hash, status, 0.0, 0.0, 0.0, 0.0, source, true FROM z", " ".join(M))
register("E7_skip_reasons", lambda s, d: E.skip_reasons(runs(s, d)), f"SELECT CASE WHEN status <> 'success' THEN concat('status_', status) WHEN NOT {ANY} THEN 'no_measure' WHEN NOT {ALL} THEN 'partial' ELSE 'complete' END AS reason, count(*) AS n FROM runs GROUP BY 1")


def sparse(s, d):
    return runs(s, d).where("algorithm <> 'alg3'").select("log_id", "config_hash", "status", *M)


register("E8_attach_metrics", lambda s, d: E.attach_metrics(runs(s, d).select("log_id", "config_hash"), sparse(s, d)), "SELECT log_id, config_hash, CASE WHEN algorithm <> 'alg3' THEN status ELSE 'success_missing' END AS status, " + ", ".join(f"CASE WHEN algorithm <> 'alg3' AND status = 'success' THEN coalesce({m}, 0) ELSE 0 END AS {m}" for m in M) + ", CASE WHEN algorithm <> 'alg3' AND status = 'success' THEN 'success' ELSE 'missing_model' END AS metric_status FROM runs", " ".join(M))
register("E9_pending_runs", lambda s, d: E.pending_runs(runs(s, d).select("log_id", "config_hash"), E.attach_metrics(runs(s, d).where("algorithm <> 'alg0'").select("log_id", "config_hash"), sparse(s, d)), runs(s, d).where("algorithm in ('alg2', 'alg3')")), "SELECT log_id, config_hash FROM runs WHERE algorithm = 'alg0' OR algorithm = 'alg3' OR (algorithm = 'alg2' AND status <> 'success')")
register("E10_best_config_per_pair", lambda s, d: E.best_config_per_pair(runs(s, d)), f"""WITH x AS (SELECT log_id, algorithm, config_hash, round((fitness + precision + generalization + simplicity) / 4, 9) AS score, runtime_seconds FROM runs WHERE status = 'success' AND {ALL})
SELECT log_id, algorithm, config_hash, score, runtime_seconds FROM (SELECT *, row_number() OVER (PARTITION BY log_id, algorithm ORDER BY score DESC, runtime_seconds, config_hash) AS r FROM x) WHERE r = 1""", "score runtime_seconds")
OBJ = "ob AS (SELECT *, CASE WHEN status = 'success' AND fitness IS NOT NULL AND precision IS NOT NULL THEN (fitness * 0.7e0 + precision * 0.3e0) / 1.0 ELSE 0 END AS objective FROM runs)"
WEIGHTS = {"fitness": 0.7, "precision": 0.3, "simplicity": 0.0}
register("E11_objective", lambda s, d: E.objective(runs(s, d), WEIGHTS).select("log_id", "config_hash", "objective"), "WITH " + OBJ + "\nSELECT log_id, config_hash, objective FROM ob", "objective")
register("E12_study_summary", lambda s, d: E.study_summary(E.objective(runs(s, d), WEIGHTS)), "WITH " + OBJ + """,
k AS (SELECT log_id, algorithm, config_hash FROM (SELECT *, row_number() OVER (PARTITION BY log_id, algorithm ORDER BY round(objective, 9) DESC, config_hash DESC) AS r FROM ob) WHERE r = 1)
SELECT log_id, algorithm, count(*) AS n_trials, count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status <> 'success') AS n_failed, any_value(k.config_hash) AS best_config, max(objective) AS best_objective, sum(runtime_seconds) AS runtime_seconds FROM ob JOIN k USING (log_id, algorithm) GROUP BY 1, 2""", "best_objective runtime_seconds")
register("E13_consistent_trials", lambda s, d: E.consistent_trials(runs(s, d).withColumn("stated_hash", F.when(F.col("status") == "failed", "x").otherwise(E.config_hash(PARAMS))), PARAMS), f"SELECT log_id, CASE WHEN status = 'failed' THEN 'x' ELSE {HASH} END AS stated_hash, status <> 'failed' AS ok FROM runs")


def inventories(s, d):
    r = runs(s, d).select("log_id", F.when(F.col("status") == "success", "accepted").otherwise("rejected").alias("status"), (F.col("algorithm") == "alg3").alias("stress"))
    return [r.where("log_id like 'log%'"), r.where("log_id like 'aug%'"), r]


register("E14_accepted_log_refs", lambda s, d: E.accepted_log_refs(inventories(s, d), stress=False), "SELECT DISTINCT log_id FROM runs WHERE status = 'success' AND algorithm <> 'alg3'")
register("E15_run_status_summary", lambda s, d: E.run_status_summary(runs(s, d)), "SELECT coalesce(algorithm, 'TOTAL') AS algorithm, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'timeout') AS timeout, count(*) AS total FROM runs GROUP BY ROLLUP (algorithm)")
register("S9_manifest_upsert", lambda s, d: E.manifest_upsert(runs(s, d).where("algorithm in ('alg0', 'alg1')").select("log_id", "config_hash", "status"), runs(s, d).where("algorithm in ('alg1', 'alg2')").select("log_id", "config_hash", F.when(F.col("status") == "success", "skipped_existing").otherwise("new").alias("status")), ["log_id", "config_hash"]), """WITH o AS (SELECT log_id, config_hash, status FROM runs WHERE algorithm IN ('alg0', 'alg1')), n AS (SELECT log_id, config_hash, CASE WHEN status = 'success' THEN 'skipped_existing' ELSE 'new' END AS status FROM runs WHERE algorithm IN ('alg1', 'alg2')),
i AS (SELECT * FROM n WHERE status = 'new' OR (log_id, config_hash) NOT IN (SELECT (log_id, config_hash) FROM o))
SELECT * FROM o WHERE (log_id, config_hash) NOT IN (SELECT (log_id, config_hash) FROM i) UNION ALL SELECT * FROM i""")

NO = "no AS (SELECT * FROM (VALUES ('n00', 0.0e0), ('n50', 0.5e0), ('n90', 0.9e0)) t(config_hash, noise)), kp AS (SELECT config_hash, log_id, source, target, n FROM (SELECT *, max(n) OVER (PARTITION BY log_id, source) AS top FROM dfg), no WHERE n >= top * noise)"


def noises(s):
    return s.createDataFrame([("n00", 0.0), ("n50", 0.5), ("n90", 0.9)], "config_hash string, noise double")


def graph(s, d):
    return G.directly_follows(event_log(s, d))


register("W1_footprint", lambda s, d: W.footprint(graph(s, d), G.activities(event_log(s, d))), "WITH " + DFG + """
SELECT a.log_id, a.activity AS source, b.activity AS target, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN '||' WHEN x.n IS NOT NULL THEN '->' WHEN y.n IS NOT NULL THEN '<-' ELSE '#' END AS relation
FROM nodes a JOIN nodes b USING (log_id) LEFT JOIN dfg x ON x.log_id = a.log_id AND x.source = a.activity AND x.target = b.activity LEFT JOIN dfg y ON y.log_id = a.log_id AND y.source = b.activity AND y.target = a.activity""".replace("\nFROM", " FROM"))
register("W2_dependency_graph", lambda s, d: W.dependency_graph(graph(s, d), 0.05, 5), "WITH " + DFG + """,
j AS (SELECT x.*, coalesce(y.n, 0) AS back FROM dfg x LEFT JOIN dfg y ON y.log_id = x.log_id AND y.source = x.target AND y.target = x.source), k2 AS (SELECT log_id, source, target, n, CASE WHEN source = target THEN n / (n + 1) ELSE (n - back) / (n + back + 1) END AS dependency FROM j)
SELECT * FROM k2 WHERE dependency >= 0.05 AND n >= 5""", "dependency")
register("W2_length_two_dependency", lambda s, d: W.length_two_dependency(kinds(s, d)), TRACES + """,
h AS (SELECT log_id, t[i] AS a, t[i + 1] AS b, sum(n) AS n FROM (SELECT log_id, t, n, unnest(range(1, len(t) - 1)) AS i FROM k) WHERE t[i] = t[i + 2] AND t[i] <> t[i + 1] GROUP BY 1, 2, 3),
u AS (SELECT log_id, a, b, sum(n) AS n FROM (SELECT * FROM h UNION ALL SELECT log_id, b, a, n FROM h) GROUP BY 1, 2, 3)
SELECT log_id, a, b, n / (n + 1) AS measure FROM u""", "measure")
register("W2_and_measure", lambda s, d: W.and_measure(graph(s, d), 0.05), "WITH " + DFG + """,
m AS (SELECT x.log_id, x.source, x.target AS b, y.target AS c, (coalesce(p.n, 0) + coalesce(q.n, 0)) / (x.n + y.n + 1) AS measure FROM dfg x JOIN dfg y ON x.log_id = y.log_id AND x.source = y.source AND x.target < y.target
 LEFT JOIN dfg p ON p.log_id = x.log_id AND p.source = x.target AND p.target = y.target LEFT JOIN dfg q ON q.log_id = x.log_id AND q.source = y.target AND q.target = x.target)
SELECT * FROM m WHERE measure >= 0.05""", "measure")
register("W3_filter_dfg", lambda s, d: W.filter_dfg(graph(s, d), 0.7), "WITH " + DFG + "\nSELECT log_id, source, target, n FROM (SELECT *, max(n) OVER (PARTITION BY log_id, source) AS top FROM dfg) WHERE n >= top * 0.7")
FIT = """ne AS (SELECT DISTINCT log_id, v, t[i] AS source, t[i + 1] AS target FROM (SELECT log_id, v, t, unnest(range(1, len(t))) AS i FROM k)), nd AS (SELECT log_id, v, count(*) AS need FROM ne GROUP BY 1, 2),
mt AS (SELECT config_hash, ne.log_id, v, count(*) AS met FROM ne JOIN kp USING (log_id, source, target) GROUP BY 1, 2, 3), gd AS (SELECT config_hash, mt.log_id, sum(n) AS good FROM mt JOIN nd USING (log_id, v) JOIN k USING (log_id, v) WHERE met = need GROUP BY 1, 2),
al AS (SELECT log_id, sum(n) AS traces, sum(CASE WHEN len(t) < 2 THEN n ELSE 0 END) AS short FROM k GROUP BY 1), pt AS (SELECT log_id, sum(n) AS pairs FROM dfg GROUP BY 1), pf1 AS (SELECT config_hash, log_id, sum(n) / any_value(pairs) AS pair_fitness FROM kp JOIN pt USING (log_id) GROUP BY 1, 2),
ft AS (SELECT config_hash, log_id, pair_fitness, (coalesce(good, 0) + short) / traces AS trace_fitness FROM pf1 JOIN al USING (log_id) LEFT JOIN gd USING (config_hash, log_id))"""
PRC = """ps AS (SELECT log_id, n, array_to_string(t[1:i], chr(31)) AS state, t[i] AS a, t[i + 1] AS nx FROM (SELECT log_id, t, n, unnest(range(1, len(t) + 1)) AS i FROM k)),
st AS (SELECT log_id, state, a, sum(n) AS n FROM ps GROUP BY 1, 2, 3), sn AS (SELECT DISTINCT log_id, state, nx FROM ps WHERE nx IS NOT NULL),
pe AS (SELECT config_hash, st.log_id, st.state, n2.n AS n, count(*) AS allowed, count(*) FILTER (WHERE sn.nx IS NULL) AS esc FROM st JOIN st n2 ON n2.log_id = st.log_id AND n2.state = st.state JOIN kp ON kp.log_id = st.log_id AND kp.source = st.a LEFT JOIN sn ON sn.log_id = st.log_id AND sn.state = st.state AND sn.nx = kp.target GROUP BY 1, 2, 3, 4),
pc AS (SELECT config_hash, log_id, 1 - sum(n * esc) / sum(n * allowed) AS precision FROM pe GROUP BY 1, 2)"""
GEN = "gn AS (SELECT config_hash, log_id, 1 - avg(1 / sqrt(n)) AS generalization FROM kp GROUP BY 1, 2)"
SIM = "sm AS (SELECT config_hash, log_id, 1 / (1 + greatest(avg(d) - 2, 0)) AS simplicity FROM (SELECT config_hash, log_id, a, count(*) AS d FROM (SELECT config_hash, log_id, source AS a FROM kp UNION ALL SELECT config_hash, log_id, target FROM kp) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_T = TRACES + ",\n" + DFG + ",\n" + NO
register("W4_dfg_fitness", lambda s, d: W.dfg_fitness(kinds(s, d), graph(s, d), W.sweep_filter(graph(s, d), noises(s))), _T + ",\n" + FIT + "\nSELECT * FROM ft", "pair_fitness trace_fitness")
register("W5_dfg_precision", lambda s, d: W.dfg_precision(kinds(s, d), W.sweep_filter(graph(s, d), noises(s))), _T + ",\n" + PRC + "\nSELECT * FROM pc", "precision")
register("W6_dfg_generalization", lambda s, d: W.dfg_generalization(W.sweep_filter(graph(s, d), noises(s))), _T + ",\n" + GEN + "\nSELECT * FROM gn", "generalization")
register("W6_dfg_simplicity", lambda s, d: W.dfg_simplicity(W.sweep_filter(graph(s, d), noises(s))), _T + ",\n" + SIM + "\nSELECT * FROM sm", "simplicity")
register("W7_sweep", lambda s, d: W.sweep(kinds(s, d), graph(s, d), noises(s)), _T + ",\n" + ",\n".join((FIT, PRC, GEN, SIM)) + "\nSELECT config_hash, log_id, trace_fitness AS fitness, pair_fitness, precision, generalization, simplicity, CASE WHEN precision IS NULL OR simplicity IS NULL THEN 'partial' ELSE 'success' END AS status FROM ft LEFT JOIN pc USING (config_hash, log_id) LEFT JOIN gn USING (config_hash, log_id) LEFT JOIN sm USING (config_hash, log_id)", "fitness pair_fitness precision generalization simplicity")
