"""Queries over event logs: cleaning (C), quality (Q) and augmentation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import augment as A
from tracemill.operators import clean as C
from tracemill.operators import dfg as G
from tracemill.operators import inspect as Q
from tracemill.operators import traces as T
from tracemill.plans.base import register
from tracemill.plans.trace_queries import DFG, TRACES
from tracemill.sources.views import event_log, lifecycle_log, runs

NULLED = "CASE WHEN activity = 'error' AND event_index % 3 = 0 THEN NULL ELSE activity END"


def holes(s, d):
    """The event log with null activities and texts for timestamps, of which some don't parse."""
    log = event_log(s, d)
    text = F.when(F.col("event_index") % 5 == 0, F.lit("n/a")).when(F.col("event_index") % 7 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return log.withColumn("activity", F.when((F.col("activity") == "error") & (F.col("event_index") % 3 == 0), None).otherwise(F.col("activity"))).withColumn("ts_text", text)


HOLES = f"""h AS (SELECT log_id, case_id, {NULLED} AS activity, ts, event_index, CASE WHEN event_index % 5 = 0 THEN 'n/a' WHEN event_index % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text FROM event_log)"""

register("C1_normalize_columns", lambda s, d: C.normalize_columns(event_log(s, d).withColumnsRenamed({"case_id": "case:concept:name", "activity": "concept:name", "ts": "time:timestamp"})), "SELECT log_id, case_id, activity, ts, event_index FROM event_log")
register("C2_canonicalize", lambda s, d: C.canonicalize(holes(s, d)), "WITH " + HOLES + "\nSELECT log_id, case_id, activity, ts, CAST(row_number() OVER (PARTITION BY log_id, case_id ORDER BY ts, event_index) AS INT) AS event_index FROM h WHERE activity IS NOT NULL AND ts IS NOT NULL")
register("C3_resolve_schema", lambda s, d: C.resolve_schema(holes(s, d).withColumnsRenamed({"case_id": "Case", "activity": "Task", "ts": "When"}), {"case_id": "Case", "activity": "Task", "ts": "When"}, keep=("event_index",)), "WITH " + HOLES + "\nSELECT case_id, activity, ts, event_index FROM h WHERE activity IS NOT NULL AND ts IS NOT NULL AND case_id IS NOT NULL")
register("C4_parse_timestamps", lambda s, d: holes(s, d).withColumn("p", C.parse_timestamps(F.col("ts_text"))).groupBy("log_id").agg(F.count("p").alias("parsed"), F.count_if(F.col("p").isNull() & F.col("ts_text").isNotNull()).alias("failures"), F.max("p").alias("latest")), "WITH " + HOLES + "\nSELECT log_id, count(try_cast(ts_text AS TIMESTAMP)) AS parsed, count(*) FILTER (WHERE ts_text IS NOT NULL AND try_cast(ts_text AS TIMESTAMP) IS NULL) AS failures, max(try_cast(ts_text AS TIMESTAMP)) AS latest FROM h GROUP BY 1")
register("C5_sanitize_text", lambda s, d: event_log(s, d).select("log_id", "case_id", "event_index", C.sanitize_text(F.concat(F.col("activity"), F.chr(F.col("event_index").cast("long") % 32), F.lit("x"))).alias("label")), "SELECT log_id, case_id, event_index, regexp_replace(concat(activity, CASE WHEN event_index % 32 = 0 THEN chr(1) ELSE chr(event_index % 32) END, 'x'), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '�', 'g') AS label FROM event_log")
register("C6_compact_labels", lambda s, d: C.compact_labels(event_log(s, d))[0].select("log_id", "case_id", "event_index", "activity"), "WITH m AS (SELECT log_id, activity, row_number() OVER (PARTITION BY log_id ORDER BY activity) AS r FROM (SELECT DISTINCT log_id, activity FROM event_log))\nSELECT log_id, case_id, event_index, concat('A', lpad(CAST(r AS VARCHAR), 4, '0')) AS activity FROM event_log JOIN m USING (log_id, activity)")
register("C6_label_mapping", lambda s, d: C.compact_labels(event_log(s, d))[1], "WITH m AS (SELECT log_id, activity, row_number() OVER (PARTITION BY log_id ORDER BY activity) AS r FROM (SELECT DISTINCT log_id, activity FROM event_log))\nSELECT log_id, activity, concat('A', lpad(CAST(r AS VARCHAR), 4, '0')) AS label FROM m")
register("C7_complete_projection", lambda s, d: C.complete_projection(lifecycle_log(s, d)), "SELECT * FROM lifecycle_log WHERE lifecycle = 'complete'")
register("C8_families", lambda s, d: runs(s, d).select("log_id").distinct().select("log_id", C.log_family(F.col("log_id")).alias("family"), C.log_population(F.col("log_id")).alias("population")), """SELECT DISTINCT log_id, CASE WHEN starts_with(log_id, 'aug_') THEN split_part(substr(log_id, 5), '__', 1) ELSE log_id END AS family,
 CASE WHEN starts_with(log_id, 'syn_gedi') THEN 'gedi' WHEN starts_with(log_id, 'aug_') THEN 'augmented' WHEN starts_with(log_id, 'syn_') THEN 'synth' ELSE 'real' END AS population FROM runs""")
register("C9_normalize_labels", lambda s, d: C.normalize_labels(runs(s, d).withColumn("algorithm", F.when(F.col("algorithm") == "alg1", "ilp_miner_classic").when(F.col("algorithm") == "alg2", "split_miner_v1").otherwise(F.col("algorithm")))).groupBy("algorithm").agg(F.count("*").alias("n")), "SELECT CASE algorithm WHEN 'alg1' THEN 'ilp_miner' WHEN 'alg2' THEN 'split_miner' ELSE algorithm END AS algorithm, count(*) AS n FROM runs GROUP BY 1")
register("C10_select_runs", lambda s, d: C.select_runs(runs(s, d), algorithms=["alg1", "alg3"], statuses=["success"]).select("log_id", "config_hash", "fitness"), "SELECT log_id, config_hash, fitness FROM runs WHERE algorithm IN ('alg1', 'alg3') AND status = 'success'", "fitness")
register("C11_regime", lambda s, d: C.regime(runs(s, d), "real_synthetic").where(F.col("algorithm").isin("alg0", "alg1")).select("log_id", "config_hash"), "SELECT log_id, config_hash FROM runs WHERE NOT starts_with(log_id, 'aug_') AND algorithm IN ('alg0', 'alg1')")

register("Q1_validity_report", lambda s, d: Q.validity_report(holes(s, d).withColumn("activity", F.when(F.col("event_index") == 2, F.concat(F.lit(" "), "activity")).otherwise(F.col("activity"))).withColumn("ts", C.parse_timestamps(F.col("ts_text")))), "WITH " + HOLES + """
SELECT log_id, count(*) AS n_rows, count(*) FILTER (WHERE case_id IS NULL) AS missing_case, count(*) FILTER (WHERE activity IS NULL) AS missing_activity, count(*) FILTER (WHERE ts_text IS NULL) AS missing_time, count(*) FILTER (WHERE ts_text = 'n/a') AS parse_failures,
 count(*) FILTER (WHERE event_index = 2 AND activity IS NOT NULL) AS suspicious_labels, count(*) FILTER (WHERE activity IS NULL) * 100 / count(*) AS missing_activity_percent FROM h GROUP BY 1""", "missing_activity_percent")
register("Q2_inspect_log", lambda s, d: Q.inspect_log(event_log(s, d), G.directly_follows(event_log(s, d)), T.traces(event_log(s, d))), TRACES + ",\n" + DFG + """,
st AS (SELECT *, lag(ts) OVER (PARTITION BY log_id, case_id ORDER BY event_index) AS b FROM event_log),
pc AS (SELECT log_id, case_id, count(*) AS n, count(*) FILTER (WHERE b = ts) AS same, max(CASE WHEN ts < b THEN 1 ELSE 0 END) AS back FROM st GROUP BY 1, 2),
c AS (SELECT log_id, CAST(sum(n) AS BIGINT) AS events, count(*) AS cases, CAST(sum(same) AS BIGINT) AS duplicate_timestamp_events, CAST(sum(back) AS BIGINT) AS non_monotonic_cases, count(*) FILTER (WHERE n = 1) AS single_event_cases, max(n) AS max_trace_length FROM pc GROUP BY 1),
a AS (SELECT log_id, count(DISTINCT activity) AS activities FROM event_log GROUP BY 1), v AS (SELECT log_id, count(*) AS variants FROM k GROUP BY 1), g AS (SELECT log_id, count(*) AS dfg_edges FROM dfg GROUP BY 1)
SELECT c.*, activities, variants, dfg_edges, activities > 500 AS large_vocabulary FROM c JOIN a USING (log_id) JOIN v USING (log_id) JOIN g USING (log_id)""")
PAIRS = """st AS (SELECT *, CASE lifecycle WHEN 'start' THEN 1 ELSE -1 END AS step FROM lifecycle_log),
b1 AS (SELECT *, sum(step) OVER w AS balance FROM st WINDOW w AS (PARTITION BY log_id, case_id, activity ORDER BY event_index)),
b2 AS (SELECT *, greatest(0, -min(balance) OVER (PARTITION BY log_id, case_id, activity ORDER BY event_index)) AS um FROM b1),
b3 AS (SELECT *, step = -1 AND um = coalesce(lag(um) OVER (PARTITION BY log_id, case_id, activity ORDER BY event_index), 0) AS matched FROM b2),
sx AS (SELECT *, row_number() OVER (PARTITION BY log_id, case_id, activity ORDER BY event_index) AS k FROM b3 WHERE step = 1),
cx AS (SELECT *, row_number() OVER (PARTITION BY log_id, case_id, activity ORDER BY event_index) AS k FROM b3 WHERE matched),
pr AS (SELECT sx.log_id, sx.case_id, sx.activity, k, sx.ts AS start_ts, sx.event_index AS start_index, cx.ts AS complete_ts, cx.event_index AS complete_index, (epoch_us(cx.ts) - epoch_us(sx.ts)) / 1e6 AS duration_seconds FROM sx JOIN cx USING (log_id, case_id, activity, k))"""
register("Q3_lifecycle_pairs", lambda s, d: Q.lifecycle_pairs(lifecycle_log(s, d)).withColumn("k", F.col("k").cast("long")), "WITH " + PAIRS + "\nSELECT * FROM pr", "duration_seconds")
register("Q4_interval_quality", lambda s, d: Q.interval_quality(lifecycle_log(s, d), Q.lifecycle_pairs(lifecycle_log(s, d))), "WITH " + PAIRS + """,
n AS (SELECT log_id, count(*) FILTER (WHERE lifecycle = 'start') AS starts, count(*) FILTER (WHERE lifecycle = 'complete') AS completes FROM lifecycle_log GROUP BY 1),
p AS (SELECT log_id, count(*) AS pairs, count(*) FILTER (WHERE duration_seconds < 0) AS negative, count(*) FILTER (WHERE duration_seconds = 0) AS zero FROM pr GROUP BY 1),
j AS (SELECT log_id, starts, completes, coalesce(pairs, 0) AS pairs, coalesce(negative, 0) AS negative, coalesce(zero, 0) AS zero, CASE WHEN starts + completes > 0 THEN 2 * coalesce(pairs, 0) / (starts + completes) END AS pair_ratio, CASE WHEN pairs > 0 THEN zero / pairs END AS zero_ratio FROM n LEFT JOIN p USING (log_id)),
r AS (SELECT *, concat_ws(',', CASE WHEN pair_ratio < 0.999 THEN 'low_pair_ratio' END, CASE WHEN negative > 0 THEN 'negative_durations' END, CASE WHEN zero_ratio > 0.01 THEN 'many_zero_durations' END) AS reasons FROM j)
SELECT *, CASE WHEN pairs = 0 OR negative > 0 THEN 'red' WHEN reasons <> '' THEN 'yellow' ELSE 'green' END AS quality FROM r""", "pair_ratio zero_ratio")
register("Q5_lifecycle_values", lambda s, d: Q.lifecycle_values(lifecycle_log(s, d).withColumn("lifecycle", F.when(F.col("event_index") % 9 != 0, F.upper("lifecycle")))), "SELECT log_id, CASE WHEN event_index % 9 <> 0 THEN lifecycle ELSE '<missing>' END AS value, count(*) AS n FROM lifecycle_log GROUP BY 1, 2")
register("Q6_log_summary", lambda s, d: Q.log_summary(event_log(s, d), T.traces(event_log(s, d))), TRACES + """,
a AS (SELECT log_id, count(*) AS events, count(DISTINCT activity) AS activities, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM event_log GROUP BY 1),
b2 AS (SELECT log_id, count(*) AS cases, round_even(avg(n_events), 3) AS events_per_case_mean, min(n_events) AS events_per_case_min, max(n_events) AS events_per_case_max, count(DISTINCT array_to_string(t, ' > ')) AS variants FROM tr GROUP BY 1)
SELECT * FROM a JOIN b2 USING (log_id)""", "events_per_case_mean")
STATS = """ls AS (SELECT log_id, count(*) AS n_traces, count(DISTINCT array_to_string(t, ' > ')) AS n_variants, avg(n_events) AS mean_trace_length FROM tr GROUP BY 1), la AS (SELECT log_id, count(DISTINCT activity) AS n_activities FROM event_log GROUP BY 1)"""
register("Q7_validate_child_logs", lambda s, d: Q.validate_child_logs(T.log_stats(T.traces(event_log(s, d)), event_log(s, d)).withColumn("n_traces", F.col("n_traces") % 13).withColumn("n_activities", F.col("n_activities") - 2)), TRACES + ",\n" + STATS + """,
x AS (SELECT log_id, n_traces % 13 AS t, n_activities - 2 AS a, n_variants AS v FROM ls JOIN la USING (log_id)),
y AS (SELECT log_id, CASE WHEN t < 10 THEN concat('too few traces: ', t, ' < 10') WHEN a < 3 THEN concat('too few activities: ', a, ' < 3') WHEN v < 2 THEN concat('too few variants: ', v, ' < 2') END AS reason FROM x)
SELECT log_id, reason IS NULL AS accepted, reason FROM y""")
def manifest(s, d):
    r = runs(s, d)
    path = F.when(F.col("algorithm") == "alg0", F.concat(F.lit("/home/x/"), "log_id")).otherwise(F.concat(F.lit("/data/"), "log_id"))
    return r.select(F.concat("log_id", F.lit("|"), "config_hash").alias("row_id"), F.when(F.col("status") == "failed", "").when(F.col("status") == "timeout", "name").otherwise("ok").alias("name"), path.alias("path"))


register("Q8_validate_manifest", lambda s, d: Q.validate_manifest(manifest(s, d), ("name",), ("path",), "/data/"), """WITH m AS (SELECT concat(log_id, '|', config_hash) AS row_id, CASE status WHEN 'failed' THEN '' WHEN 'timeout' THEN 'name' ELSE 'ok' END AS name, concat(CASE WHEN algorithm = 'alg0' THEN '/home/x/' ELSE '/data/' END, log_id) AS path FROM runs)
SELECT row_id, 'missing_name' AS rule, name AS value FROM m WHERE name = '' UNION SELECT row_id, 'header_row', name FROM m WHERE name = 'name' UNION SELECT row_id, 'path_outside_root', path FROM m WHERE starts_with(path, '/home')""")
register("Q9_verify_inventory", lambda s, d: Q.verify_inventory(event_log(s, d).select("log_id").distinct().select("log_id", C.log_population(F.col("log_id")).alias("kind"), F.lit("p").alias("path"), F.when(F.col("log_id") == "log1", "zz").otherwise(F.sha2("log_id", 256)).alias("sha256")), {"real": 3, "augmented": 4, "gedi": 2}), """WITH i AS (SELECT DISTINCT log_id FROM event_log)
SELECT 'row_count' AS rule, 'augmented' AS subject, concat(CAST(count(*) AS VARCHAR), ' of 4') AS value FROM i WHERE starts_with(log_id, 'aug_') UNION ALL SELECT 'malformed_hash', 'log1', 'zz'""")
register("Q10_receipts", lambda s, d: Q.receipts({"event_log": event_log(s, d).select("log_id", "case_id", "activity", "event_index")}), """WITH r AS (SELECT CAST(concat('0x', substr(md5(concat_ws(chr(31), log_id, case_id, activity, CAST(event_index AS VARCHAR))), 1, 15)) AS BIGINT) AS h FROM event_log)
SELECT 'event_log' AS name, count(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS digest FROM r""")
register("Q11_declared_vs_observed", lambda s, d: Q.declared_vs_observed(T.log_stats(T.traces(event_log(s, d)), event_log(s, d)).select("log_id", (F.col("n_traces") + (F.col("log_id") == "log0").cast("int")).alias("declared_traces"), F.col("n_events").alias("declared_events")), T.log_stats(T.traces(event_log(s, d)), event_log(s, d))), TRACES + """,
s AS (SELECT log_id, count(*) AS n_traces, CAST(sum(n_events) AS BIGINT) AS n_events FROM tr GROUP BY 1)
SELECT log_id, n_traces + CASE WHEN log_id = 'log0' THEN 1 ELSE 0 END AS declared_traces, n_traces, n_events AS declared_events, n_events, log_id <> 'log0' AS agrees FROM s""")

COVER = """o AS (SELECT log_id, v, n, sum(n) OVER (PARTITION BY log_id ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY log_id) AS total FROM (SELECT log_id, array_to_string(t, chr(31)) AS v, n FROM k))"""
register("G1_filter_variant_coverage", lambda s, d: A.filter_variant_coverage(event_log(s, d), 0.8), TRACES + ",\n" + COVER + """
SELECT e.* FROM event_log e JOIN tr USING (log_id, case_id) JOIN o ON o.log_id = tr.log_id AND o.v = array_to_string(t, chr(31)) WHERE before < total * 0.8""")
register("G2_subsample_quotas", lambda s, d: A.subsample_quotas(T.distinct_variants(T.traces(event_log(s, d))), 0.3), TRACES + """,
x AS (SELECT log_id, sha256(array_to_string(t, chr(31))) AS variant_hash, n, CAST(floor(n * 0.3e0) AS BIGINT) AS base, round(n * 0.3e0 - floor(n * 0.3e0), 9) AS rem FROM k),
y AS (SELECT *, greatest(CAST(round_even(sum(n) OVER (PARTITION BY log_id) * 0.3e0, 0) AS BIGINT), 1) - sum(base) OVER (PARTITION BY log_id) AS rest, row_number() OVER (PARTITION BY log_id ORDER BY rem DESC, n DESC, variant_hash) AS r FROM x)
SELECT log_id, variant_hash, n, base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS quota FROM y""")
register("G2_subsample_variants", lambda s, d: A.subsample_variants(event_log(s, d), 0.3, 1))
register("G3_inject_event_noise", lambda s, d: A.inject_event_noise(event_log(s, d), 0.05, 1))
register("G4_truncate_traces", lambda s, d: A.truncate_traces(event_log(s, d), 2), "SELECT log_id, case_id, activity, ts, event_index FROM (SELECT *, row_number() OVER (PARTITION BY log_id, case_id ORDER BY ts NULLS LAST, event_index) AS r FROM event_log) WHERE r <= 2")
register("G5_filter_top_activities", lambda s, d: A.filter_top_activities(event_log(s, d), 0.6), """WITH c AS (SELECT log_id, activity, count(*) AS n FROM event_log GROUP BY 1, 2),
o AS (SELECT *, sum(n) OVER (PARTITION BY log_id ORDER BY n DESC, activity ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY log_id) AS total FROM c)
SELECT e.* FROM event_log e JOIN o USING (log_id, activity) WHERE before < total * 0.6""")
register("G6_augmentation_plan", lambda s, d: A.augmentation_plan(T.log_stats(T.traces(event_log(s, d)), event_log(s, d)).withColumn("n_traces", F.col("n_traces") * 20), stress=True).select("parent", "operator", "parameter", "stress"), TRACES + """,
p AS (SELECT * FROM (VALUES ('variant_coverage', 0.8, false, 'a'), ('subsample', 0.5, false, 'a'), ('noise', 0.05, false, 'a'), ('subsample', 0.25, false, 'l'), ('variant_coverage', 0.5, true, 'a'), ('noise', 0.2, true, 'a'), ('top_activities', 0.8, true, 'a')) t(operator, parameter, stress, c)),
s AS (SELECT log_id, count(*) * 20 AS m FROM tr GROUP BY 1)
SELECT log_id AS parent, operator, parameter, stress FROM s, p WHERE c = 'a' OR m >= 10000""", "parameter")
register("G7_child_seeds", lambda s, d: A.augmentation_plan(T.log_stats(T.traces(event_log(s, d)), event_log(s, d))).select("log_id", "parent", "seed"), TRACES + """,
p AS (SELECT * FROM (VALUES ('variant_coverage', '0.8000', 'cov080', 'always'), ('subsample', '0.5000', 'sub050', 'always'), ('noise', '0.0500', 'noise005', 'always'), ('subsample', '0.2500', 'sub025', 'large'), ('truncate', '50.0000', 'trunc050', 'long')) t(operator, v, token, condition)),
s AS (SELECT log_id, count(*) AS n_traces, avg(n_events) AS mean_trace_length FROM tr GROUP BY 1),
x AS (SELECT log_id AS parent, token, CAST(concat('0x', substr(sha256(concat_ws('|', '1', log_id, operator, v)), 1, 8)) AS BIGINT) AS seed FROM s, p WHERE condition = 'always' OR (condition = 'large' AND n_traces >= 10000) OR (condition = 'long' AND mean_trace_length >= 40))
SELECT concat('aug_', parent, '__', token, '__s', seed) AS log_id, parent, seed FROM x""")
register("G8_augment_logs", lambda s, d: A.augment_logs(event_log(s, d))[1])
