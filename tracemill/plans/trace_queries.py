"""Queries over cases, traces, graphs and features (group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import dfg as G
from tracemill.operators import features as X
from tracemill.operators import traces as T
from tracemill.plans.base import register
from tracemill.sources.scratch import written
from tracemill.sources.views import event_log

TRACES = """WITH tr AS (SELECT log_id, case_id, count(*) AS n_events, list(activity ORDER BY ts NULLS LAST, event_index) FILTER (WHERE activity IS NOT NULL) AS t FROM event_log GROUP BY 1, 2),
k AS (SELECT log_id, array_to_string(t, ' > ') AS v, any_value(t) AS t, count(*) AS n FROM tr GROUP BY 1, 2)"""
DFG = """dfg AS (SELECT log_id, source, target, count(*) AS n FROM (SELECT log_id, activity AS source, lead(activity) OVER (PARTITION BY log_id, case_id ORDER BY event_index) AS target FROM event_log)
 WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3),
nodes AS (SELECT DISTINCT log_id, activity FROM event_log WHERE activity IS NOT NULL)"""
H = "greatest(log2(sum({0})) - sum({0} * log2({0})) / sum({0}), 0.0)"


def kinds(spark, sf):
    return T.distinct_variants(T.traces(event_log(spark, sf)))


def graph(spark, sf):
    log = event_log(spark, sf)
    return G.directly_follows(log), G.activities(log)


register("F1_case_features", lambda s, d: T.case_features(event_log(s, d)), """SELECT log_id, case_id, count(*) AS event_count,
 first(activity ORDER BY ts NULLS LAST, event_index) FILTER (WHERE activity IS NOT NULL) AS first_activity, last(activity ORDER BY ts NULLS LAST, event_index) FILTER (WHERE activity IS NOT NULL) AS last_activity,
 count(DISTINCT activity) AS unique_activities, min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS duration_hours FROM event_log GROUP BY 1, 2""", "duration_hours")
register("F2_variants", lambda s, d: T.variants(event_log(s, d)), TRACES + "\nSELECT log_id, case_id, array_to_string(t, ' > ') AS variant FROM tr")
register("F3_variant_counts", lambda s, d: T.variant_counts(kinds(s, d)), TRACES + """,
r AS (SELECT log_id, n, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, v) AS r, count(*) OVER (PARTITION BY log_id) AS c FROM k)
SELECT log_id, CAST(sum(n) AS BIGINT) AS n_traces, count(*) AS n_unique_traces, count(*) / sum(n) AS ratio_unique_traces_per_trace, max(n) / sum(n) AS ratio_most_common_variant,
""" + "".join(f" coalesce(sum(n) FILTER (WHERE r <= floor(c * {p} / 100)), 0) / sum(n) AS ratio_top_{p}_variants,\n" for p in (1, 5, 10, 20, 50, 75)) + f""" sum(n) FILTER (WHERE r <= 3) / sum(n) AS ratio_top_3_variants_custom, avg(n) AS mean_variant_occurrence, stddev_pop(n) AS std_variant_occurrence,
 {H.format('n')} AS trace_entropy FROM r GROUP BY 1""", "ratio_unique_traces_per_trace ratio_most_common_variant ratio_top_1_variants ratio_top_5_variants ratio_top_10_variants ratio_top_20_variants ratio_top_50_variants ratio_top_75_variants ratio_top_3_variants_custom mean_variant_occurrence std_variant_occurrence trace_entropy")
register("F4_log_stats", lambda s, d: T.log_stats(T.traces(event_log(s, d)), event_log(s, d)), TRACES + """,
a AS (SELECT log_id, count(DISTINCT activity) AS n_activities FROM event_log GROUP BY 1)
SELECT log_id, count(*) AS n_traces, CAST(sum(n_events) AS BIGINT) AS n_events, count(DISTINCT array_to_string(t, ' > ')) AS n_variants, avg(n_events) AS mean_trace_length, any_value(n_activities) AS n_activities FROM tr JOIN a USING (log_id) GROUP BY 1""", "mean_trace_length")
_QS = "min({0}) AS {1}_min, max({0}) AS {1}_max, avg({0}) AS {1}_mean, quantile_cont({0}, 0.5) AS {1}_median, stddev_pop({0}) AS {1}_std, var_pop({0}) AS {1}_variance, quantile_cont({0}, 0.25) AS {1}_q1, quantile_cont({0}, 0.75) AS {1}_q3, quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) AS {1}_iqr, quantile_cont({0}, 0.9) AS {1}_p90_custom"
_QD = " ".join(f"trace_len_{x}" for x in "min max mean median std variance q1 q3 iqr p90_custom".split())
register("F5_trace_length_stats", lambda s, d: T.trace_length_stats(T.traces(event_log(s, d))), TRACES + f"\nSELECT log_id, {_QS.format('n_events', 'trace_len')} FROM tr GROUP BY 1", _QD)
register("F6_activity_stats", lambda s, d: T.activity_stats(event_log(s, d)), f"""WITH c AS (SELECT log_id, activity, count(*) AS n FROM event_log WHERE activity IS NOT NULL GROUP BY 1, 2), e AS (SELECT log_id, count(*) AS m FROM event_log GROUP BY 1)
SELECT log_id, count(*) AS n_unique_activities, max(n) AS activities_max, avg(n) AS activities_mean, stddev_pop(n) AS activities_std, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS activities_iqr,
 {H.format('n')} AS activity_entropy_custom, avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS rare_activity_ratio_custom, max(n) / any_value(m) AS most_common_activity_share_custom FROM c JOIN e USING (log_id) GROUP BY 1""", "activities_max activities_mean activities_std activities_iqr activity_entropy_custom rare_activity_ratio_custom most_common_activity_share_custom")
for _p, _c, _i in (("start", "first_activity", "t[1]"), ("end", "last_activity", "t[-1]")):
    register(f"F7_{_p}_stats", lambda s, d, p=_p, c=_c: T.end_point_stats(T.case_features(event_log(s, d)), c, p), TRACES + f""",
c AS (SELECT log_id, {_i} AS a, count(*) AS n FROM tr GROUP BY 1, 2), m AS (SELECT log_id, count(*) AS m FROM tr GROUP BY 1)
SELECT log_id, count(*) AS n_unique_{_p}_activities, max(n) AS {_p}_activities_max, avg(n) AS {_p}_activities_mean, stddev_pop(n) AS {_p}_activities_std, {H.format('n')} AS {_p}_event_entropy_custom,
 max(n) / any_value(m) AS most_common_{_p}_share_custom FROM c JOIN m USING (log_id) WHERE a IS NOT NULL GROUP BY 1""", f"{_p}_activities_max {_p}_activities_mean {_p}_activities_std {_p}_event_entropy_custom most_common_{_p}_share_custom")
register("F8_directly_follows", lambda s, d: graph(s, d)[0], "WITH " + DFG + "\nSELECT * FROM dfg")
register("F9_flow_features", lambda s, d: G.flow_features(*graph(s, d)), "WITH " + DFG + f""",
e AS (SELECT log_id, count(*) AS arcs, count(*) FILTER (WHERE source = target) AS loops, {H.format('n')} AS h, max(n) AS top, sum(n) AS total, count(*) FILTER (WHERE n <= 1) AS rare FROM dfg GROUP BY 1),
bi AS (SELECT x.log_id, count(*) AS b2 FROM dfg x JOIN dfg y ON x.log_id = y.log_id AND x.source = y.target AND x.target = y.source WHERE x.source < x.target GROUP BY 1),
a AS (SELECT log_id, count(*) AS a FROM nodes GROUP BY 1)
SELECT log_id, h AS rs4pd_flow_entropy, CASE WHEN arcs IS NOT NULL THEN CASE WHEN a > 1 THEN coalesce(b2, 0) / (a * (a - 1) / 2) ELSE 0 END END AS rs4pd_flow_concurrency_ratio, arcs / (a * a) AS rs4pd_flow_density,
 loops AS rs4pd_length_one_loops_count, h AS dfg_edge_entropy_custom, top / total AS top_dfg_edge_share_custom, rare / arcs AS rare_dfg_edge_ratio_custom, loops / a AS length_one_loops FROM a LEFT JOIN e USING (log_id) LEFT JOIN bi USING (log_id)""", "rs4pd_flow_entropy rs4pd_flow_concurrency_ratio rs4pd_flow_density dfg_edge_entropy_custom top_dfg_edge_share_custom rare_dfg_edge_ratio_custom length_one_loops")
DEG = """dg AS (SELECT log_id, activity, count(*) FILTER (WHERE side = 'o') AS o, count(*) FILTER (WHERE side = 'i') AS i FROM
 (SELECT log_id, activity, NULL AS side FROM nodes UNION ALL SELECT log_id, source, 'o' FROM dfg UNION ALL SELECT log_id, target, 'i' FROM dfg) GROUP BY 1, 2)"""
register("F10_graph_metrics", lambda s, d: G.graph_metrics(*graph(s, d)), "WITH " + DFG + ",\n" + DEG + f"""
SELECT log_id, count(*) AS number_of_nodes, CAST(sum(o) AS BIGINT) AS number_of_arcs, 2 * sum(o) / count(*) AS average_node_degree, max(o + i) AS maximum_node_degree, sum(o) / count(*) AS avg_in_degree_custom, sum(o) / count(*) AS avg_out_degree_custom,
 max(i) AS max_in_degree_custom, max(o) AS max_out_degree_custom, CASE WHEN count(*) > 1 THEN sum(o) / (count(*) * (count(*) - 1)) ELSE 0 END AS density, 1 - sum(o) / (count(*) * count(*)) AS structure,
 greatest(log2(sum(o + i)) - sum(CASE WHEN o + i > 0 THEN (o + i) * log2(o + i) ELSE 0 END) / sum(o + i), 0.0) AS dfg_entropy_variable_degree FROM dg GROUP BY 1""", "average_node_degree avg_in_degree_custom avg_out_degree_custom density structure dfg_entropy_variable_degree")
register("F11_weak_components", lambda s, d: G.weak_components(*graph(s, d)), "WITH " + "RECURSIVE " + DFG + """,
u AS (SELECT log_id, source AS x, target AS y FROM dfg UNION SELECT log_id, target, source FROM dfg),
r AS (SELECT log_id, activity AS x, activity AS y FROM nodes UNION SELECT r.log_id, r.x, u.y FROM r JOIN u ON u.log_id = r.log_id AND u.x = r.y)
SELECT log_id, count(DISTINCT m) AS weakly_connected_components_custom FROM (SELECT log_id, x, min(y) AS m FROM r GROUP BY 1, 2) GROUP BY 1""")
REP = """w AS (SELECT log_id, n, len(t) AS l, len(list_distinct(t)) AS u, 1 + len(list_filter(range(2, len(t) + 1), lambda i: t[i] <> t[i - 1])) AS runs,
 len(list_filter(range(1, len(t) - 1), lambda i: t[i] = t[i + 2] AND t[i] <> t[i + 1])) AS two FROM k)"""
register("F12_repetition", lambda s, d: T.repetition(kinds(s, d)), TRACES + ",\n" + REP + """
SELECT log_id, sum(n * (l - u)) / sum(n) AS avg_event_repetition_intra_trace, sum(CASE WHEN runs > u THEN n ELSE 0 END) / sum(n) AS relative_number_of_traces_with_repetition FROM w GROUP BY 1""", "avg_event_repetition_intra_trace relative_number_of_traces_with_repetition")
register("F13_length_two_loops", lambda s, d: T.length_two_loops(kinds(s, d)), TRACES + ",\n" + REP + "\nSELECT log_id, CAST(sum(n * two) AS BIGINT) AS length_two_loops_custom FROM w GROUP BY 1")
PRE = """pf AS (SELECT log_id, array_to_string(t[1:i], ' > ') AS p, count(*) AS n FROM (SELECT log_id, t, unnest(range(1, len(t) + 1)) AS i FROM k) GROUP BY 1, 2)"""
register("F14_prefix_entropy", lambda s, d: T.prefix_entropy(kinds(s, d)), TRACES + ",\n" + PRE + f"\nSELECT log_id, {H.format('n')} AS prefix_entropy FROM pf GROUP BY 1", "prefix_entropy")
for _k in (2, 3):
    register(f"F14_prefix_entropy_{_k}", lambda s, d, k=_k: T.prefix_entropy_k(kinds(s, d), k), TRACES + f""",
pk AS (SELECT log_id, array_to_string(t[1:{_k}], ' > ') AS p, sum(n) AS n FROM k WHERE len(t) >= {_k} GROUP BY 1, 2)
SELECT log_id, {H.format('n')} AS prefix_entropy_{_k}_custom FROM pk GROUP BY 1""", f"prefix_entropy_{_k}_custom")
register("F15_activity_entropy", lambda s, d: event_log(s, d).groupBy("log_id", "activity").agg(F.count("*").alias("n")).groupBy("log_id").agg(T.entropy("n").alias("entropy")), f"""WITH c AS (SELECT log_id, activity, count(*) AS n FROM event_log GROUP BY 1, 2)
SELECT log_id, {H.format('n')} AS entropy FROM c GROUP BY 1""", "entropy")
F16 = TRACES + ",\n" + DFG + ",\n" + DEG + ",\n" + REP + ",\n" + PRE + f""",
v AS (SELECT log_id, n, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, v) AS r, count(*) OVER (PARTITION BY log_id) AS c FROM k),
f1 AS (SELECT log_id, count(*) AS rs4pd_distinct_traces, count(*) / sum(n) AS ratio_unique_traces_per_trace, max(n) / sum(n) AS ratio_most_common_variant, coalesce(sum(n) FILTER (WHERE r <= floor(c * 1 / 100)), 0) / sum(n) AS ratio_top_1_variants,
 coalesce(sum(n) FILTER (WHERE r <= floor(c * 5 / 100)), 0) / sum(n) AS ratio_top_5_variants, coalesce(sum(n) FILTER (WHERE r <= floor(c * 10 / 100)), 0) / sum(n) AS ratio_top_10_variants, sum(n) FILTER (WHERE r <= 3) / sum(n) AS ratio_top_3_variants_custom, {H.format('n')} AS trace_entropy FROM v GROUP BY 1),
f2 AS (SELECT log_id, count(*) AS rs4pd_total_traces, sum(n_events) AS rs4pd_total_events, avg(n_events) AS rs4pd_trace_length_avg, {_QS.format('n_events', 'trace_len')} FROM tr GROUP BY 1),
ac AS (SELECT log_id, activity, count(*) AS n FROM event_log WHERE activity IS NOT NULL GROUP BY 1, 2),
f3 AS (SELECT log_id, count(*) AS rs4pd_distinct_events, {H.format('n')} AS activity_entropy_custom, avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS rare_activity_ratio_custom, max(n) AS amax FROM ac GROUP BY 1),
sc AS (SELECT log_id, t[1] AS a, count(*) AS n FROM tr GROUP BY 1, 2), ec AS (SELECT log_id, t[-1] AS a, count(*) AS n FROM tr GROUP BY 1, 2),
f4 AS (SELECT log_id, count(*) AS rs4pd_start_events, max(n) AS start_activities_max, {H.format('n')} AS start_event_entropy_custom FROM sc WHERE a IS NOT NULL GROUP BY 1),
f5 AS (SELECT log_id, count(*) AS rs4pd_end_events, max(n) AS end_activities_max, {H.format('n')} AS end_event_entropy_custom FROM ec WHERE a IS NOT NULL GROUP BY 1),
f6 AS (SELECT log_id, count(*) AS number_of_arcs, count(*) FILTER (WHERE source = target) AS loops, {H.format('n')} AS dfg_edge_entropy_custom, max(n) / sum(n) AS top_dfg_edge_share_custom FROM dfg GROUP BY 1),
bi AS (SELECT x.log_id, count(*) AS b2 FROM dfg x JOIN dfg y ON x.log_id = y.log_id AND x.source = y.target AND x.target = y.source WHERE x.source < x.target GROUP BY 1),
f7 AS (SELECT log_id, max(o + i) AS maximum_node_degree, greatest(log2(sum(o + i)) - sum(CASE WHEN o + i > 0 THEN (o + i) * log2(o + i) ELSE 0 END) / sum(o + i), 0.0) AS dfg_entropy_variable_degree FROM dg GROUP BY 1),
f8 AS (SELECT log_id, sum(n * (l - u)) / sum(n) AS avg_event_repetition_intra_trace, sum(CASE WHEN runs > u THEN n ELSE 0 END) / sum(n) AS relative_number_of_traces_with_repetition, sum(n * two) AS length_two_loops_custom FROM w GROUP BY 1),
f9 AS (SELECT log_id, {H.format('n')} AS prefix_entropy FROM pf GROUP BY 1),
p2 AS (SELECT log_id, array_to_string(t[1:2], ' > ') AS p, sum(n) AS n FROM k WHERE len(t) >= 2 GROUP BY 1, 2), p3 AS (SELECT log_id, array_to_string(t[1:3], ' > ') AS p, sum(n) AS n FROM k WHERE len(t) >= 3 GROUP BY 1, 2),
f10 AS (SELECT log_id, {H.format('n')} AS prefix_entropy_2_custom FROM p2 GROUP BY 1), f11 AS (SELECT log_id, {H.format('n')} AS prefix_entropy_3_custom FROM p3 GROUP BY 1),
wide AS (SELECT *, rs4pd_distinct_events AS a FROM f2 JOIN f1 USING (log_id) LEFT JOIN f3 USING (log_id) LEFT JOIN f4 USING (log_id) LEFT JOIN f5 USING (log_id) LEFT JOIN f6 USING (log_id) LEFT JOIN bi USING (log_id) LEFT JOIN f7 USING (log_id) LEFT JOIN f8 USING (log_id) LEFT JOIN f9 USING (log_id) LEFT JOIN f10 USING (log_id) LEFT JOIN f11 USING (log_id)),
full_row AS (SELECT * REPLACE (coalesce(number_of_arcs, 0) AS number_of_arcs), avg_event_repetition_intra_trace AS rs4pd_repetitions_intra_trace_avg, dfg_edge_entropy_custom AS rs4pd_flow_entropy,
 coalesce(b2, 0) / (a * (a - 1) / 2) AS rs4pd_flow_concurrency_ratio, number_of_arcs / (a * a) AS rs4pd_flow_density, loops AS rs4pd_length_one_loops_count, start_activities_max / rs4pd_total_traces AS most_common_start_share_custom,
 end_activities_max / rs4pd_total_traces AS most_common_end_share_custom, amax / rs4pd_total_events AS most_common_activity_share_custom, 2 * number_of_arcs / a AS average_node_degree, number_of_arcs / (a * (a - 1)) AS density, loops / a AS length_one_loops FROM wide)
SELECT log_id, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in X.FEATURE_NAMES) + " FROM full_row"
register("F16_log_features", lambda s, d: X.log_features(event_log(s, d)), F16, " ".join(X.FEATURE_NAMES))
register("F17_six_axes", lambda s, d: X.six_axes(event_log(s, d)), TRACES + """,
ar AS (SELECT log_id, count(*) AS arcs FROM (SELECT DISTINCT log_id, t[i] AS s, t[i + 1] AS g FROM (SELECT log_id, t, unnest(range(1, len(t))) AS i FROM k)) GROUP BY 1),
v AS (SELECT log_id, count(*) AS v, sum(n) AS m, sum(CASE WHEN len(t) > len(list_distinct(t)) THEN n ELSE 0 END) AS r FROM k GROUP BY 1),
l AS (SELECT log_id, avg(n_events) AS l FROM tr GROUP BY 1), a AS (SELECT log_id, count(DISTINCT activity) AS a FROM event_log GROUP BY 1)
SELECT log_id, CAST(m AS DOUBLE) AS num_traces, l AS avg_trace_length, CAST(a AS DOUBLE) AS num_activities, v / m AS variant_ratio, coalesce(arcs / (a * a), 0) AS dfg_density, r / m AS repetition_prevalence FROM v JOIN l USING (log_id) JOIN a USING (log_id) LEFT JOIN ar USING (log_id)""", "num_traces avg_trace_length num_activities variant_ratio dfg_density repetition_prevalence")
_DD = "min max mean median mode std variance q1 q3 iqr gmean hmean skewness kurtosis cv " + " ".join(f"hist_{b}" for b in range(10))
register("F18_distribution_features", lambda s, d: X.distribution_features(T.traces(event_log(s, d)), ["log_id"], "n_events"), TRACES + """,
q AS (SELECT log_id, CAST(n_events AS DOUBLE) AS x FROM tr), s AS (SELECT log_id, avg(x) AS m, min(x) AS lo, max(x) AS hi, count(*) AS c FROM q GROUP BY 1),
mo AS (SELECT log_id, arg_max(x, c * 100000 - x) AS mode FROM (SELECT log_id, x, count(*) AS c FROM q GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT log_id, x, m, lo, hi, c, CASE WHEN hi > lo THEN least(floor((x - lo) * 10 / (hi - lo)), 9) ELSE 0 END AS bin FROM q JOIN s USING (log_id)),
z AS (SELECT log_id, min(x) AS min, max(x) AS max, any_value(m) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, exp(avg(ln(x))) AS gmean, 1 / avg(1 / x) AS hmean, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4,
 """ + ", ".join(f"avg(CASE WHEN bin = {b} THEN 1.0 ELSE 0.0 END) AS hist_{b}" for b in range(10)) + """ FROM d GROUP BY 1)
SELECT log_id, min, max, mean, median, mode, sqrt(m2) AS std, m2 AS variance, q1, q3, q3 - q1 AS iqr, gmean, hmean, CASE WHEN m2 > 0 THEN m3 / (m2 * sqrt(m2)) END AS skewness, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurtosis, sqrt(m2) / mean AS cv, """ + ", ".join(f"hist_{b}" for b in range(10)) + " FROM z JOIN mo USING (log_id)", _DD)
register("F19_feature_cache", lambda s, d: X.feature_cache(event_log(s, d), written(X.log_features(event_log(s, d).where("log_id < 'log1'")))), F16, " ".join(X.FEATURE_NAMES))
