"""Queries over the feature space (group D).

Points: one per customer, with axis values from the customer's orders and
account; real logs are the first of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import features as X
from tracemill.operators import space as D
from tracemill.operators.clean import log_population
from tracemill.plans.base import register
from tracemill.sources.views import event_log


def points(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    g = o.groupBy((F.col("o_custkey") % 600).cast("long").alias("point_id")).agg(F.sum(F.col("o_orderkey").cast("long")).alias("h"), F.count("*").alias("n"))
    h = F.col("h")
    return g.select(
        "point_id",
        F.when(F.col("point_id") % 10 == 0, "real").otherwise("generated").alias("population"),
        (h % 9000 + 5).cast("double").alias("num_traces"),
        ((h % 977).cast("double") / 20 + 1).alias("avg_trace_length"),
        (h % 131 + 2).cast("double").alias("num_activities"),
        ((h % 101).cast("double") / 100).alias("variant_ratio"),
        ((h % 89).cast("double") / 80).alias("dfg_density"),
        ((h % 97).cast("double") / 96).alias("repetition_prevalence"),
    )


POINTS = """g AS (SELECT CAST(o_custkey % 600 AS BIGINT) AS point_id, CAST(sum(o_orderkey) AS BIGINT) AS h FROM orders GROUP BY 1),
points AS (SELECT point_id, CASE WHEN point_id % 10 = 0 THEN 'real' ELSE 'generated' END AS population, CAST(h % 9000 + 5 AS DOUBLE) AS num_traces, CAST(h % 977 AS DOUBLE) / 20 + 1 AS avg_trace_length, CAST(h % 131 + 2 AS DOUBLE) AS num_activities,
 CAST(h % 101 AS DOUBLE) / 100 AS variant_ratio, CAST(h % 89 AS DOUBLE) / 80 AS dfg_density, CAST(h % 97 AS DOUBLE) / 96 AS repetition_prevalence FROM g),
tgt AS (SELECT point_id, population, log10(greatest(num_traces, 1e-9)) AS num_traces, log10(greatest(avg_trace_length, 1e-9)) AS avg_trace_length, log10(greatest(num_activities, 1e-9)) AS num_activities, least(greatest(variant_ratio, 0), 1) AS variant_ratio,
 least(greatest(dfg_density, 0), 1) AS dfg_density, least(greatest(repetition_prevalence, 0), 1) AS repetition_prevalence FROM points)"""
AX = " ".join(D.AXES)
ANCHOR = "an AS (SELECT " + ", ".join(f"avg({a}) AS mean_{a}, CASE WHEN stddev_pop({a}) < 1e-9 THEN 1 ELSE stddev_pop({a}) END AS std_{a}" for a in D.AXES) + " FROM tgt WHERE population = 'real')"
STD = "sd AS (SELECT point_id, population, " + ", ".join(f"({a} - mean_{a}) / std_{a} AS {a}" for a in D.AXES) + " FROM tgt, an)"
NEAR = "nr AS (SELECT p.point_id, min(sqrt(" + " + ".join(f"(p.{a} - r.{a}) ** 2" for a in D.AXES) + ")) AS d FROM sd p, sd r WHERE r.population = 'real' GROUP BY 1)"


def real(s, d):
    return points(s, d).where("population = 'real'")


def std(s, d):
    return D.standardize(points(s, d), D.real_anchor(real(s, d)))


LOW, HIGH = {"num_traces": 10.0, "num_activities": 3.0}, {"num_traces": 5000.0, "dfg_density": 0.9}
register("D1_to_target_space", lambda s, d: D.to_target(points(s, d)), "WITH " + POINTS + "\nSELECT * FROM tgt", AX)
register("D1_from_target_space", lambda s, d: D.from_target(D.to_target(points(s, d))), "WITH " + POINTS + "\nSELECT * REPLACE (least(dfg_density, 1) AS dfg_density) FROM points", AX)
register("D2_real_anchor", lambda s, d: D.real_anchor(real(s, d)), "WITH " + POINTS + ",\n" + ANCHOR + "\nSELECT * FROM an", " ".join(f"mean_{a} std_{a}" for a in D.AXES))
register("D3_nearest_distance", lambda s, d: D.nearest_distance(std(s, d), std(s, d).where("population = 'real'")).select("point_id", "nearest_real_distance"), "WITH " + ",\n".join((POINTS, ANCHOR, STD, NEAR)) + "\nSELECT point_id, d AS nearest_real_distance FROM nr", "nearest_real_distance")
register("D4_assign_band", lambda s, d: D.nearest_distance(std(s, d), std(s, d).where("population = 'real'")).select("point_id", D.band(F.round("nearest_real_distance", 9)).alias("band")), "WITH " + ",\n".join((POINTS, ANCHOR, STD, NEAR)) + "\nSELECT point_id, CASE WHEN round(d, 9) <= 1.5 THEN 'in_distribution' WHEN round(d, 9) <= 3 THEN 'expansion' ELSE 'stress' END AS band FROM nr")
_B = "bo AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS axis, {lo} AS low, greatest({hi}, {lo} + 1e-6) AS high FROM (SELECT min({a}) AS l, max({a}) AS h, greatest(max({a}) - min({a}), 1e-6) AS sp FROM tgt WHERE population = 'real')"
    for a, lo, hi in (
        ("num_traces", "greatest(l - 0.12e0 * sp, 1.0)", "least(h + 0.12e0 * sp, log10(5000))"), ("avg_trace_length", "l - 0.12e0 * sp", "h + 0.12e0 * sp"), ("num_activities", "greatest(l - 0.12e0 * sp, log10(3))", "h + 0.12e0 * sp"),
        ("variant_ratio", "greatest(l - 0.12e0 * sp, 0)", "least(h + 0.12e0 * sp, 1)"), ("dfg_density", "greatest(l - 0.12e0 * sp, 0)", "least(least(h + 0.12e0 * sp, 0.9e0), 1)"), ("repetition_prevalence", "greatest(l - 0.12e0 * sp, 0)", "least(h + 0.12e0 * sp, 1)"),
    )
) + ")"
register("D5_design_bounds", lambda s, d: D.design_bounds(real(s, d), LOW, HIGH), "WITH " + POINTS + ",\n" + _B + "\nSELECT * FROM bo", "low high")
_LONG = "lg AS (SELECT point_id, axis, CAST(least(greatest(floor((value - low) / greatest(high - low, 1e-9) * 3), 0), 2) AS BIGINT) AS bin FROM (UNPIVOT (SELECT point_id, " + ", ".join(D.AXES) + " FROM tgt) ON " + ", ".join(D.AXES) + " INTO NAME axis VALUE value) JOIN bo USING (axis))"
register("D6_pairwise_coverage", lambda s, d: D.pairwise_coverage(points(s, d), D.design_bounds(real(s, d), LOW, HIGH)), "WITH " + ",\n".join((POINTS, _B, _LONG)) + "\nSELECT a.axis AS axis_a, b.axis AS axis_b, count(DISTINCT a.bin * 3 + b.bin) AS occupied FROM lg a JOIN lg b USING (point_id) WHERE a.axis < b.axis GROUP BY 1, 2")
_H = (("mid_activity_vocabulary", "num_activities BETWEEN 20 AND 120"), ("medium_variant_ratio", "variant_ratio BETWEEN 0.25 AND 0.6"), ("large_with_diversity", "num_traces > 5000 AND num_activities > 20"), ("long_nontrivial", "avg_trace_length > 30 AND variant_ratio > 0.2"), ("dense_dfg", "dfg_density > 0.3"))
register("D7_coverage_holes", lambda s, d: D.coverage_holes(points(s, d)), "WITH " + POINTS + ",\nu AS (" + " UNION ALL ".join(f"SELECT '{n}' AS hole, count(*) FILTER (WHERE {c} AND population = 'real') AS real, count(*) FILTER (WHERE {c} AND population <> 'real') AS generated FROM points" for n, c in _H) + ")\nSELECT * FROM u")
register("D8_lhs_points", lambda s, d: D.lhs_points(D.design_bounds(real(s, d), LOW, HIGH), 200, 7, D.real_anchor(real(s, d)), real(s, d)))
register("D9_jitter_points", lambda s, d: D.jitter_points(real(s, d), D.design_bounds(real(s, d), LOW, HIGH), 200, 0.05, 7))


def banded(s, d):
    return points(s, d).withColumn("band", F.when(F.col("point_id") % 3 == 0, "stress").otherwise("expansion"))


REPAIR = POINTS + """,
r0 AS (SELECT *, CASE WHEN point_id % 3 = 0 THEN 'stress' ELSE 'expansion' END AS band FROM points),
r1 AS (SELECT point_id, population, band, least(greatest(num_traces, 10), 5000) AS num_traces, greatest(avg_trace_length, 0) AS avg_trace_length, greatest(num_activities, 3) AS num_activities, variant_ratio, least(dfg_density, 0.9) AS dfg_density, repetition_prevalence,
 CASE WHEN num_traces < 10 OR num_traces > 5000 THEN 'num_traces:cap' END AS w1, CASE WHEN num_activities < 3 THEN 'num_activities:cap' END AS w2, CASE WHEN dfg_density > 0.9 THEN 'dfg_density:cap' END AS w3 FROM r0),
r2 AS (SELECT * REPLACE (CASE WHEN num_traces * avg_trace_length > 100000 THEN greatest(10, round_even(100000 / avg_trace_length, 0)) ELSE num_traces END AS num_traces), CASE WHEN num_traces * avg_trace_length > 100000 THEN 'num_traces:events cap' END AS w4 FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN variant_ratio < 2.0 / num_traces THEN 2.0 / num_traces ELSE variant_ratio END AS variant_ratio), CASE WHEN variant_ratio < 2.0 / num_traces THEN 'variant_ratio:min variants' END AS w5 FROM r2),
r4 AS (SELECT *, avg_trace_length * log10(greatest(num_activities, 2)) AS room, log10(greatest(variant_ratio * num_traces, 1e-9)) AS need FROM r3),
r5 AS (SELECT *, need > room + log10(0.9e0) AS tight, least(greatest(0.9e0 * pow(10, least(room, 12)) / num_traces, 1.0 / num_traces), 1) AS reach FROM r4),
r6 AS (SELECT *, NOT (tight AND reach < 0.01) AS feasible FROM r5),
r7 AS (SELECT * REPLACE (CASE WHEN feasible AND tight THEN reach ELSE variant_ratio END AS variant_ratio), CASE WHEN feasible AND tight THEN 'variant_ratio:expressibility' END AS w6,
 CASE WHEN feasible AND dfg_density > 0.6 AND num_activities > 50 AND band <> 'stress' THEN 'dfg_density:spaghetti guard' END AS w7, CASE WHEN feasible AND avg_trace_length < 3 AND repetition_prevalence > 0.3 THEN 'repetition_prevalence:short traces' END AS w8 FROM r6)"""
register("D10_repair_targets", lambda s, d: D.repair_targets(banded(s, d), LOW, HIGH, 100000.0), "WITH " + REPAIR + """
SELECT point_id, population, band, num_traces, avg_trace_length, num_activities, variant_ratio, CASE WHEN w7 IS NOT NULL THEN 0.6 ELSE dfg_density END AS dfg_density, CASE WHEN w8 IS NOT NULL THEN 0.3 ELSE repetition_prevalence END AS repetition_prevalence,
 concat_ws('; ', w1, w2, w3, w4, w5, w6, w7, w8) AS repairs, feasible FROM r7""", AX)


def achieved(s, d):
    return points(s, d).withColumn("num_traces", F.col("num_traces") * (1 + F.col("point_id") % 4)).withColumn("variant_ratio", F.col("variant_ratio") * 0.9)


ACH = POINTS + """,
ach AS (SELECT * REPLACE (num_traces * (1 + point_id % 4) AS num_traces, variant_ratio * 0.9e0 AS variant_ratio) FROM points),
er AS (SELECT p.point_id, abs(log10(greatest(a.num_traces, 1e-9)) - log10(greatest(p.num_traces, 1e-9))) AS error_num_traces, 0.0 AS error_avg_trace_length, 0.0 AS error_num_activities, abs(least(greatest(a.variant_ratio, 0), 1) - least(greatest(p.variant_ratio, 0), 1)) AS error_variant_ratio, 0.0 AS error_dfg_density, 0.0 AS error_repetition_prevalence FROM points p JOIN ach a USING (point_id)),
att AS (SELECT *, greatest(error_num_traces / 0.3e0, error_avg_trace_length / 0.3e0, error_num_activities / 0.3e0, error_variant_ratio / 0.25e0) AS attainment_error FROM er)"""
register("D11_attainment_error", lambda s, d: D.attainment_error(points(s, d), achieved(s, d)), "WITH " + ACH + "\nSELECT * FROM att", " ".join(f"error_{a}" for a in D.AXES) + " attainment_error")


def records(s, d):
    p = achieved(s, d).join(D.attainment_error(points(s, d), achieved(s, d)).select("point_id", "attainment_error", *(f"error_{a}" for a in D.TOLERANCES)), "point_id")
    i = F.col("point_id")
    return p.select("*", (i % 50).alias("n_traces"), (i % 17).alias("n_activities"), (i % 13).alias("n_variants"), (F.col("num_traces") * 100).alias("n_events"), (i % 19).cast("double").alias("min_trace_length"), (i * 13).cast("double").alias("max_trace_length"), ((i % 29).cast("double") / 20).alias("duplicate_distance"))


REC = ACH + """,
rec AS (SELECT point_id, CASE WHEN point_id % 50 < 10 THEN concat('too few traces: ', point_id % 50, ' < 10') WHEN point_id % 17 < 3 THEN concat('too few activities: ', point_id % 17, ' < 3') WHEN point_id % 13 < 2 THEN concat('too few variants: ', point_id % 13, ' < 2')
 WHEN point_id % 19 < 1 THEN 'log contains empty or unmeasurable traces' WHEN a.num_traces * 100 > 1500000 THEN concat('pathological size: ', CAST(a.num_traces * 100 AS BIGINT), ' events exceeds compute cap') WHEN point_id * 13 > 5000 THEN concat('pathological trace length: ', point_id * 13, ' > 5000') WHEN attainment_error > 1 THEN concat('target attainment too poor: ', CASE WHEN error_num_traces / 0.3e0 >= error_variant_ratio / 0.25e0 THEN concat('num_traces off by ', printf('%.3f', error_num_traces)) ELSE concat('variant_ratio off by ', printf('%.3f', error_variant_ratio)) END) WHEN point_id % 29 < 3 THEN concat('near-duplicate of a real or accepted log (standardized distance ', printf('%.3f', (point_id % 29) / 20), ')') END AS rejection_reason FROM ach a JOIN att USING (point_id))"""
register("D12_acceptance", lambda s, d: D.acceptance(records(s, d), 1_000_000.0).select("point_id", "rejection_reason"), "WITH " + REC + "\nSELECT * FROM rec")
register("D13_near_duplicate_dedup", lambda s, d: D.near_duplicate_dedup(std(s, d).where("population <> 'real'"), std(s, d).where("population = 'real'")))
_F = ["n_events", "n_cases", "spread"]


def small_features(s, d):
    f = event_log(s, d).groupBy("log_id").agg(F.count("*").cast("double").alias("n_events"), F.count_distinct("case_id").cast("double").alias("n_cases"), F.count_distinct("activity").cast("double").alias("spread"))
    return f.withColumn("n_cases", F.when(F.col("log_id") != "log1", F.col("n_cases"))).withColumn("population", log_population(F.col("log_id")))


FEATS = """f AS (SELECT log_id, CAST(count(*) AS DOUBLE) AS n_events, CASE WHEN log_id <> 'log1' THEN CAST(count(DISTINCT case_id) AS DOUBLE) END AS n_cases, CAST(count(DISTINCT activity) AS DOUBLE) AS spread,
 CASE WHEN starts_with(log_id, 'syn_gedi') THEN 'gedi' WHEN starts_with(log_id, 'aug_') THEN 'augmented' ELSE 'real' END AS population FROM event_log GROUP BY 1)"""
register("D14_dispersion", lambda s, d: D.dispersion(small_features(s, d), "log_id", _F), "WITH " + FEATS + """,
a AS (SELECT log_id, n_events, coalesce(n_cases, avg(n_cases) OVER ()) AS n_cases, spread FROM f),
z AS (SELECT log_id, CASE WHEN stddev_pop(n_events) OVER () > 1e-12 THEN (n_events - avg(n_events) OVER ()) / stddev_pop(n_events) OVER () ELSE 0 END AS x, CASE WHEN stddev_pop(n_cases) OVER () > 1e-12 THEN (n_cases - avg(n_cases) OVER ()) / stddev_pop(n_cases) OVER () ELSE 0 END AS y, CASE WHEN stddev_pop(spread) OVER () > 1e-12 THEN (spread - avg(spread) OVER ()) / stddev_pop(spread) OVER () ELSE 0 END AS w FROM a),
p AS (SELECT u.log_id, avg(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.w - v.w) ** 2)) AS m, min(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.w - v.w) ** 2)) AS n FROM z u JOIN z v ON u.log_id <> v.log_id GROUP BY 1)
SELECT avg(m) AS mean_pairwise, avg(n) AS mean_nearest, count(*) AS n_logs, (SELECT var_pop(x) + var_pop(y) + var_pop(w) FROM z) AS total_variance FROM p""", "mean_pairwise mean_nearest total_variance")
register("D15_range_coverage", lambda s, d: D.range_coverage(small_features(s, d), _F), "WITH " + FEATS + """,
l AS (SELECT population, feature, v FROM (UNPIVOT (SELECT population, n_events, n_cases, spread FROM f) ON n_events, n_cases, spread INTO NAME feature VALUE v)),
r AS (SELECT feature, min(v) FILTER (WHERE population = 'real') AS real_min, max(v) FILTER (WHERE population = 'real') AS real_max, min(v) FILTER (WHERE population <> 'real') AS made_min, max(v) FILTER (WHERE population <> 'real') AS made_max FROM l GROUP BY 1)
SELECT *, made_min < real_min OR made_max > real_max AS beyond, CASE WHEN real_max > real_min THEN (made_max - made_min) / (real_max - real_min) END AS range_ratio FROM r""", "real_min real_max made_min made_max range_ratio")
register("D16_acceptance_summary", lambda s, d: D.acceptance_summary(D.acceptance(records(s, d), 1_000_000.0).where("point_id >= 20"), points(s, d).where("point_id < 580").select("point_id")), "WITH " + REC + """,
q AS (SELECT * FROM rec WHERE point_id >= 20), t AS (SELECT point_id FROM points WHERE point_id < 580),
u AS (SELECT 'status' AS kind, CASE WHEN rejection_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS value, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'reason', split_part(split_part(rejection_reason, ':', 1), ' (', 1), count(*) FROM q WHERE rejection_reason IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'targets', 'missing', count(*) FROM t WHERE point_id NOT IN (SELECT point_id FROM q) HAVING count(*) > 0 UNION ALL SELECT 'targets', 'unknown', count(*) FROM q WHERE point_id NOT IN (SELECT point_id FROM t) HAVING count(*) > 0)
SELECT * FROM u""")
register("D17_project_2d", lambda s, d: D.project_2d(std(s, d)))
register("D_six_axes_targets", lambda s, d: D.to_target(X.six_axes(event_log(s, d))))
register("D17_explained_variance", lambda s, d: D.explained_variance(std(s, d)))
