import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, make_log
from tracemill.operators import augment, clean, evaluate, grid, inspect, space, traces
from tracemill.sources import logs


def test_repeated_columns_and_schema(spark):
    log = make_log(spark, {"c": "ab"}).withColumnRenamed("activity", "concept:name")
    assert clean.normalize_columns(log).columns[:4] == ["log_id", "case_id", "activity", "ts"]
    with pytest.raises(ValueError, match="missing required"):
        clean.normalize_columns(log.drop("ts"))


def test_lifecycle_pairs_equal_a_queue(spark):
    rng = random.Random(4)
    rows, wanted = [], set()
    for case in range(40):
        queue, pairs = [], []
        for i in range(rng.randint(0, 12)):
            kind = rng.choice(["start", "complete"])
            rows.append(("l", str(case), "a", kind, BASE, i))
            if kind == "start":
                queue.append(i)
            elif queue:
                pairs.append((queue.pop(0), i))
        wanted |= {(str(case), a, b) for a, b in pairs}
    log = spark.createDataFrame(rows, "log_id string, case_id string, activity string, lifecycle string, ts timestamp, event_index int")
    found = {(r["case_id"], r["start_index"], r["complete_index"]) for r in inspect.lifecycle_pairs(log).collect()}
    assert found == wanted


def test_subsample_quotas_add_up(spark):
    # 15 cases at two fifths are 6: 3.6, 1.6, 0.8 cases, whole parts 3, 1, 0; the third gets one more, and of the equal others the more frequent
    log = make_log(spark, {f"c{i}": t for i, t in enumerate(["xyz"] * 9 + ["yx"] * 4 + ["z"] * 2)})
    q = augment.subsample_quotas(traces.distinct_variants(traces.traces(log)), 0.4).collect()
    assert {r["n"]: r["quota"] for r in q} == {9: 4, 4: 1, 2: 1}
    assert augment.subsample_variants(log, 0.4, 3).select("case_id").distinct().count() == 6


def test_noise_empties_no_case(spark):
    log = make_log(spark, {f"c{i}": "abcde"[: 1 + i % 5] for i in range(60)})
    out = augment.inject_event_noise(log, 0.9, 5)
    assert out.select("case_id").distinct().count() == 60
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, augment.inject_event_noise(log.repartition(3), 0.9, 5).collect()))
    assert augment.inject_event_noise(log, 0.0, 5).count() == log.count()


def test_variant_coverage(spark):
    log = make_log(spark, {f"c{i}": t for i, t in enumerate(["xyz"] * 5 + ["yx"] * 3 + ["z"] * 2)})
    for share, cases in ((0.0, 0), (0.5, 5), (0.51, 8), (0.8, 8), (0.81, 10), (1.0, 10)):
        assert augment.filter_variant_coverage(log, share).select("case_id").distinct().count() == cases, share


@pytest.mark.parametrize("bucket", [1, 3, 100])
def test_levels_of_variants_against_lists(spark, monkeypatch, bucket):
    """Coverage and quotas by levels of equal counts choose what a walk over all variants chooses, also where the level ends inside a bucket."""
    import hashlib

    monkeypatch.setattr(augment, "BUCKET", bucket)
    rng = random.Random(bucket)
    words = ["".join(rng.choice("pqr") for _ in range(rng.randint(1, 5))) for _ in range(90)]
    log = make_log(spark, {f"c{i}": w for i, w in enumerate(words)})
    counts = collections.Counter(words)
    text = lambda w: "\x1f".join(w)
    for share in (0.0, 0.3, 0.62, 0.9, 1.0):
        kept, seen = set(), 0
        for w in sorted(counts, key=lambda w: (-counts[w], text(w))):
            if seen < share * 90:
                kept.add(w)
            seen += counts[w]
        found = {r[0] for r in augment.filter_variant_coverage(log, share).select("case_id").distinct().collect()}
        assert found == {f"c{i}" for i, w in enumerate(words) if w in kept}, share
    kinds = traces.distinct_variants(traces.traces(log))
    for share in (0.1, 0.37, 0.5):
        name = {w: hashlib.sha256(text(w).encode()).hexdigest() for w in counts}
        quota = {w: int(counts[w] * share + 1e-12) for w in counts}
        rest = max(round(90 * share), 1) - sum(quota.values())
        for w in sorted(counts, key=lambda w: (-round(counts[w] * share - quota[w], 9), -counts[w], name[w]))[:rest]:
            quota[w] += 1
        found = {r["variant_hash"]: r["quota"] for r in augment.subsample_quotas(kinds, share).collect()}
        assert found == {name[w]: quota[w] for w in counts}, share


def test_lhs_has_one_point_per_stratum(spark):
    rows = grid.sample_lhs(spark, {"x": ("float", 0.0, 1.0, "linear"), "k": ("int", 1, 4, "linear"), "m": ("choice", ["a", "b"])}, 20, 1).collect()
    assert sorted(int(r["x"] * 20) for r in rows) == [*range(20)]
    assert sorted(r["m"] for r in rows) == ["a"] * 10 + ["b"] * 10


def test_near_duplicates_are_dropped_in_order(spark):
    rng = random.Random(2)
    pts = [(i, *(rng.choice([0.0, 0.05, 0.1, 0.2, 0.4]) for _ in space.AXES)) for i in range(60)]
    schema = "point_id long, " + ", ".join(f"{a} double" for a in space.AXES)
    real = [(-1, *([9.0] * 6))]
    kept = []
    for p in pts:
        if all(sum((x - y) ** 2 for x, y in zip(p[1:], q[1:])) ** 0.5 >= 0.15 for q in kept):
            kept.append(p)
    out = space.near_duplicate_dedup(spark.createDataFrame(pts, schema), spark.createDataFrame(real, schema))
    assert sorted(r["point_id"] for r in out.collect()) == [p[0] for p in kept]


def test_near_duplicates_of_a_long_chain(spark):
    schema = "point_id long, " + ", ".join(f"{a} double" for a in space.AXES)
    pts = [(i, 0.1 * i, *([0.0] * 5)) for i in range(104)]
    out = space.near_duplicate_dedup(spark.createDataFrame(pts, schema), spark.createDataFrame([(-1, *([99.0] * 6))], schema))
    assert sorted(r["point_id"] for r in out.collect()) == [*range(0, 104, 2)]


def test_a_chain_of_two_hundred_takes_few_jobs(spark):
    """A chain inside a block is decided in one round; cut into blocks of 16 points it takes a round a block."""
    schema = "point_id long, " + ", ".join(f"{a} double" for a in space.AXES)
    chain = spark.createDataFrame([(i, 0.1 * i, *([0.0] * 5)) for i in range(200)], schema)
    far = spark.createDataFrame([(-1, *([99.0] * 6))], schema)
    spark.sparkContext.setJobGroup("chain", "chain")
    out = space.near_duplicate_dedup(chain, far)
    rounds = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["point_id"] for r in out.collect()) == [*range(0, 200, 2)]
    assert rounds <= 40, rounds  # jobs of Spark, adaptive stages included; not one a link
    small = space.near_duplicate_dedup(chain, far, rows=16)
    assert sorted(r["point_id"] for r in small.collect()) == [*range(0, 200, 2)]


def test_explained_variance(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(80, 6)) * [5, 3, 2, 1, 1, 0.5]
    x[:, 3] += x[:, 0]
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, " + ", ".join(f"{a} double" for a in space.AXES))
    rows = space.explained_variance(points).orderBy("component").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["explained"] for r in rows] == pytest.approx(list(want / want.sum()))
    assert rows[-1]["cumulative"] == pytest.approx(1.0)
    flat = np.array([tuple(r)[1:] for r in space.project_2d(points).orderBy("point_id").collect()])
    assert flat.var(axis=0, ddof=1) == pytest.approx(list(want[:2]))


def test_jitter_stays_in_bounds_and_is_repeatable(spark):
    real = spark.createDataFrame([(f"r{i}", *(0.2 + 0.1 * (i % 5) for _ in space.AXES)) for i in range(10)], "point_id string, " + ", ".join(f"{a} double" for a in space.AXES))
    bounds = space.design_bounds(real, {}, {})
    a, b = (space.jitter_points(real.repartition(n), bounds, 150, 0.05, 7) for n in (1, 5))
    rows = a.collect()
    assert len(rows) == 150 and sorted(map(str, rows)) == sorted(map(str, b.collect()))
    assert sorted(map(str, space.jitter_points(real, bounds, 150, 0.05, 8).collect())) != sorted(map(str, rows))
    assert all(0.0 <= r["variant_ratio"] <= 1.0 for r in rows)


def test_augmented_children(spark):
    """Every parent gives its planned children; each is accepted or has a reason, and accepted ones have their events."""
    log = make_log(spark, {f"c{i}": "abcdefgh"[: 2 + i % 6] for i in range(40)}).unionByName(make_log(spark, {"d": "ab"}, "tiny"))
    children, manifest = augment.augment_logs(log, 3)
    rows = {r["log_id"]: r for r in manifest.collect()}
    assert set(rows) == {f"aug_{p}__{k}__s3" for p in ("l", "tiny") for k in ("cov080", "sub050", "noise005")}
    assert all(r["accepted"] == (r["reason"] is None) == r["log_id"].startswith("aug_l_") for r in rows.values())
    sizes = {r["log_id"]: r["n"] for r in children.groupBy("log_id").agg(F.count_distinct("case_id").alias("n")).collect()}
    assert sizes == {k: r["n_traces"] for k, r in rows.items()} and sizes["aug_l__sub050__s3"] == 20


def test_acceptance_takes_the_first_reason(spark):
    axes = {a: 1.0 for a in space.AXES}
    row = {"n_traces": 9, "n_activities": 1, "n_variants": 1, "min_trace_length": 1.0, "max_trace_length": 2.0, "n_events": 5.0, "attainment_error": 0.1, "duplicate_distance": 1.0, **axes}
    assert space.acceptance(spark.createDataFrame([row])).first()["rejection_reason"] == "too few traces: 9 < 10"
    fine = {**row, "n_traces": 10, "n_activities": 3, "n_variants": 2}
    assert space.acceptance(spark.createDataFrame([fine])).first()["rejection_reason"] is None
    near = {**fine, "duplicate_distance": 0.1}
    assert space.acceptance(spark.createDataFrame([near])).first()["rejection_reason"].startswith("near-duplicate")
    assert space.acceptance(spark.createDataFrame([near]), duplicates=False).first()["rejection_reason"] is None
    errors = {f"error_{a}": 0.0 for a in space.TOLERANCES}
    poor = {**fine, **errors, "attainment_error": 2.0, "error_num_traces": 0.45, "error_variant_ratio": 0.5}
    said = {
        "near-duplicate of a real or accepted log (standardized distance 0.100)": near,
        "target attainment too poor: variant_ratio off by 0.500": poor,
        "target attainment too poor: num_traces off by 0.600": {**poor, "error_num_traces": 0.6, "error_variant_ratio": 0.5},
        "target attainment too poor": {**fine, "attainment_error": 2.0},
        "pathological size: 9000001 events exceeds compute cap": {**fine, "n_events": 9_000_001.0},
        "pathological trace length: 5001 > 5000": {**fine, "max_trace_length": 5001.0},
        "target axis features not computable: num_traces, dfg_density": {**fine, "num_traces": float("nan"), "dfg_density": float("nan")},
    }
    for reason, record in said.items():
        assert space.acceptance(spark.createDataFrame([record])).first()["rejection_reason"] == reason


def test_weights():
    assert evaluate.parse_weights("0.1,0.2,0.3,0.4")["simplicity"] == 0.4
    assert evaluate.parse_weights("fitness=1") == {"fitness": 1.0, "precision": 0.0, "generalization": 0.0, "simplicity": 0.0}
    with pytest.raises(ValueError, match="unknown"):
        evaluate.parse_weights("speed=1")
    assert len(evaluate.weight_sets()) == 15


def test_objective_rules(spark):
    rows = spark.createDataFrame([("success", 0.5, None), ("failed", 0.9, 0.9), ("success", 0.5, 1.0)], "status string, fitness double, precision double")
    assert [r["objective"] for r in grid.objective(rows, {"fitness": 1.0, "precision": 0.0}).collect()] == [0.5, 0.0, 0.5]
    assert [r["objective"] for r in grid.objective(rows, {"fitness": 1.0, "precision": 1.0}, -1.0).collect()] == [-1.0, -1.0, 0.75]


def test_expand_grid(spark):
    rows = grid.expand_grid(spark, {"a": [1, 2], "b": [0, 1]}, [("b", 1.0, {"c": [5, 6]})]).collect()
    assert {tuple(r) for r in rows} == {*itertools.product((1.0, 2.0), (0.0,), (None,)), *itertools.product((1.0, 2.0), (1.0,), (5.0, 6.0))}


def test_xes_round_trip(spark, tmp_path):
    log = make_log(spark, {"c1": "abc", "c2": "a<b"})
    logs.write_xes(log, str(tmp_path / "x"))
    events, cases = logs.read_xes(spark, str(tmp_path / "x/*/*.xml"))
    assert sorted((r["case_id"], r["event_index"], r["activity"]) for r in events.collect()) == sorted((r["case_id"], r["event_index"], r["activity"]) for r in log.collect())
    assert {r["event_count"] for r in cases.collect()} == {3}


def test_xes_names_types_and_bad_times(spark, tmp_path):
    (tmp_path / "tiny.xes").write_text(
        '<log><extension name="Time" prefix="time" uri="u"/><classifier name="k" keys="concept:name lifecycle:transition"/>'
        '<trace><string key="concept:name" value="c"/><event><string key="concept:name" value="A"/><date key="time:timestamp" value="2026-01-01T09:00:00.000+00:00"/><int key="n" value="3"/></event></trace>'
        '<trace><event><string key="concept:name" value="B"/><date key="time:timestamp" value="never"/></event></trace></log>'
    )
    events, cases = logs.read_xes(spark, str(tmp_path / "tiny.xes"))
    rows = {r["case_id"]: r for r in events.collect()}
    assert rows["c"]["attrs"]["n"] == "3" and rows["c"]["log_id"] == "tiny"
    assert rows["2"]["ts"] is None and rows["2"]["activity"] == "B"
    head = logs.read_headers(spark, str(tmp_path / "tiny.xes"))
    assert head["classifiers"].first()["keys"] == ["concept:name", "lifecycle:transition"]


def test_result_stream(spark, tmp_path):
    import json

    from tracemill.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()

    def put(name, log, config, minute):
        (src / name).write_text(json.dumps({"log_id": log, "config_hash": config, "status": "success", "metadata": {"timestamp_utc": f"2026-01-01T00:{minute:02d}:00Z"}}))

    put("a.json", "l", "x", 1)
    put("b.json", "l", "y", 2)
    args = (spark, str(src), str(tmp_path / "table"), str(tmp_path / "mark"))
    ingest(*args).awaitTermination()
    put("c.json", "l", "x", 3)
    put("d.json", "m", "x", 4)
    ingest(*args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    assert sorted((r["log_id"], r["config_hash"]) for r in rows) == [("l", "x"), ("l", "y"), ("m", "x")]


def test_results_scan_counts_corrupt_files(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"log_id": "l", "config_hash": "c", "metrics": {"fitness": 0.5}}')
    (tmp_path / "skip_me.json").write_text('{"log_id": "m"}')
    (tmp_path / "bad.json").write_text("{nothing")
    good, bad = logs.read_results(spark, [str(tmp_path)], ("skip_me",))
    assert [r["log_id"] for r in good.collect()] == ["l"] and bad.first()[0] == 1


def test_families(spark):
    ids = spark.createDataFrame([("aug_p__x__s1",), ("syn_gedi_t1",), ("syn_a",), ("p",)], "log_id string")
    rows = ids.select(clean.log_family(F.col("log_id")), clean.log_population(F.col("log_id"))).collect()
    assert [tuple(r) for r in rows] == [("p", "augmented"), ("syn_gedi_t1", "gedi"), ("syn_a", "synth"), ("p", "real")]


def test_augmentation_joins_nothing_by_log_alone(spark):
    """Joins and windows by log, or by log and count, would bring a whole log to one task."""
    log = make_log(spark, {f"c{i}": "abcd"[: 1 + i % 4] * 2 for i in range(40)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan(augment.inject_event_noise(log, 0.2, 1)) + plan(augment.filter_top_activities(log, 0.6))
        for df in (augment.filter_variant_coverage(log, 0.8), augment.subsample_quotas(traces.distinct_variants(traces.traces(log)), 0.3)):
            joins = [line for line in plan(df).splitlines() if "SortMergeJoin" in line]
            assert joins and not any(line.split("[")[1].split("]")[0].count("#") == 2 and " n#" in line for line in joins)
        assert plan(augment.inject_event_noise(log, 0.2, 1)).count("Sort [") == 1
        assert augment.inject_event_noise(log, 0.0, 1).count() == log.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
