import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracemill.operators import ablation as A
from tracemill.operators import models as L
from tracemill.operators import surrogates as U
from tracemill.operators.evaluate import MEASURES

SCHEMA = "log_id string, algorithm string, config_hash string, experiment_id string, p1 double, p2 double, size double, " + ", ".join(f"{m} double" for m in MEASURES)


def rows_of(seed=1, logs=9, configs=8):
    """Runs whose fitness is told by the algorithm and size, and whose precision falls with p1."""
    rng = random.Random(seed)
    out = []
    for i in range(logs):
        log = [f"log{i}", f"aug_log{i}__x__s1", f"syn_gedi_t{i}"][i % 3]
        for c in range(configs):
            alg = f"alg{c % 3}"
            p1 = None if c % 3 == 0 else c / configs
            fit = (0.2 + 0.3 * (c % 3)) if i % 2 else 0.9 - 0.3 * (c % 3)
            out.append((log, alg, f"c{c}", "v6_baseline" if c < 3 else "other", p1, None, float(i % 2), fit, 0.9 - (p1 or 0) / 2, rng.random(), None if c == 7 and i == 1 else 0.5))
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).cache()


COLUMNS = ["p1", "p2", "size"]


@pytest.fixture(scope="module")
def fitted(runs):
    medians = L.imputation(runs, COLUMNS)
    rows = L.impute(runs, medians)
    return L.train_surrogate(rows, COLUMNS, trees=7, depth=4), rows, medians


def test_every_tree_is_read(fitted):
    """The arrays hold what each tree says, and their mean is the forest's."""
    models, rows, _ = fitted
    out = U.tree_predictions(models, rows)
    for m in ("fitness", "generalization"):
        forest = models[m].stages[-1]
        whole = out
        for stage in models[m].stages:
            whole = stage.transform(whole)
        found = whole.select("_x", f"trees_{m}", f"pred_{m}").collect()
        for r in found:
            assert r[f"trees_{m}"] == pytest.approx([t.predict(r["_x"]) for t in forest.trees])
            assert sum(r[f"trees_{m}"]) / 7 == pytest.approx(r[f"pred_{m}"])
    assert out.columns == [*rows.columns, *(f"trees_{m}" for m in MEASURES)]


@pytest.mark.parametrize("weights,composite,std,level", [((1, 0, 0, 0), 0.5, 0.1, "medium"), ((0, 1, 0, 0), 0.3, 0.0, "high"), ((0, 0, 1, 0), 0.5, 0.5, "low"), ((1, 1, 0, 2), 0.4, 0.025 * 2, "medium"), ((0, 0, 0, 0), 0.0, 0.0, "high")])
def test_spread_follows_the_weights(spark, weights, composite, std, level):
    """Trees made by hand: fitness 0.4 and 0.6, precision always 0.3, generalization 0 and 1, simplicity 0.35 and 0.45."""
    rows = spark.createDataFrame([([0.4, 0.6], [0.3, 0.3], [0.0, 1.0], [0.35, 0.45])], ", ".join(f"trees_{m} array<double>" for m in MEASURES))
    r = U.blended(rows, dict(zip(MEASURES, map(float, weights)))).first()
    assert r["composite"] == pytest.approx(composite)
    wanted = sum(w * s for w, s in zip(weights, (0.1, 0.0, 0.5, 0.05))) / (sum(weights) or 1)
    assert r["std"] == pytest.approx(wanted)
    assert r["confidence"] == ("high" if wanted < 0.05 else "medium" if wanted < 0.15 else "low")


def test_recommend(spark, fitted, runs):
    models, rows, medians = fitted
    logs = spark.createDataFrame([("new", 1.0), ("other", 0.0)], "log_id string, size double")
    configs = runs.select("algorithm", "config_hash", "p1", "p2")
    out = U.recommend(models, configs, logs, {"fitness": 1.0}, 2, medians).collect()
    best = {r["log_id"]: r["algorithm"] for r in out if r["rank"] == 1}
    assert best == {"new": "alg2", "other": "alg0"} and len(out) == 4
    assert all(r["confidence"] in ("high", "medium", "low") for r in out)


def test_models_by_group(runs, spark):
    few = runs.unionByName(spark.createDataFrame([("log1", "rare", "r", "other", 0.5, None, 1.0, 0.7, 0.7, 0.7, 0.7)], SCHEMA))
    found = U.train_by_group(few, COLUMNS, trees=8, depth=3, least=10)
    assert {g for g, _ in found.own} == {"alg0", "alg1", "alg2"} and set(found.pooled) == set(MEASURES)
    unknown = spark.createDataFrame([("log1", a, h, "other", 9.0, None, 1.0, None, None, None, None) for a, h in (("never", "n"), (None, "m"))], SCHEMA)
    rows = found.predict(few.unionByName(unknown)).collect()
    assert len(rows) == few.count() + 2
    for r in rows:
        own = r["algorithm"] in ("alg0", "alg1", "alg2")
        assert {r[f"by_{m}"] for m in MEASURES} == {"own" if own else "pooled"}
        assert all(0 <= r[f"pred_{m}"] <= 1 for m in MEASURES)
        if own:
            assert r["pred_fitness"] == pytest.approx(r["fitness"], abs=0.05)


def test_predictions_are_clamped(spark):
    wild = [(f"l{i}", "a", f"c{i}", "x", float(i), None, 0.0, 5.0 * (i % 2) - 2, 0.5, 0.5, 0.5) for i in range(30)]
    rows = spark.createDataFrame(wild, SCHEMA)
    for boosted in (True, False):
        out = U.train_by_group(rows, ["p1"], trees=5, boosted=boosted).predict(rows).select("pred_fitness").distinct().collect()
        assert {r[0] for r in out} <= {0.0, 1.0} | {x for x in (r[0] for r in out) if 0 <= x <= 1} and min(r[0] for r in out) == 0.0


def test_registry_fits_once():
    made = []
    cache = U.Registry()
    for _ in range(3):
        assert cache.get("k", lambda: made.append(1) or "model") == "model"
    assert made == [1] and cache.fits == ["k"]


def test_side_by_side_keeps_order_and_errors():
    assert U.side_by_side([lambda i=i: i * i for i in range(9)], 3) == [i * i for i in range(9)]
    with pytest.raises(ZeroDivisionError):
        U.side_by_side([lambda: 1 / 0], 2)


@pytest.fixture(scope="module")
def inputs(spark, runs):
    logs = runs.select("log_id", "size").distinct()
    feats = {"log": logs, "distribution": logs.select("log_id", (1 - F.col("size")).alias("d1"), F.lit(3.0).alias("d2"))}
    outside = spark.createDataFrame([(f"o{i}", "alg2" if i % 2 else "alg0", 1.0 - i % 2, 3.0) for i in range(6)], "log_id string, label string, d1 double, d2 double")
    defaults = spark.createDataFrame([("alg0", None, None), ("alg1", 0.2, None), ("alg2", 0.3, None)], "algorithm string, p1 double, p2 double")
    return A.Inputs(runs.drop("size"), ["p1", "p2"], defaults, feats, outside, ("alg0", "alg2"))


def test_action_spaces(inputs, runs):
    n = {a: A.action_rows(inputs, runs, a).count() for a in ("base_default", "base_tuned", "all_default", "all_tuned")}
    assert n == {"base_default": 18, "base_tuned": 9 * 5, "all_default": 27, "all_tuned": 72}
    assert A.action_rows(inputs, runs, "base_default").columns == runs.columns  # nothing is added


def test_predicted_label_is_on_offer(spark, inputs, runs):
    seen = Observation()  # a session that has observed something still takes the model to its tasks
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    train = A.labels(inputs, runs, "base_default").join(inputs.features["log"], "log_id")
    model = L.variant_classifier(train, ["size"], trees=5)
    rows = spark.createDataFrame([("x", 1.0, ["alg0"]), ("y", 1.0, ["alg0", "alg2", "zzz"]), ("z", 1.0, ["zzz"])], "log_id string, size double, allowed array<string>")
    assert {r["log_id"]: r["predicted"] for r in A.predict_offered(model, rows).collect()} == {"x": "alg0", "y": "alg2", "z": None}


def test_eleven_setups(inputs):
    few = {n: A.Setup(s.kind, s.features, s.data, s.actions, 3, s.seed) for n, s in A.SETUPS.items()}
    cache = U.Registry()
    out = {r["setup"]: r for r in A.ablation_matrix(inputs, few, folds=2, cache=cache).collect()}
    assert sorted(out) == sorted(A.SETUPS) and len(A.SETUPS) == 11
    assert len(cache.fits) == len(set(cache.fits)) == 22
    # three real logs by fifteen weightings, less the folds whose few rows tell nothing apart
    assert all(r["n_cells"] % 15 == 0 for r in out.values()) and {out[n]["n_cells"] for n in ("B0", "B1", "C2", "C3", "C4", "C5")} == {45}, {n: r["n_cells"] for n, r in out.items()}
    graded = [r for r in out.values() if r["n_cells"]]
    assert len(graded) >= 8
    for r in graded:
        assert 0 <= r["mean_accuracy_action"] <= 1 and r["mean_regret_full"] >= 0
    # the outside table alone tells what is best for a size
    assert out["B0"]["mean_train_rows"] == 6 and out["C5"]["mean_train_rows"] > out["C1"]["mean_train_rows"]


def test_fair_fight_needs_two_candidates(spark):
    rows = [("l1", "a", 0.9, 0.1, 0.2), ("l1", "b", 0.5, 0.8, 0.1), ("l2", "a", 0.4, 0.3, 0.3), ("l3", "a", 0.4, 0.3, 0.3), ("l3", "b", 0.6, None, 0.3)]
    df = spark.createDataFrame([(log, c, "alg", *([real] * 4), *([p] * 4), *([q] * 4)) for log, c, real, p, q in rows], "log_id string, config_hash string, algorithm string, " + ", ".join(f"{pre}{m} double" for pre in ("", "p_", "q_") for m in MEASURES))
    out = L.fair_fight(df, {"p": "p_", "q": "q_"}).where("weighting = 'equal'").collect()
    assert {(r["log_id"], r["method"]): r["score"] for r in out} == {("l1", "p"): pytest.approx(0.5), ("l1", "q"): pytest.approx(0.9)}


def test_save_and_load(fitted, tmp_path):
    models, rows, _ = fitted
    L.save_models(models, str(tmp_path))
    a = L.predict_measures(models, rows).select("log_id", "config_hash", "pred_fitness").collect()
    assert sorted(a) == sorted(L.predict_measures(L.load_models(str(tmp_path)), rows).select("log_id", "config_hash", "pred_fitness").collect())


def test_importance_sums_to_one(fitted, runs):
    out = L.feature_importance(fitted[0], COLUMNS, {"p1": "hyper", "algorithm": "algorithm"}, runs)
    sums = {r["measure"]: r["s"] for r in out.groupBy("measure").agg(F.sum("importance").alias("s")).collect()}
    assert sums["fitness"] == pytest.approx(1.0) and sums["precision"] == pytest.approx(1.0)
    top = out.where("measure = 'precision'").orderBy(F.desc("importance")).first()
    assert top["feature"] in ("p1", "algorithm")
