import random

import numpy as np
import pytest

from tracemill.operators import nearest as N
from tracemill.operators import space

AXES = [f"a{i}" for i in range(6)]


def frame(spark, x, key="k"):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], f"{key} long, " + ", ".join(f"{a} double" for a in AXES))


@pytest.mark.parametrize("rows", [7, 40, 5000])
def test_nearest_against_all_pairs(spark, rows, monkeypatch):
    """Clusters, equal points and points far away; blocks of a few rows and boxes of three boxes."""
    monkeypatch.setattr(N, "BOXES", 3)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 6)) * 5
    ref = np.concatenate([centre[rng.integers(6, size=250)] + rng.normal(size=(250, 6)) * 0.3, np.repeat(centre[:1], 40, axis=0), [[90] * 6]])
    pts = np.concatenate([centre[rng.integers(6, size=120)] + rng.normal(size=(120, 6)), [[-80] * 6], centre[:1], rng.normal(size=(60, 6)) * 20])
    found = {r["k"]: r["d"] for r in N.nearest(frame(spark, pts), frame(spark, ref), AXES, "k", rows).collect()}
    want = np.sqrt(((pts[:, None] - ref[None]) ** 2).sum(2)).min(1)
    assert sorted(found) == [*range(len(pts))]
    assert [found[i] for i in range(len(pts))] == pytest.approx(list(want))


def test_few_blocks_meet(spark):
    """Of two lines of 40 blocks each, a block meets a few: boxes rule the rest out."""
    line = np.zeros((400, 6))
    line[:, 0] = np.arange(400)
    p = N.blocked(frame(spark, line), AXES, "k", 10)
    box = N.boxes(p, AXES)
    assert N._meeting(box, box, AXES).count() <= 5 * box.count()


def test_nothing_to_compare(spark):
    some = frame(spark, np.ones((3, 6)))
    assert N.nearest(some, some.limit(0), AXES, "k").count() == 0
    assert N.nearest(some.limit(0), some, AXES, "k").count() == 0


def test_large_reference_takes_blocks(spark, monkeypatch):
    rng = random.Random(1)
    schema = "point_id long, " + ", ".join(f"{a} double" for a in space.AXES)
    rows = [(i, *(rng.random() for _ in space.AXES)) for i in range(60)]
    pts, ref = spark.createDataFrame(rows[:30] + [(99, None, *([1.0] * 5))], schema), spark.createDataFrame(rows[30:], schema)
    plain = {r["point_id"]: r["nearest_real_distance"] for r in space.nearest_distance(pts, ref).collect()}
    monkeypatch.setattr(space, "SMALL", 5)
    found = {r["point_id"]: r["nearest_real_distance"] for r in space.nearest_distance(pts, ref).collect()}
    assert found.keys() == plain.keys()
    assert {k: v for k, v in found.items() if k != 99} == pytest.approx({k: v for k, v in plain.items() if k != 99})


@pytest.mark.parametrize("rows", [4, 100])
def test_pair_distances(spark, rows):
    x = np.random.default_rng(2).normal(size=(31, 5))
    x[7] = x[8]
    df = spark.createDataFrame([(f"v{i}", row.tolist()) for i, row in enumerate(x)], "name string, x array<double>")
    out = {r["name"]: (r["total"], r["near"]) for r in N.pair_distances(df, "name", 31, rows).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(31):
        assert out[f"v{i}"] == pytest.approx((d[i].sum(), np.delete(d[i], i).min()))


def test_one_vector_alone(spark):
    df = spark.createDataFrame([("v", [1.0])], "name string, x array<double>")
    assert [tuple(r) for r in N.pair_distances(df, "name", 1).collect()] == [("v", 0.0, None)]
