import collections

import pytest

from tracemill.operators import sampling as P

SPACE = {"mode": {"values": ["p", "q", "r"]}, "noise": {"type": "float", "min": 0.2, "max": 0.9}, "fast": [True, False]}
BRANCHES = [
    ({"mode": "p"}, {"alpha": {"type": "float", "min": 0.001, "max": 1.0, "scale": "log"}, "kind": [1, 2, 3]}),
    ({"mode": "q"}, {"beta": {"type": "integer", "min": 1, "max": 6}}),
    ({"mode": "p", "kind": 2}, {"gamma": {"type": "float", "min": -1.0, "max": 1.0}}),
    ({"mode": "never"}, {"delta": [1, 2]}),
]


@pytest.fixture(scope="module")
def design(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 2)], "log_id string, part int")
    return P.conditional_lhs(keys, SPACE, BRANCHES, n=90, seed=4).cache()


def by_key(design):
    out = collections.defaultdict(list)
    for r in design.collect():
        out[r["log_id"], r["part"]].append(r)
    return out


def test_every_design_is_a_hypercube(design):
    found = by_key(design)
    assert {k: len(v) for k, v in found.items()} == {("a", 1): 90, ("b", 1): 90, ("b", 2): 90}
    for rows in found.values():
        assert sorted(int((r["noise"] - 0.2) / 0.7 * 90) for r in rows) == [*range(90)]
        assert collections.Counter(r["mode"] for r in rows) == {"p": 30, "q": 30, "r": 30}
        assert collections.Counter(r["fast"] for r in rows) == {0.0: 45, 1.0: 45}
    assert len({tuple(r["noise"] for r in sorted(v, key=lambda r: r["point"])) for v in found.values()}) == 3


def test_branches_have_strata_of_their_own(design):
    """By enumeration: one point a stratum of the branch, and nothing of other branches."""
    import math

    for rows in by_key(design).values():
        p = [r for r in rows if r["mode"] == "p"]
        assert sorted(int(math.log(r["alpha"] / 0.001) / math.log(1000) * 30) for r in p) == [*range(30)]
        assert collections.Counter(r["kind"] for r in p) == {1.0: 10, 2.0: 10, 3.0: 10}
        nested = [r for r in p if r["kind"] == 2]
        assert sorted(int((r["gamma"] + 1) / 2 * 10) for r in nested) == [*range(10)]
        q = collections.Counter(r["beta"] for r in rows if r["mode"] == "q")
        assert set(q) == {1.0, 2.0, 3.0, 4.0, 5.0, 6.0} and all(2 <= n <= 7 for n in q.values())
        for r in rows:
            assert (r["alpha"] is None) == (r["kind"] is None) == (r["mode"] != "p")
            assert (r["beta"] is None) == (r["mode"] != "q")
            assert (r["gamma"] is None) == (r["mode"] != "p" or r["kind"] != 2)
            assert r["delta"] is None


def test_repeatable_whatever_the_partitions(spark, design):
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "log_id string, part int").repartition(7)
    again = P.conditional_lhs(keys, SPACE, BRANCHES, n=90, seed=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, design.collect()))
    other = P.conditional_lhs(keys, SPACE, BRANCHES, n=90, seed=5)
    assert sorted(map(str, other.collect())) != sorted(map(str, design.collect()))


def test_strata_report(design):
    rows = P.strata(design, ["log_id", "part"], {"noise": SPACE["noise"]}, [({"mode": "p", "kind": 2}, {"gamma": BRANCHES[2][1]["gamma"]})]).where("log_id = 'a'").collect()
    assert sorted((r["branch"], r["stratum"], r["n"]) for r in rows) == [(0, i, 1) for i in range(90)] + [(1, i, 1) for i in range(10)]


def test_defaults_and_fixed_spaces(spark):
    one = spark.createDataFrame([("a",)], "log_id string")
    with pytest.raises(ValueError, match="no parameter can vary"):
        P.conditional_lhs(one, {"mode": ["x"]}, [({"mode": "y"}, {"k": [1, 2]})], n=5)
    rows = P.conditional_lhs(one, {"mode": ["x"]}, [({"mode": "x", "deep": 1}, {"k": [1, 2], "eps": 0.5})], n=6, defaults={"deep": True, "k": 9, "eps": 7}).collect()
    assert collections.Counter(r["k"] for r in rows) == {1.0: 3, 2.0: 3} and {r["eps"] for r in rows} == {0.5}
    rows = P.conditional_lhs(one, {"x": [0, 1]}, [({"x": 1}, {"k": [3]})], n=4, defaults={"k": 9}).collect()
    assert sorted((r["x"], r["k"]) for r in rows) == [(0.0, 9.0)] * 2 + [(1.0, 3.0)] * 2


def test_scales_and_bad_specs():
    assert P.dimension("population_size", {"type": "integer", "min": 10, "max": 1000}).log
    assert not P.dimension("population_size", {"type": "integer", "min": 0, "max": 1000}).log
    assert not P.dimension("population_size", {"type": "integer", "min": 10, "max": 1000, "scale": "linear"}).log
    for bad in ({"type": "text", "min": 1, "max": 2}, {"type": "float", "min": 3, "max": 2}, {"type": "float", "min": 0, "max": 2, "scale": "log"}, [], [1, "a"]):
        with pytest.raises(ValueError):
            P.dimension("d", bad)


def test_no_shuffle_beyond_the_designs(design, spark):
    """All windows of a branch go by the keys: one exchange for the distinct keys, whatever the number of parameters."""
    plan = P.conditional_lhs(spark.createDataFrame([(i,) for i in range(10)], "log long"), SPACE, BRANCHES, n=9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
