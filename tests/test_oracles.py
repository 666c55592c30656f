import datetime

import pytest

from tests.helpers import same_as_duckdb
from tracemill.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: One of each kind here; the driver compares all of them.
SOME = ["F1_case_features", "F3_variant_counts", "F9_flow_features", "F16_log_features", "Q3_lifecycle_pairs", "G1_filter_variant_coverage", "D10_repair_targets", "E7_aggregate_runs", "V13_oracle_ladder", "V20_regret_and_rank", "M10_best_train_config", "W7_sweep"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, name):
    same_as_duckdb(spark, QUERIES[name], ORACLES[name], SF)


def test_child_seeds_of_large_and_long_logs(spark, tmp_path):
    """A log of 10,000 cases is subsampled twice, one of 40 events a case is truncated: query and SQL alike."""
    day = datetime.datetime(2026, 1, 1)
    rows = [(i, day, 8 * i, "a") for i in range(10_000)] + [(20_000 + i, day + datetime.timedelta(minutes=i), 1, "b") for i in range(40)] + [(30_000, day, 2, "c")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "events.parquet").symlink_to(next((tmp_path / "t").glob("part-*.parquet")))
    found = {(r["parent"], r["log_id"].split("__")[1]) for r in QUERIES["G7_child_seeds"](spark, str(tmp_path)).collect()}
    assert found == {(p, t) for p in ("log0", "log1", "log2") for t in ("cov080", "sub050", "noise005")} | {("log0", "sub025"), ("log1", "trunc050")}
    same_as_duckdb(spark, QUERIES["G7_child_seeds"], ORACLES["G7_child_seeds"], str(tmp_path))


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
