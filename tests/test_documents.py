"""XES documents, metadata and timing."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import make_log
from tracemill.operators import metadata, timing
from tracemill.operators.features import six_axes
from tracemill.sources import logs
from tracemill.sources import xes_document as X

HEADERS = [("l", "extension", "Time", "time", "u?a=1&b=2"), ("l", "classifier", "k", "event", "concept:name lifecycle:transition"), ("l", "global", "org", "trace", '"<none>"'), ("l", "global", "cost", "trace", "0")]


@pytest.mark.parametrize("files", [1, 3])
def test_document_round_trip(spark, tmp_path, files):
    log = make_log(spark, {"c1": ["a<b", None, 'say "x" & y'], "c2": ["\x01z", "b"], "c 3": ["a"]}).withColumn("lifecycle", F.when(F.col("event_index") == 1, "start"))
    log = log.withColumn("ts", F.when(F.col("event_index") == 3, None).otherwise(F.col("ts")))
    path = str(tmp_path / "x")
    X.write_document(log, path, spark.createDataFrame(HEADERS, X.HEADER), lifecycle="keep", files=files)
    events, cases = logs.read_xes(spark, path + "/*/*/*")
    found = sorted((r["case_id"], r["event_index"], r["activity"], r["lifecycle"], r["ts"]) for r in events.collect())
    wanted = sorted((r["case_id"], r["event_index"], r["activity"] and r["activity"].replace("\x01", "�"), r["lifecycle"], r["ts"]) for r in log.collect())
    assert found == wanted and cases.count() == 3
    table = {tuple(r) for r in X.header_table(spark, path + "/*/*/*").collect()}
    assert {t for t in table if t[1] in ("extension", "classifier", "global")} == set(HEADERS)
    assert {t[2] for t in table if t[1] == "event"} == {"concept:name", "time:timestamp", "lifecycle:transition"}
    assert len(list((tmp_path / "x").glob("*/*/part*"))) == files


def test_complete_lifecycle_and_no_headers(spark, tmp_path):
    log = make_log(spark, {"c": "ab"}, "odd=id +1")
    X.write_document(log, str(tmp_path / "x"))
    assert {r["lifecycle"] for r in logs.read_xes(spark, str(tmp_path / "x/*/*/*"))[0].collect()} == {"complete"}
    assert {r["log_id"] for r in X.header_table(spark, str(tmp_path / "x/*/*/*")).collect()} == {"odd=id +1"}
    with pytest.raises(ValueError, match="complete or keep"):
        X.write_document(log, str(tmp_path / "y"), lifecycle="start")


def test_headers_of_plain_files(spark, tmp_path):
    (tmp_path / "tiny.xes").write_text('<log><extension name="T" prefix="t" uri="u"/><classifier name="k" keys="a   b"/><global scope="event"><int key="n" value="3"/></global><trace><int key="w" value="1"/><event><boolean key="f" value="true"/></event></trace></log>')
    assert {tuple(r) for r in X.header_table(spark, str(tmp_path / "tiny.xes")).collect()} == {("tiny", "extension", "T", "t", "u"), ("tiny", "classifier", "k", None, "a b"), ("tiny", "global", "n", "event", "3"), ("tiny", "trace", "w", None, None), ("tiny", "event", "f", None, None)}


def flat(value, path):
    for k, v in value.items():
        if isinstance(v, dict):
            yield from flat(v, f"{path}_{k}")
        elif not isinstance(v, list):
            yield f"{path}_{k}", v


DEEP = {"a": 1, "b": {"c": "x<y>", "d": {"e": None, "f": True, "g": {"h": {"i": {"j": "deep"}}}, "list": [{"k": 1}]}}, "k`<": {"m.n": -2.5}, "none": {}}


def test_json_of_unknown_depth(spark):
    rows = [(1, json.dumps(DEEP)), (2, "[1]"), (3, None), (4, "{bad"), (5, '"text"'), (6, "{}"), (7, '{"x": 5}')]
    out = metadata.flatten_json(spark.createDataFrame(rows, "id int, j string"), ["id"], "j", "p").collect()
    found = {(r["id"], r["path"]): (r["value"], r["kind"]) for r in out}
    kinds = {bool: "boolean", str: "string", int: "number", float: "number", type(None): "null"}
    wanted = {(1, p): (None if v is None else str(v).lower() if isinstance(v, bool) else str(v), kinds[type(v)]) for p, v in flat(DEEP, "p")}
    assert found == wanted | {(7, "p_x"): ("5", "number")} and len(out) == len(found)


def test_metadata_has_no_shuffle(spark):
    rows = spark.createDataFrame([("e", '{"timings": {"t": {"u": 1}}, "memory": 3, "other": {"x": 1}}', '{"q": {"r": "s"}}')], "id string, metadata string, source_metadata string")
    out = metadata.flatten_metadata(rows, ["id"])
    assert sorted((r["path"], r["value"]) for r in out.collect()) == [("source_q_r", "s"), ("timing_t_u", "1")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_metadata_of_grouped_results_is_parsed_after_the_grouping(spark):
    """Texts made of grouping keys: a filter on them must not go below the grouping, and the source is read once."""
    many = spark.range(2000).selectExpr("cast(id % 2 as string) k", "id").groupBy("k").agg({"id": "sum"})
    rows = many.selectExpr("k as id", "concat('{\"timings\": {\"t\": ', `sum(id)`, '}}') as metadata", "concat('{\"q\": \"', k, '\"}') as source_metadata")
    out = metadata.flatten_metadata(rows, ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Relation") == 1
    assert sorted((r["id"], r["path"], r["value"]) for r in out.collect()) == [("0", "source_q", "0"), ("0", "timing_t", "999000"), ("1", "source_q", "1"), ("1", "timing_t", "1000000")]


def test_time_extraction(spark):
    log = make_log(spark, {"c1": "abc", "c2": "ab"}).unionByName(make_log(spark, {"d": "x"}, "m"))
    rows = {r["log_id"]: r for r in timing.time_extraction(log, six_axes, ["l", "m", "none"], repeats=2).collect()}
    assert [(rows[k]["n_events"], rows[k]["n_cases"], rows[k]["n_features"]) for k in ("l", "m", "none")] == [(5, 2, 6), (1, 1, 6), (0, 0, 0)]
    assert all(r["seconds"] > 0 for r in rows.values()) and rows["none"]["events_per_second"] is None


def test_long_case_in_order(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    log = spark.createDataFrame([("l", "c", f"a{i % 7}", base, i + 1) for i in range(3000)], "log_id string, case_id string, activity string, ts timestamp, event_index int")
    X.write_document(log, str(tmp_path / "x"))
    assert [r["activity"] for r in logs.read_xes(spark, str(tmp_path / "x/*/*/*"))[0].orderBy("event_index").collect()] == [f"a{i % 7}" for i in range(3000)]
