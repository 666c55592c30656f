import json

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import ingest as I


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, *rows):
        made = [{"log_id": log, "config_hash": config, "status": status, "metadata": {"timestamp_utc": at}} for log, config, status, at in rows]
        (tmp_path / "in" / name).write_text(json.dumps(made))

    return put, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "mark")


def rows(spark, table):
    return sorted((r["log_id"], r["config_hash"] or "", r["status"], r["batch_id"]) for r in I.read_ingested(spark, table).collect())


def test_first_arrival_counts(spark, place):
    put, src, table, mark = place
    assert I.read_ingested(spark, table) is None
    put("a.json", ("l", "x", "first", "2026-01-02T00:00:00Z"), ("l", "x", "later", "2026-01-03T00:00:00Z"), ("l", "y", "one", None))
    I.ingest(spark, src, table, mark).awaitTermination()
    assert rows(spark, table) == [("l", "x", "first", 0), ("l", "y", "one", 0)]
    # late by years, a known key, a key without a hash twice, a bad time
    put("b.json", ("l", "x", "late", "2001-01-01T00:00:00Z"), ("m", "x", "late", "2001-01-01T00:00:00Z"), ("m", None, "n1", "2026-01-01T00:00:00Z"), ("m", None, "n2", "x"))
    I.ingest(spark, src, table, mark).awaitTermination()
    assert rows(spark, table) == [("l", "x", "first", 0), ("l", "y", "one", 0), ("m", "", "n1", 1), ("m", "", "n2", 1), ("m", "x", "late", 1)]


def test_batch_that_failed_after_writing(spark, place, tmp_path):
    """The batch's rows are there but its commit is not: it runs again and nothing changes."""
    put, src, table, mark = place
    put("a.json", ("l", "x", "first", "2026-01-02T00:00:00Z"))
    I.ingest(spark, src, table, mark).awaitTermination()
    put("b.json", ("l", "x", "again", "2026-01-02T00:00:00Z"), ("l", "y", "new", "2026-01-02T00:00:00Z"))
    I.ingest(spark, src, table, mark).awaitTermination()
    before = rows(spark, table)
    for name in ("1", ".1.crc"):
        (tmp_path / "mark/commits" / name).unlink(missing_ok=True)
    I.ingest(spark, src, table, mark).awaitTermination()
    assert rows(spark, table) == before == [("l", "x", "first", 0), ("l", "y", "new", 1)]


def test_unfinished_batch_is_not_seen(spark, place, tmp_path):
    put, src, table, mark = place
    put("a.json", ("l", "x", "first", "2026-01-02T00:00:00Z"))
    I.ingest(spark, src, table, mark).awaitTermination()
    (tmp_path / "table/batch_id=1").mkdir()
    (tmp_path / "table/batch_id=1/part-0.parquet").write_text("half a file")
    assert rows(spark, table) == [("l", "x", "first", 0)]
    put("b.json", ("l", "y", "new", None))
    I.ingest(spark, src, table, mark).awaitTermination()
    assert rows(spark, table) == [("l", "x", "first", 0), ("l", "y", "new", 1)]


def test_upsert_twice(spark, tmp_path):
    table = str(tmp_path / "t")
    batch = spark.createDataFrame([("l", "x", 1), ("l", "x", 2), ("l", None, 3)], "log_id string, config_hash string, n int").withColumn("at", F.current_timestamp()).withColumn("source", F.col("n").cast("string"))
    for _ in range(2):
        I.upsert(batch, 0, table)
        assert sorted(r["n"] for r in I.read_ingested(spark, table).collect()) == [1, 3]
    I.upsert(batch.where("config_hash is not null"), 1, table)
    assert I.read_ingested(spark, table).count() == 2
