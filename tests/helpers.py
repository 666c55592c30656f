"""Hand-made logs, and Spark against DuckDB."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = datetime.datetime(2026, 1, 1, 9)


def make_log(spark, traces, log_id="l"):
    """A log from {case: activities}, one event a minute; an activity may be None."""
    rows = [(log_id, c, a, BASE + datetime.timedelta(minutes=i), i + 1) for c, t in traces.items() for i, a in enumerate(t)]
    return spark.createDataFrame(rows, "log_id string, case_id string, activity string, ts timestamp, event_index int")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def same_as_duckdb(spark, plan, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = plan(spark, sf_dir)
    cols = sorted(df.columns)
    found = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    wanted = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert found == wanted
