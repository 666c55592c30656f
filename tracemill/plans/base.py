"""A registry of queries: a name, a Spark plan, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources import views

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that engines agree."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def register(name: str, plan: Plan, sql: str | None = None, doubles: str = "") -> None:
    """``sql`` follows WITH and the views that it names; ``doubles`` lists its double columns."""
    QUERIES[name] = lambda spark, sf_dir: rounded(plan(spark, sf_dir))
    if sql is not None:
        head = [v for n, v in (("event_log", views.EVENT_LOG), ("lifecycle_log", views.LIFECYCLE_LOG), ("run_events", views.RUN_EVENTS), ("runs", views.RUNS)) if n in sql]
        body = sql.strip()
        recursive = body.upper().startswith("WITH RECURSIVE ")
        if recursive:
            body = "WITH " + body[15:]
        if body.upper().startswith("WITH "):
            head.append(body[5:].rsplit("\nSELECT ", 1)[0])
            body = "SELECT " + body.rsplit("\nSELECT ", 1)[1]
        if doubles:
            body = "SELECT * REPLACE (" + ", ".join(f'round(CAST("{d}" AS DOUBLE), 6) + 0.0 AS "{d}"' for d in doubles.split()) + f") FROM ({body})"
        ORACLES[name] = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(head) + "\n" if head else "") + body
