"""What feature extraction takes for each log, next to the log's size."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_extraction(log: DataFrame, extract: Callable[[DataFrame], DataFrame], log_ids: list[str], repeats: int = 1) -> DataFrame:
    """log_id, n_events, n_cases, n_features, seconds, events_per_second for each of ``log_ids``.

    Every log is read and its features are worked out in a job of its own, as
    a user with one log would do. Events and cases come from one aggregate over
    the same rows, which is not timed. seconds is the best of ``repeats``. The
    driver loops over the given logs, which are a design; a log without events
    has counts of zero and no rate.
    """
    spark = log.sparkSession
    rows = []
    for log_id in log_ids:
        part = log.where(F.col("log_id") == log_id)
        size = part.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("cases")).first()
        features = extract(part)
        best = None
        for _ in range(repeats):
            began = time.perf_counter()
            features.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        width = len(features.columns) - 1 if size["events"] else 0
        rows.append((log_id, size["events"], size["cases"], width, best, size["events"] / best if size["events"] else None))
    return spark.createDataFrame(rows, "log_id string, n_events long, n_cases long, n_features int, seconds double, events_per_second double")
