"""Aggregates that several operators share, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(n: str) -> Column:
    """Base-2 entropy of the positive counts in column ``n``; null if there is none."""
    c = F.when(F.col(n) > 0, F.col(n).cast("double"))
    total = F.sum(c)
    return F.when(total.isNotNull(), F.greatest(F.log2(total) - F.sum(c * F.log2(c)) / total, F.lit(0.0)))


def composite(weights: dict[str, float], measures: dict[str, str] | None = None) -> Column:
    """Weighted mean of the measure columns; a weight total of zero counts as one."""
    names = measures or {m: m for m in weights}
    total = sum(weights.values()) or 1.0
    out = F.lit(0.0)
    for m, w in weights.items():
        out = out + F.lit(float(w)) * F.col(names[m])
    return out / F.lit(float(total))


def quantiles(df: DataFrame, keys: list[str], col: str, prefix: str) -> DataFrame:
    """min, max, mean, median, std, variance, q1, q3, iqr, p90 of ``col`` per key (population moments)."""
    p = F.percentile(col, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
    out = df.groupBy(*keys).agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b"), F.avg(col).alias("m"), F.stddev_pop(col).alias("s"), F.var_pop(col).alias("v"), p.alias("p"))
    return out.select(
        *keys,
        F.col("a").alias(f"{prefix}_min"),
        F.col("b").alias(f"{prefix}_max"),
        F.col("m").alias(f"{prefix}_mean"),
        F.col("p")[1].alias(f"{prefix}_median"),
        F.col("s").alias(f"{prefix}_std"),
        F.col("v").alias(f"{prefix}_variance"),
        F.col("p")[0].alias(f"{prefix}_q1"),
        F.col("p")[2].alias(f"{prefix}_q3"),
        (F.col("p")[2] - F.col("p")[0]).alias(f"{prefix}_iqr"),
        F.col("p")[3].alias(f"{prefix}_p90_custom"),
    )


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) drawn from the hash of the keys."""
    cols = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))
