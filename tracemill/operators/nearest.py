"""Distances between many points, block by block: exact, without a broadcast that grows or a pair that is a row.

Points are put in blocks along a Z-order curve, so that a block lies together.
Of two blocks only their boxes decide whether they meet; blocks that meet are
compared in one task with arrays of bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.sources.scratch import scratch

#: Points of a block, about; boxes of a box of boxes.
BLOCK, BOXES = 2048, 64


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor costs a file read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def z_order(axes: list[str], low: dict[str, float], high: dict[str, float]) -> Column:
    """Place on the Z-order curve over the box from ``low`` to ``high``, with as many bits an axis as 60 allow."""
    axes = axes[:60]
    bits = 60 // len(axes)
    cells = []
    for a in axes:
        width = high[a] - low[a]
        cell = F.floor((F.col(a) - low[a]) / width * (1 << bits)) if width > 0 else F.lit(0)
        cells.append(F.least(F.greatest(cell.cast("long"), F.lit(0)), F.lit((1 << bits) - 1)))
    parts = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("long"), b * len(axes) + i) for i, c in enumerate(cells) for b in range(bits)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def blocked(points: DataFrame, axes: list[str], key: str, rows: int = BLOCK) -> DataFrame:
    """``points`` (key, axes) with their block, written: ranges of the curve, equal places apart by key."""
    extent = points.agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))).first()
    if not extent["n"]:
        return points.select(key, *axes, F.lit(0).alias("block"))
    low, high = ({a: extent[f"{n}_{a}"] for a in axes} for n in ("low", "high"))
    placed = points.select(key, *axes).withColumn("_z", z_order(axes, low, high))
    parts = -(-extent["n"] // rows)
    return written(placed.repartitionByRange(parts, "_z", key).select(key, *axes, F.spark_partition_id().alias("block")))


def boxes(points: DataFrame, axes: list[str], by: str = "block") -> DataFrame:
    return points.groupBy(by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))))


def _gap(axes: list[str], x: str, y: str) -> Column:
    """Square of the least distance between two boxes."""
    one = lambda a: F.greatest(F.col(f"{x}.low_{a}") - F.col(f"{y}.high_{a}"), F.col(f"{y}.low_{a}") - F.col(f"{x}.high_{a}"), F.lit(0.0))
    return sum((one(a) * one(a) for a in axes), F.lit(0.0))


def _reach(axes: list[str], x: str, y: str) -> Column:
    """Square of the greatest distance between two boxes."""
    one = lambda a: F.greatest(F.col(f"{x}.high_{a}") - F.col(f"{y}.low_{a}"), F.col(f"{y}.high_{a}") - F.col(f"{x}.low_{a}"))
    return sum((one(a) * one(a) for a in axes), F.lit(0.0))


def _meeting(x: DataFrame, y: DataFrame, axes: list[str], on: Column | None = None) -> DataFrame:
    """(x.block, y.block) whose boxes may hold a nearest pair: no farther apart than the reach of x's best y.

    Some point of the y with the least reach is within that reach of every
    point of x, so nothing beyond it is nearest.
    """
    both = x.alias("x").join(y.alias("y"), on) if on is not None else x.alias("x").crossJoin(y.alias("y"))
    both = both.select(F.col("x.block").alias("p"), F.col("y.block").alias("q"), _gap(axes, "x", "y").alias("gap"), _reach(axes, "x", "y").alias("reach"))
    best = both.groupBy("p").agg(F.min("reach").alias("best"))
    # a hair's breadth for rounding
    return both.join(best, "p").where(F.col("gap") <= F.col("best") * (1 + 1e-9)).select("p", "q")


def nearest(points: DataFrame, reference: DataFrame, axes: list[str], key: str, rows: int = BLOCK) -> DataFrame:
    """(key, d): the Euclidean distance of every point to the nearest reference point; no row for any if there is none.

    Keys are distinct, axes are not null. Boxes of blocks are compared in two
    levels: boxes of 64 boxes first, then what is in those that may meet.
    """
    p = blocked(points, axes, key, rows)
    q = blocked(reference.select(F.monotonically_increasing_id().alias("_r"), *axes), axes, "_r", rows)
    bp, bq = (written(boxes(t, axes).withColumn("outer", F.floor(F.col("block") / BOXES).cast("int"))) for t in (p, q))
    far = _meeting(_outer(bp, axes), _outer(bq, axes), axes).toDF("po", "qo")
    x = bp.join(far, bp["outer"] == far["po"])
    meet = _meeting(x, bq.withColumnRenamed("outer", "own"), axes, F.col("x.qo") == F.col("y.own"))
    meet = written(meet)
    names = [key, *axes]

    def tile(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        x = np.stack([group.column(a).to_numpy() for a in axes], axis=1)
        mine, there = x[side == 0], x[side == 1]
        best = np.full(len(mine), np.inf)
        for i in range(0, len(there), 256):
            part = mine[:, None, :] - there[None, i : i + 256, :]
            np.minimum(best, np.sqrt((part * part).sum(axis=2)).min(axis=1), out=best)
        return pa.table({key: group.column(key).filter(pa.array(side == 0)), "d": pa.array(best)})

    left = meet.join(p, meet["p"] == p["block"]).select("p", "q", F.lit(0).alias("side"), *names)
    right = meet.join(q, meet["q"] == q["block"]).select("p", "q", F.lit(1).alias("side"), F.lit(None).cast(p.schema[key].dataType).alias(key), *axes)
    found = left.union(right).groupBy("p", "q").applyInArrow(tile, f"`{key}` {p.schema[key].dataType.simpleString()}, d double")
    return found.groupBy(key).agg(F.min("d").alias("d"))


def _outer(inner: DataFrame, axes: list[str]) -> DataFrame:
    """Boxes around the boxes of each ``outer``."""
    return inner.groupBy("outer").agg(*(f(f"{n}_{a}").alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))).withColumnRenamed("outer", "block")


def pair_distances(vectors: DataFrame, key: str, n: int, rows: int = BLOCK) -> DataFrame:
    """(key, total, near): for every vector (key, x) the sum of its distances to all others and the least of them (null if alone).

    ``n`` is the number of vectors. They are dealt into blocks by hash; two
    blocks are a task that gives one row for each of its vectors.
    """
    parts = max(1, -(-n // rows))
    block = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    dealt = vectors.select(F.col(key), "x", block.alias("b")).select(key, "x", "b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o"))
    tiles = dealt.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", key, "x")

    def tile(group: pa.Table) -> pa.Table:
        b, i, j = (group.column(c).to_numpy() for c in ("b", "i", "j"))
        x = np.array(group.column("x").to_pylist(), float).reshape(group.num_rows, -1)
        total, near = np.zeros(len(x)), np.full(len(x), np.inf)
        same = i[0] == j[0]
        sides = (np.flatnonzero(b == i[0]), np.flatnonzero(b == j[0]))
        for mine, there in (sides,) if same else (sides, sides[::-1]):
            for k in range(0, len(mine), 64):
                at = mine[k : k + 64]
                part = x[at, None, :] - x[None, there, :]
                d = np.sqrt((part * part).sum(axis=2))
                total[at] += d.sum(axis=1)
                if same:
                    d[at[:, None] == there[None, :]] = np.inf
                if len(there):
                    near[at] = np.minimum(near[at], d.min(axis=1))
        return pa.table({key: group.column(key), "total": pa.array(total), "near": pa.array(near)})

    kind = vectors.schema[key].dataType.simpleString()
    found = tiles.groupBy("i", "j").applyInArrow(tile, f"`{key}` {kind}, total double, near double")
    near = F.min("near")
    return found.groupBy(key).agg(F.sum("total").alias("total"), F.when(near < float("inf"), near).alias("near"))
