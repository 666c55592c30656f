"""Forests with the spread of their trees, and surrogates of their own for groups of rows.

A forest gives every tree's prediction, not only the mean: the leaf that each
tree sends a row to comes from the model in one pass, and the leaves' values
are a table of bounded size (trees times leaves) that goes along with the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.evaluate import MEASURES
from tracemill.operators.models import imputation, impute, train_surrogate


def leaf_values(forest: Any) -> list[list[float]]:
    """The value of every leaf of every tree, leaves from left to right."""
    trees: list[list[float]] = []
    for line in forest.toDebugString.splitlines():
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
        elif "Predict:" in line:
            trees[-1].append(float(line.rsplit(":", 1)[1]))
    return trees


def tree_predictions(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """``rows`` with an array ``trees_<measure>`` of what each tree of the measure's forest predicts."""
    spark = rows.sparkSession
    for m, model in models.items():
        forest = model.stages[-1].copy().setLeafCol("_leaf")
        out = rows
        for stage in (*model.stages[:-1], forest):
            out = stage.transform(out)
        values = spark.createDataFrame([(leaf_values(forest),)], "_values array<array<double>>")
        at = F.transform(vector_to_array("_leaf"), lambda leaf, i: F.get(F.get(F.col("_values"), i), leaf.cast("int")))
        # one row, of trees * leaves numbers
        rows = out.crossJoin(F.broadcast(values)).select(*rows.columns, at.alias(f"trees_{m}"))
    return rows


def confidence(std: Column) -> Column:
    return F.when(std < 0.05, "high").when(std < 0.15, "medium").otherwise("low")


def _squares(mean: Column) -> Callable[[Column, Column], Column]:
    return lambda a, x: a + (x - mean) * (x - mean)


def blended(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``rows`` of ``tree_predictions`` with ``pred_<measure>``, ``std_<measure>``, ``composite``, ``std`` and ``confidence``.

    composite and std are the means of the measures' predictions and tree
    spreads by the weights (a total of zero counts as one), so a measure
    without weight adds nothing to either.
    """
    total = sum(weights.values()) or 1.0
    for m in MEASURES:
        t = F.col(f"trees_{m}")
        mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / F.size(t)
        rows = rows.withColumn(f"pred_{m}", mean)
        rows = rows.withColumn(f"std_{m}", F.sqrt(F.aggregate(t, F.lit(0.0), _squares(F.col(f"pred_{m}"))) / F.size(t)))
    mix = lambda of: sum((F.col(f"{of}_{m}") * float(w) for m, w in weights.items() if w), F.lit(0.0)) / total
    rows = rows.withColumns({"composite": mix("pred"), "std": mix("std")})
    return rows.withColumn("confidence", confidence(F.col("std"))).drop(*(f"trees_{m}" for m in MEASURES))


def recommend(models: dict[str, PipelineModel], configs: DataFrame, features: DataFrame, weights: dict[str, float], k: int = 10, medians: dict[str, float] | None = None) -> DataFrame:
    """The ``k`` known configurations of the highest predicted composite for every log of ``features``: log_id, rank, algorithm, config_hash, composite, std, confidence.

    ``configs`` has one row a configuration (config_hash): algorithm and
    parameters; it is broadcast where Spark finds it small. ``medians``
    fill nulls. Equal composites are ordered by config_hash.
    """
    pairs = features.crossJoin(configs.dropDuplicates(["config_hash"]))
    rows = blended(tree_predictions(models, impute(pairs, medians) if medians else pairs), weights)
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc(F.round("composite", 9)), "config_hash"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("log_id", "rank", "algorithm", "config_hash", "composite", "std", "confidence")


@dataclass
class Registry:
    """Fitted models by key; each is fitted once."""

    models: dict[Any, Any] = field(default_factory=dict)
    fits: list[Any] = field(default_factory=list)

    def get(self, key: Any, fit: Callable[[], Any]) -> Any:
        if key not in self.models:
            self.fits.append(key)
            self.models[key] = fit()
        return self.models[key]


def side_by_side(work: Iterable[Callable[[], Any]], threads: int = 4) -> list[Any]:
    """Results of driver functions that each start Spark jobs, several at a time so that small fits fill the cluster."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


@dataclass(frozen=True)
class GroupSurrogates:
    """Surrogates per (group, measure), with pooled ones for groups that have too few rows."""

    group: str
    columns: tuple[str, ...]
    own: dict[tuple[str, str], PipelineModel]
    pooled: dict[str, PipelineModel]
    medians: dict[str, dict[str, float]]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pred_<measure>`` in [0, 1] and ``by_<measure>``: ``own`` or ``pooled``. A row of an unknown or null group is pooled."""
        known = sorted({g for g, _ in self.own})
        name = F.col(self.group)
        parts = [(g, rows.where(name == g)) for g in known]
        parts.append((None, rows.where(name.isNull() | ~name.isin(*known)) if known else rows))
        out = None
        for g, part in parts:
            filled = impute(part, self.medians[g] if g is not None else self.medians[""])
            for m in MEASURES:
                model = self.own.get((g, m))
                filled = (model or self.pooled[m]).transform(filled.drop("_x", "_code")).drop("_x", "_code")
                filled = filled.withColumns({f"pred_{m}": F.least(F.greatest(f"pred_{m}", F.lit(0.0)), F.lit(1.0)), f"by_{m}": F.lit("own" if model else "pooled")})
            out = filled if out is None else out.unionByName(filled)
        return out


def train_by_group(train: DataFrame, columns: list[str], group: str = "algorithm", boosted: bool = True, trees: int = 50, depth: int = 5, least: int = 20, threads: int = 4) -> GroupSurrogates:
    """Boosted trees (or forests) per (group, measure) and pooled over all groups, where the group is one more input.

    A (group, measure) with fewer than ``least`` rows has no model of its own.
    Groups are a design of bounded number; their sizes and the medians come to
    the driver, rows don't. The fits run several at a time over one persisted
    copy of the rows, which is freed in the end.
    """
    train = train.persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {r[group]: r for r in train.where(F.col(group).isNotNull()).groupBy(group).agg(*(F.count(m).alias(m) for m in MEASURES)).collect()}
        medians = {"": imputation(train, columns)} | {g: imputation(train.where(F.col(group) == g), columns) for g in sizes}
        fit = lambda rows, m: train_surrogate(rows, columns, trees=trees, depth=depth, boosted=boosted, measures=(m,))[m]
        keys: list[tuple[str | None, str]] = [(None, m) for m in MEASURES] + [(g, m) for g, r in sorted(sizes.items()) for m in MEASURES if r[m] >= least]
        rows = {g: impute(train if g is None else train.where(F.col(group) == g), medians["" if g is None else g]) for g, _ in keys}
        fitted = side_by_side([lambda g=g, m=m: fit(rows[g], m) for g, m in keys], threads)
    finally:
        train.unpersist()
    found = dict(zip(keys, fitted))
    return GroupSurrogates(group, tuple(columns), {k: v for k, v in found.items() if k[0] is not None}, {m: found[None, m] for m in MEASURES}, medians)
