"""The six-axis feature space: design, repair, attainment, acceptance and coverage of target points."""

from __future__ import annotations

import math
from typing import Any

import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import uniform
from tracemill.operators.nearest import blocked, nearest, pair_distances, written

# Fixed values of the design.
AXES = ("num_traces", "avg_trace_length", "num_activities", "variant_ratio", "dfg_density", "repetition_prevalence")
LOG_AXES = frozenset(AXES[:3])
IN_DISTRIBUTION, EXPANSION, NEAR_DUPLICATE = 1.5, 3.0, 0.15
TOLERANCES = {"num_traces": 0.30, "avg_trace_length": 0.30, "num_activities": 0.30, "variant_ratio": 0.25}
MAX_TRACE_LENGTH = 5000
#: Reference points up to this number are broadcast.
SMALL = 10_000
BAND_SHARES = (("in_distribution", 0.7), ("expansion", 0.2), ("stress", 0.1))


def to_target(points: DataFrame) -> DataFrame:
    """Three axes in log10 (floor 1e-9), three clipped to [0, 1]; other columns stay."""
    return points.withColumns({a: F.log10(F.greatest(F.col(a), F.lit(1e-9))) if a in LOG_AXES else F.least(F.greatest(F.col(a), F.lit(0.0)), F.lit(1.0)) for a in AXES})


def from_target(points: DataFrame) -> DataFrame:
    return points.withColumns({a: F.pow(F.lit(10.0), F.col(a)) if a in LOG_AXES else F.least(F.greatest(F.col(a), F.lit(0.0)), F.lit(1.0)) for a in AXES})


def real_anchor(real: DataFrame) -> DataFrame:
    """One row: mean and population std of every axis in target space (a std below 1e-9 counts as 1)."""
    t = to_target(real)
    std = lambda a: F.when(F.stddev_pop(a) < 1e-9, 1.0).otherwise(F.stddev_pop(a))
    return t.agg(*(F.avg(a).alias(f"mean_{a}") for a in AXES), *(std(a).alias(f"std_{a}") for a in AXES))


def standardize(points: DataFrame, anchor: DataFrame) -> DataFrame:
    """Points in target space as standard deviations from the anchor, which is one row."""
    drop = [c for c in anchor.columns]
    return to_target(points).crossJoin(F.broadcast(anchor)).withColumns({a: (F.col(a) - F.col(f"mean_{a}")) / F.col(f"std_{a}") for a in AXES}).drop(*drop)


def distance(prefix: str) -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(f"{prefix}{a}")) ** 2 for a in AXES), F.lit(0.0)))


def nearest_distance(points: DataFrame, reference: DataFrame, key: str = "point_id") -> DataFrame:
    """Distance of every point to the nearest reference point (both standardized); infinite without any.

    A reference of up to SMALL rows, which is counted first, is broadcast; a
    larger one is compared block by block, with boxes that rule blocks out.
    """
    reference = reference.dropna(subset=list(AXES))
    if reference.limit(SMALL + 1).count() <= SMALL:
        ref = F.broadcast(reference.select(*(F.col(a).alias(f"r_{a}") for a in AXES)))
        near = points.crossJoin(ref).groupBy(key).agg(F.min(distance("r_")).alias("d"))
    else:
        near = nearest(points.dropna(subset=list(AXES)), reference, list(AXES), key)
    return points.join(near, key, "left").select(*points.columns, F.coalesce("d", F.lit(float("inf"))).alias("nearest_real_distance"))


def band(d: Column) -> Column:
    return F.when(d <= IN_DISTRIBUTION, "in_distribution").when(d <= EXPANSION, "expansion").otherwise("stress")


def design_bounds(real: DataFrame, low: dict[str, float] | None = None, high: dict[str, float] | None = None, expansion: float = 0.12) -> DataFrame:
    """(axis, low, high) of the real logs' box in target space, widened and capped."""
    t = to_target(real)
    both = t.agg(*(F.min(a).alias(f"lo_{a}") for a in AXES), *(F.max(a).alias(f"hi_{a}") for a in AXES))
    out = None
    for a in AXES:
        span = F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-6))
        lo, hi = F.col(f"lo_{a}") - expansion * span, F.col(f"hi_{a}") + expansion * span
        cap = (lambda v: math.log10(v)) if a in LOG_AXES else (lambda v: v)
        if low and a in low:
            lo = F.greatest(lo, F.lit(cap(low[a])))
        if high and a in high:
            hi = F.least(hi, F.lit(cap(high[a])))
        if a not in LOG_AXES:
            lo, hi = F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))
        row = both.select(F.lit(a).alias("axis"), lo.alias("low"), F.greatest(hi, lo + 1e-6).alias("high"))
        out = row if out is None else out.union(row)
    return out


def _long(points: DataFrame, key: str) -> DataFrame:
    return points.unpivot([key], list(AXES), "axis", "value")


def pairwise_coverage(points: DataFrame, bounds: DataFrame, key: str = "point_id", bins: int = 3) -> DataFrame:
    """(axis_a, axis_b, occupied) over all axis pairs; points outside land in the edge bins."""
    cell = F.floor((F.col("value") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) * bins)
    binned = _long(to_target(points), key).join(F.broadcast(bounds), "axis").select(key, "axis", F.least(F.greatest(cell, F.lit(0)), F.lit(bins - 1)).alias("bin"))
    # at most six rows per point meet here
    a = binned.select(key, F.col("axis").alias("axis_a"), F.col("bin").alias("x"))
    b = binned.select(key, F.col("axis").alias("axis_b"), F.col("bin").alias("y"))
    return a.join(b, key).where("axis_a < axis_b").groupBy("axis_a", "axis_b").agg(F.count_distinct("x", "y").alias("occupied"))


def coverage_holes(points: DataFrame) -> DataFrame:
    """How many real and generated logs (column ``population``) fill five named holes."""
    holes = {
        "mid_activity_vocabulary": F.col("num_activities").between(20, 120),
        "medium_variant_ratio": F.col("variant_ratio").between(0.25, 0.6),
        "large_with_diversity": (F.col("num_traces") > 5000) & (F.col("num_activities") > 20),
        "long_nontrivial": (F.col("avg_trace_length") > 30) & (F.col("variant_ratio") > 0.2),
        "dense_dfg": F.col("dfg_density") > 0.3,
    }
    real = F.col("population") == "real"
    one = points.agg(*(F.count_if(c & real).alias(f"real__{n}") for n, c in holes.items()), *(F.count_if(c & ~real).alias(f"generated__{n}") for n, c in holes.items()))
    kv = F.explode(F.array(*(F.struct(F.lit(n).alias("hole"), F.col(f"real__{n}").alias("real"), F.col(f"generated__{n}").alias("generated")) for n in holes)))
    return one.select(kv.alias("r")).select("r.*")


def lhs_points(bounds: DataFrame, n: int, seed: int, anchor: DataFrame | None = None, real: DataFrame | None = None) -> DataFrame:
    """``n`` points with one draw per stratum and axis, ranked by hash; with an anchor, picked from a fourfold pool by band shares."""
    pool = 4 * n if anchor is not None else n
    spark = bounds.sparkSession
    cells = spark.range(pool).crossJoin(F.broadcast(bounds))
    rank = F.row_number().over(Window.partitionBy("axis").orderBy(F.xxhash64(F.lit(seed), "axis", "id")))
    value = F.col("low") + (rank - 1 + uniform(seed + 1, "axis", "id")) / pool * (F.col("high") - F.col("low"))
    wide = cells.withColumn("value", value).groupBy(F.col("id").alias("point_id")).pivot("axis", list(AXES)).agg(F.first("value"))
    raw = from_target(wide)
    if anchor is None:
        return raw
    scored = nearest_distance(standardize(raw, anchor), standardize(real, anchor)).select("point_id", band(F.col("nearest_real_distance")).alias("band"))
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "point_id")))
    quota = F.lit(0)
    for b, share in BAND_SHARES:
        quota = F.when(F.col("band") == b, math.ceil(share * n)).otherwise(quota)
    first = scored.withColumn("place", place).withColumn("over", place > quota)
    keep = first.withColumn("r", F.row_number().over(Window.orderBy("over", "place", "point_id"))).where(F.col("r") <= n)  # a pool of 4 n design points
    return raw.join(keep.select("point_id", "band"), "point_id")


def jitter_points(real: DataFrame, bounds: DataFrame, n: int, scale: float, seed: int) -> DataFrame:
    """``n`` points near real logs: a hash pick of a base row, Gaussian noise per axis, clipped to the bounds."""
    base = to_target(real).select(*AXES)
    ranked = base.withColumn("k", F.row_number().over(Window.orderBy(*AXES)) - 1)  # the real logs are a design of bounded size
    count = ranked.agg(F.count("*").alias("m"))
    draws = real.sparkSession.range(n).withColumnRenamed("id", "point_id").crossJoin(F.broadcast(count)).withColumn("k", F.floor(uniform(seed, "point_id") * F.col("m")).cast("int"))
    long = _long(draws.join(ranked, "k").select("point_id", *AXES), "point_id").join(F.broadcast(bounds), "axis")
    u, v = uniform(seed + 1, "point_id", "axis"), uniform(seed + 2, "point_id", "axis")
    noise = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    moved = F.least(F.greatest(F.col("value") + noise * scale * (F.col("high") - F.col("low")), F.col("low")), F.col("high"))
    return from_target(long.withColumn("value", moved).groupBy("point_id").pivot("axis", list(AXES)).agg(F.first("value")))


def repair_targets(points: DataFrame, low: dict[str, float], high: dict[str, float], max_events: float = 2_000_000.0) -> DataFrame:
    """Impossible or useless targets mended in fixed order; ``repairs`` names what was changed, ``feasible`` tells if that helped."""
    out = points.withColumn("repairs", F.array().cast("array<string>")).withColumn("feasible", F.lit(True))

    def change(df: DataFrame, axis: str, new: Column, when: Column, why: str) -> DataFrame:
        hit = F.col("feasible") & F.coalesce(when, F.lit(False))
        return df.withColumn("repairs", F.when(hit, F.concat("repairs", F.array(F.lit(f"{axis}:{why}")))).otherwise(F.col("repairs"))).withColumn(axis, F.when(hit, new).otherwise(F.col(axis)))

    for a in AXES:
        lo, hi = low.get(a, 0.0), high.get(a, 1.0 if a not in LOG_AXES else float("inf"))
        clipped = F.least(F.greatest(F.col(a), F.lit(lo)), F.lit(hi))
        out = change(out, a, clipped, clipped != F.col(a), "cap")
    for a in ("num_traces", "num_activities"):
        out = out.withColumn(a, F.bround(a))
    fewer = F.greatest(F.lit(low.get("num_traces", 10.0)), F.bround(F.lit(max_events) / F.col("avg_trace_length")))
    out = change(out, "num_traces", fewer, F.col("num_traces") * F.col("avg_trace_length") > max_events, "events cap")
    least = 2.0 / F.col("num_traces")
    out = change(out, "variant_ratio", least, F.col("variant_ratio") < least, "min variants")
    room = F.col("avg_trace_length") * F.log10(F.greatest(F.col("num_activities"), F.lit(2.0)))
    need = F.log10(F.greatest(F.col("variant_ratio") * F.col("num_traces"), F.lit(1e-9)))
    reach = 0.9 * F.pow(F.lit(10.0), F.least(room, F.lit(12.0))) / F.col("num_traces")
    reach = F.least(F.greatest(reach, 1.0 / F.col("num_traces")), F.lit(1.0))
    tight = need > room + math.log10(0.9)
    out = out.withColumn("feasible", ~(tight & (reach < 0.01)))
    out = change(out, "variant_ratio", reach, tight, "expressibility")
    out = change(out, "dfg_density", F.lit(0.6), (F.col("dfg_density") > 0.6) & (F.col("num_activities") > 50) & (F.col("band") != "stress"), "spaghetti guard")
    out = change(out, "repetition_prevalence", F.lit(0.3), (F.col("avg_trace_length") < 3.0) & (F.col("repetition_prevalence") > 0.3), "short traces")
    return out.withColumn("repairs", F.array_join("repairs", "; "))


def attainment_error(targets: DataFrame, achieved: DataFrame, key: str = "point_id") -> DataFrame:
    """Absolute error per axis in target space, and the largest error over tolerance of the enforced axes."""
    a = to_target(targets).select(key, *(F.col(x).alias(f"t_{x}") for x in AXES))
    b = to_target(achieved).select(key, *AXES)
    j = a.join(b, key).select(key, *(F.abs(F.col(x) - F.col(f"t_{x}")).alias(f"error_{x}") for x in AXES))
    return j.withColumn("attainment_error", F.greatest(*(F.col(f"error_{x}") / t for x, t in TOLERANCES.items())))


def acceptance(records: DataFrame, max_events: float = 2_000_000.0, duplicates: bool = True) -> DataFrame:
    """``rejection_reason``: the first rule that a generated log breaks with its figures, or null. Without ``duplicates`` that rule is left out.

    The worst axis is named where the records have the axes' errors (``error_*``).
    """
    c = F.col
    missing = F.concat_ws(", ", *(F.when(c(a).isNull() | F.isnan(a), a) for a in AXES))
    poor = F.lit("target attainment too poor")
    if all(f"error_{a}" in records.columns for a in TOLERANCES):
        off = F.array_max(F.array(*(F.struct((c(f"error_{a}") / t).alias("share"), F.lit(-i).alias("first"), F.lit(a).alias("axis"), c(f"error_{a}").alias("error")) for i, (a, t) in enumerate(TOLERANCES.items()))))
        poor = F.concat(poor, F.lit(": "), off["axis"], F.lit(" off by "), F.format_string("%.3f", off["error"]))
    text = lambda what, n, least: F.concat(F.lit(f"too few {what}: "), n.cast("string"), F.lit(f" < {least}"))
    unknown = F.lit(False)
    for a in AXES:
        unknown = unknown | c(a).isNull() | F.isnan(a)
    reason = (
        F.when(c("n_traces") < 10, text("traces", c("n_traces"), 10))
        .when(c("n_activities") < 3, text("activities", c("n_activities"), 3))
        .when(c("n_variants") < 2, text("variants", c("n_variants"), 2))
        .when(c("min_trace_length").isNull() | (c("min_trace_length") < 1), "log contains empty or unmeasurable traces")
        .when(unknown, F.concat(F.lit("target axis features not computable: "), missing))
        .when(c("n_events") > 1.5 * max_events, F.concat(F.lit("pathological size: "), c("n_events").cast("long").cast("string"), F.lit(" events exceeds compute cap")))
        .when(c("max_trace_length") > MAX_TRACE_LENGTH, F.concat(F.lit("pathological trace length: "), F.format_string("%.0f", c("max_trace_length").cast("double")), F.lit(f" > {MAX_TRACE_LENGTH}")))
        .when(c("attainment_error") > 1.0, poor)
    )
    if duplicates:
        near = F.concat(F.lit("near-duplicate of a real or accepted log (standardized distance "), F.format_string("%.3f", c("duplicate_distance")), F.lit(")"))
        reason = reason.when(c("duplicate_distance") < NEAR_DUPLICATE, near)
    return records.withColumn("rejection_reason", reason)


def _settle(group: pa.Table) -> pa.Table:
    """(p, kept) for the points of a block that can be decided in id order: see ``near_duplicate_dedup``."""
    earlier: dict[Any, list[tuple[Any, bool | None]]] = {}
    for p, e, kept in zip(*(group.column(c).to_pylist() for c in ("p", "e", "kept"))):
        earlier.setdefault(p, []).append((e, kept))
    state: dict[Any, bool | None] = {}
    for p in sorted(earlier):
        seen = [state[e] if e in state else kept for e, kept in earlier[p]]
        state[p] = False if any(seen) else True if all(k is False for k in seen) else None
    done = [(p, k) for p, k in state.items() if k is not None]
    return pa.table({"p": pa.array([p for p, _ in done], group.schema.field("p").type), "kept": pa.array([k for _, k in done], pa.bool_())})


def near_duplicate_dedup(points: DataFrame, real: DataFrame, key: str = "point_id", rows: int = 2048) -> DataFrame:
    """In id order a point is kept if it is far from all real and all earlier kept points (standardized input).

    Points lie in blocks of about ``rows`` neighbours. A task goes through the
    undecided points of a block in id order and decides every one whose earlier
    close neighbours are decided, those of its own block in the same walk; only
    what waits for another block takes a further round. That gives the
    sequential result exactly: the first undecided point is always decided, so
    the rounds end.
    """
    far = nearest_distance(points, real, key).where(F.col("nearest_real_distance") >= NEAR_DUPLICATE).drop("nearest_real_distance")
    far = written(far.select(key, *AXES))
    # only points of neighbouring grid cells can be close: cells are as wide as the limit on the first two axes
    cell = far.withColumn("cx", F.floor(F.col(AXES[0]) / NEAR_DUPLICATE)).withColumn("cy", F.floor(F.col(AXES[1]) / NEAR_DUPLICATE))
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    around = cell.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(F.col(key).alias("e"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), *(F.col(a).alias(f"r_{a}") for a in AXES))
    edges = cell.join(around, ["cx", "cy"]).where(F.col("e") < F.col(key)).where(distance("r_") < NEAR_DUPLICATE).select(F.col(key).alias("p"), "e")
    place = blocked(far, list(AXES), key, rows).select(F.col(key).alias("p"), "block")
    edges = written(edges.join(place, "p"))
    waits = edges.select("p").distinct().withColumn("waits", F.lit(True))
    state = written(far.select(F.col(key).alias("p")).join(waits, "p", "left").select("p", F.when(F.col("waits").isNull(), True).alias("kept")))
    kind = far.schema[key].dataType.simpleString()
    while state.where("kept is null").limit(1).count():
        waiting = edges.join(state.where("kept is null").select("p"), "p", "left_semi")
        told = waiting.join(state.select(F.col("p").alias("e"), "kept"), "e").select("block", "p", "e", "kept")
        found = told.groupBy("block").applyInArrow(_settle, f"p {kind}, kept boolean")
        state = written(state.join(found.withColumnRenamed("kept", "now"), "p", "left").select("p", F.coalesce("kept", "now").alias("kept")))
    return points.join(state.where("kept").select(F.col("p").alias(key)), key, "left_semi")


def dispersion(features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean pairwise distance, mean nearest distance and total variance of z-scored features (constant ones dropped, nulls mean-filled).

    All pairs are the measure itself; they are summed up in tiles of two blocks
    of logs, and none is a row. Statistics of the columns are broadcast, a row each.
    """
    long = features.unpivot([key], columns, "f", "v")
    m = long.groupBy("f").agg(F.avg("v").alias("mean"))
    filled = long.join(F.broadcast(m), "f").withColumn("v", F.coalesce("v", "mean"))
    sd = filled.groupBy("f").agg(F.stddev_pop("v").alias("sd")).where("sd > 1e-12")
    z = filled.join(F.broadcast(sd), "f").select(key, "f", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))
    wide = z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "z"))), lambda e: e["z"]).alias("x"))
    n = features.select(key).distinct().count()
    near = pair_distances(wide, key, n).where("near is not null")
    total = z.groupBy("f").agg(F.var_pop("z").alias("v")).agg(F.sum("v").alias("total_variance"))
    mean = F.sum("total") / (F.count("*") * F.lit(max(n - 1, 1)))
    return near.agg(mean.alias("mean_pairwise"), F.avg("near").alias("mean_nearest"), F.count("*").alias("n_logs")).crossJoin(total)


def range_coverage(features: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature the real and the generated range (column ``population``), and whether the generated one goes beyond."""
    long = features.unpivot(["population"], columns, "feature", "v")
    real = F.col("population") == "real"
    r = long.groupBy("feature").agg(*(g(F.when(c, F.col("v"))).alias(n) for n, g, c in (("real_min", F.min, real), ("real_max", F.max, real), ("made_min", F.min, ~real), ("made_max", F.max, ~real))))
    span = F.col("real_max") - F.col("real_min")
    return r.withColumn("beyond", (F.col("made_min") < F.col("real_min")) | (F.col("made_max") > F.col("real_max"))).withColumn("range_ratio", F.when(span > 0, (F.col("made_max") - F.col("made_min")) / span))


def acceptance_summary(records: DataFrame, targets: DataFrame, key: str = "point_id") -> DataFrame:
    """(kind, value, n): records by status and by reason without its figures, targets without a record, records without a target."""
    status = F.when(F.col("rejection_reason").isNull(), "accepted").otherwise("rejected")
    a = records.groupBy(F.lit("status").alias("kind"), status.alias("value")).agg(F.count("*").alias("n"))
    b = records.where("rejection_reason is not null").groupBy(F.lit("reason"), F.substring_index(F.substring_index("rejection_reason", ":", 1), " (", 1)).agg(F.count("*"))
    c = targets.join(records, key, "left_anti").groupBy(F.lit("targets"), F.lit("missing")).agg(F.count("*"))
    d = records.join(targets, key, "left_anti").groupBy(F.lit("targets"), F.lit("unknown")).agg(F.count("*"))
    return a.union(b).union(c).union(d)


def _components(points: DataFrame, k: int) -> tuple[DataFrame, PCAModel]:
    v = VectorAssembler(inputCols=list(AXES), outputCol="_v").transform(points)
    return v, PCA(k=k, inputCol="_v", outputCol="_p").fit(v)


def project_2d(points: DataFrame, key: str = "point_id") -> DataFrame:
    """The first two principal components of standardized points."""
    v, model = _components(points, 2)
    out = model.transform(v).withColumn("_p", vector_to_array("_p"))
    return out.select(key, F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"))


def explained_variance(points: DataFrame) -> DataFrame:
    """component (from 1), share of the variance and the shares so far, for all principal components of standardized points."""
    _, model = _components(points, len(AXES))
    shares = [float(x) for x in model.explainedVariance]
    rows = [(i + 1, x, sum(shares[: i + 1])) for i, x in enumerate(shares)]
    return points.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")
