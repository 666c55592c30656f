"""Latin hypercube designs with conditional branches, for every key at once.

A branch is a condition on parameters and a space of further parameters. It
has a hypercube of its own: the rows of a design that meet the condition are
ranked within the branch, so that each of its parameters has one draw in each
of as many strata as the branch has rows. Branches are gone through in order,
and a later one may ask for parameters of an earlier one.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import uniform

# Integer parameters that are drawn on a log scale unless a scale is given.
LOG_SCALED = ("generations", "min_act_count", "min_dfg_occurrences", "population_size")


@dataclass(frozen=True)
class Dimension:
    """One parameter: a list of values, or a range of floats or integers."""

    name: str
    values: tuple = ()
    low: float = 0.0
    high: float = 0.0
    whole: bool = False
    log: bool = False

    @property
    def free(self) -> bool:
        return len(self.values) > 1 if self.values else self.low < self.high

    @property
    def first(self) -> Any:
        return self.values[0] if self.values else round(self.low, 0 if self.whole else 6)

    def at(self, u: Column) -> Column:
        """The value at ``u`` in [0, 1)."""
        if self.values:
            return F.element_at(F.array(*map(F.lit, self.values)), (F.least(F.floor(u * len(self.values)), F.lit(len(self.values) - 1)) + 1).cast("int"))
        if self.log:
            low, high = F.log(F.lit(self.low)), F.log(F.lit(self.high))
            v = F.exp(low + u * (high - low))
        else:
            v = F.lit(self.low) + u * (self.high - self.low)
        return F.least(F.greatest(F.bround(v), F.lit(float(round(self.low)))), F.lit(float(round(self.high)))) if self.whole else F.round(v, 6)


def dimension(name: str, spec: Any) -> Dimension:
    """From ``{"values": [...]}``, a list, one value, or ``{"type": "float" | "integer", "min": a, "max": b, "scale": "linear" | "log"}``."""
    if isinstance(spec, dict) and "min" in spec:
        kind, low, high = spec.get("type"), float(spec["min"]), float(spec["max"])
        if kind not in ("float", "integer"):
            raise ValueError(f"{name}: the type of a range is float or integer, not {kind!r}")
        if low > high:
            raise ValueError(f"{name}: {low:g} is above {high:g}")
        by_name = kind == "integer" and name in LOG_SCALED and low > 0
        scale = spec.get("scale") or ("log" if by_name else "linear")
        if scale == "log" and low <= 0:
            raise ValueError(f"{name}: a log scale needs a positive range")
        return Dimension(name, low=low, high=high, whole=kind == "integer", log=scale == "log")
    values = spec["values"] if isinstance(spec, dict) else spec if isinstance(spec, (list, tuple)) else [spec]
    if not values:
        raise ValueError(f"{name}: no values")
    if len({isinstance(v, str) for v in values}) > 1:
        raise ValueError(f"{name}: texts and numbers are mixed")
    return Dimension(name, values=tuple(v if isinstance(v, str) else float(v) for v in values))


Branch = tuple[dict[str, Any], dict[str, Any]]


def _same(value: Any) -> Any:
    return value if isinstance(value, str) else float(value)


def has_free_dimensions(space: dict[str, Any], branches: list[Branch] = (), defaults: dict[str, Any] | None = None) -> bool:
    """Whether any parameter can vary: in the space, or in a branch that its fixed values meet."""
    dims = [dimension(n, s) for n, s in space.items()]
    if any(d.free for d in dims):
        return True
    fixed = {n: _same(v) for n, v in (defaults or {}).items()} | {d.name: d.first for d in dims}
    return any(all(fixed.get(n) == _same(v) for n, v in when.items()) and any(dimension(n, s).free for n, s in more.items()) for when, more in branches)


def conditional_lhs(designs: DataFrame, space: dict[str, Any], branches: list[Branch] = (), n: int = 100, seed: int = 0, defaults: dict[str, Any] | None = None) -> DataFrame:
    """``n`` configurations for every row of ``designs`` (keys): the keys, ``point`` and a column a parameter.

    Every design is a Latin hypercube of its own. Parameters of a branch are
    null where its condition does not hold, or have their default. Draws come
    from hashes of the seed, the keys, the branch and the point: repeatable,
    whatever the partitioning. The windows go by design, so designs are worked
    out side by side and none is larger than ``n``.
    """
    if not has_free_dimensions(space, list(branches), defaults):
        raise ValueError(f"{n} points were asked for, but no parameter can vary")
    keys = designs.columns
    clash = {"point"} | {p for when, more in branches for p in more} | set(space)
    if clash & set(keys):
        raise ValueError(f"names of designs and parameters clash: {sorted(clash & set(keys))}")
    out = designs.distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.lit(_same(value)))
    out = _drawn(out, keys, [dimension(p, s) for p, s in sorted(space.items())], F.lit(True), seed, 0)
    for k, (when, more) in enumerate(branches, 1):
        unknown = [p for p in when if p not in out.columns]
        hit = F.lit(not unknown)
        for p, value in when.items():
            if not unknown:
                hit = hit & F.coalesce(F.col(p) == F.lit(_same(value)), F.lit(False))
        out = _drawn(out, keys, [dimension(p, s) for p, s in sorted(more.items())], hit, seed, k)
    return out


def _drawn(rows: DataFrame, keys: list[str], dims: list[Dimension], hit: Column, seed: int, branch: int) -> DataFrame:
    """``rows`` with a stratified draw of every dimension where ``hit`` holds, ranked among those rows of a design."""
    rows = rows.withColumn("_hit", hit)
    group = Window.partitionBy(*keys, "_hit")
    for d in dims:
        draw = [F.lit(seed), F.lit(branch), F.lit(d.name), *keys, "point"]
        rank = F.row_number().over(group.orderBy(F.xxhash64(*draw), "point"))
        u = (rank - 1 + uniform(F.lit(seed + 1), *draw[1:])) / F.count(F.lit(1)).over(group)
        kept = F.col(d.name) if d.name in rows.columns else F.lit(None)
        rows = rows.withColumn(d.name, F.when(F.col("_hit"), d.at(u)).otherwise(kept))
    return rows.drop("_hit")


def strata(rows: DataFrame, keys: list[str], space: dict[str, Any], branches: list[Branch] = ()) -> DataFrame:
    """How a design fills its strata: keys, branch, parameter, stratum, n.

    Read off the values, not the ranks: of a range with m rows in its branch the
    stratum of m equal ones, of a list the place of the value.
    """
    out = None
    for k, (when, more) in enumerate([({}, space), *branches]):
        part = rows
        for p, v in when.items():
            part = part.where(F.col(p) == F.lit(_same(v)))
        m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        for p, s in sorted(more.items()):
            d = dimension(p, s)
            if d.values:
                at = F.array_position(F.array(*map(F.lit, d.values)), F.col(p)) - 1
            elif d.log:
                at = F.floor((F.log(p) - F.log(F.lit(d.low))) / (F.log(F.lit(d.high)) - F.log(F.lit(d.low))) * m)
            else:
                at = F.floor((F.col(p) - d.low) / (d.high - d.low) * m)
            one = part.select(*keys, F.lit(k).alias("branch"), F.lit(p).alias("parameter"), at.cast("long").alias("stratum"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys, "branch", "parameter", "stratum").agg(F.count("*").alias("n"))
