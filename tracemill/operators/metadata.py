"""Nested JSON of unknown depth as paths and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.sources.scratch import written

_FIELDS = "map<string,variant>"


def _depth(value: Column) -> Column:
    """How deep objects and arrays nest in a variant: an upper bound of the objects inside objects."""
    shape = F.regexp_replace(F.schema_of_variant(value), "`[^`]*`", "")
    marks = F.filter(F.split(shape, ""), lambda c: c.isin("<", ">"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def flatten_json(df: DataFrame, keys: list[str], column: str, prefix: str | Column, levels: int | None = None) -> DataFrame:
    """keys, path, value, kind: every scalar of the JSON text in ``column``, under ``prefix`` and the names on the way, joined by ``_``.

    kind is ``string``, ``number``, ``boolean`` or ``null``. Objects are gone
    into however deep they lie; arrays and texts that are no JSON objects give
    nothing. One aggregate finds the depth of the deepest text unless
    ``levels`` is given; the rest is that many explodes without a shuffle.
    """
    start = df.select(*keys, (F.lit(prefix) if isinstance(prefix, str) else prefix).alias("path"), F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull())
    if levels is None:
        levels = start.agg(F.max(_depth(F.col("v"))).alias("d")).first()["d"] or 0
    rows = start.where(F.schema_of_variant("v").startswith("OBJECT"))
    for _ in range(levels):
        fields = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v").cast(_FIELDS))
        inner = F.transform(F.map_entries(fields), lambda e: F.struct(F.concat_ws("_", F.col("path"), e["key"]).alias("path"), e["value"].alias("v")))
        rows = rows.select(*keys, F.explode(F.when(fields.isNotNull(), inner).otherwise(F.array(F.struct("path", "v")))).alias("e")).select(*keys, "e.path", "e.v")
    shape = F.schema_of_variant("v")
    kind = F.when(F.is_variant_null("v"), "null").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(OBJECT|ARRAY)"), None).otherwise("number")
    out = rows.select(*keys, "path", F.when(F.is_variant_null("v"), None).otherwise(F.when(kind.isNotNull(), F.variant_get("v", "$", "string"))).alias("value"), kind.alias("kind"))
    return out.where("kind is not null")


def flatten_metadata(results: DataFrame, keys: list[str], metadata: str = "metadata", source: str = "source_metadata") -> DataFrame:
    """Long rows (keys, path, value, kind) of a result's metadata: its timings, memory and scheduler parts, and all of its source's.

    ``metadata`` and ``source`` are JSON texts. Paths begin with ``timing``,
    ``memory``, ``slurm`` or ``source``. The parts are written first, in one
    pass over the results: later steps read them twice, and no parsing moves
    into the plan of the results, where it could meet more rows than these.
    """
    # The parts of the metadata that are flattened, and their prefixes.
    parts = [F.struct(F.lit(prefix).alias("_prefix"), F.get_json_object(metadata, f"$.{name}").alias("_part")) for name, prefix in (("timings", "timing"), ("memory", "memory"), ("slurm", "slurm"))]
    parts.append(F.struct(F.lit("source").alias("_prefix"), F.col(source).alias("_part")))
    rows = results.select(*keys, F.explode(F.array(*parts)).alias("_p")).select(*keys, "_p.*")
    return flatten_json(written(rows), keys, "_part", F.col("_prefix"))
