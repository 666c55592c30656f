"""Whole XES documents: headers, traces with their lifecycle, and header tables over a set of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.clean import sanitize_text

_KINDS = ("string", "date", "int", "float", "boolean")
HEADER = "log_id string, part string, name string, detail string, value string"


def escaped(text: Column) -> Column:
    """Text as it stands inside an XML attribute; characters that XML has no place for become U+FFFD."""
    out = sanitize_text(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def _attribute(kind: str, key: Column, value: Column) -> Column:
    """An attribute element, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f'<{kind} key="'), escaped(key), F.lit('" value="'), escaped(value), F.lit('"/>')), F.lit(""))


def _header_lines(headers: DataFrame) -> DataFrame:
    """(log_id, place, line) of the header rows, in the order of the standard: extensions, globals, classifiers."""
    q = lambda c: F.concat(F.lit('"'), escaped(F.coalesce(F.col(c), F.lit(""))), F.lit('"'))
    extension = F.concat(F.lit("<extension name="), q("name"), F.lit(" prefix="), q("detail"), F.lit(" uri="), q("value"), F.lit("/>"))
    scope = F.when(F.col("detail").isNotNull(), F.concat(F.lit(" scope="), q("detail"))).otherwise("")
    classifier = F.concat(F.lit("<classifier name="), q("name"), scope, F.lit(" keys="), q("value"), F.lit("/>"))
    plain = headers.where("part in ('extension', 'classifier')").select("log_id", F.when(F.col("part") == "extension", 1).otherwise(3).alias("place"), F.when(F.col("part") == "extension", extension).otherwise(classifier).alias("line"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: _attribute("string", x["name"], F.coalesce(x["value"], F.lit("")))), "")
    scopes = headers.where("part = 'global'").groupBy("log_id", "detail").agg(inner.alias("inner"))
    scopes = scopes.select("log_id", F.lit(2).alias("place"), F.concat(F.lit("<global scope="), q("detail"), F.lit(">"), "inner", F.lit("</global>")).alias("line"))
    return plain.union(scopes)


def write_document(log: DataFrame, path: str, headers: DataFrame | None = None, lifecycle: str = "complete", files: int = 1) -> None:
    """XES documents under ``path/log_id=.../file=...``: headers, then traces by case, events by time and input order.

    ``lifecycle``: every event gets ``complete``, or with ``keep`` its own
    transition (none where it is null). Each log is one file, or with ``files``
    as many documents with the same headers, its cases dealt by hash, so that a
    very large log is written by several tasks. A null activity or timestamp is
    left out. A trace is one line.
    """
    if lifecycle not in ("complete", "keep"):
        raise ValueError(f"lifecycle is complete or keep, not {lifecycle!r}")
    own = F.col("lifecycle") if lifecycle == "keep" else F.lit("complete")
    step = F.struct(F.col("ts").isNull().alias("late"), "ts", "event_index", "activity", own.alias("transition"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event = lambda x: F.concat(F.lit("<event>"), _attribute("string", F.lit("concept:name"), x["activity"]), _attribute("date", F.lit("time:timestamp"), stamp(x["ts"])), _attribute("string", F.lit("lifecycle:transition"), x["transition"]), F.lit("</event>"))
    cases = log.groupBy("log_id", "case_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    line = F.concat(F.lit("<trace>"), _attribute("string", F.lit("concept:name"), F.col("case_id")), F.array_join(F.transform("steps", event), ""), F.lit("</trace>"))
    traces = cases.select("log_id", F.pmod(F.xxhash64("case_id"), F.lit(files)).cast("int").alias("file"), F.lit(4).alias("place"), F.col("case_id").alias("key"), line.alias("line"))
    every = log.select("log_id").distinct().withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
    ends = F.array(F.struct(F.lit(0).alias("place"), F.lit('<?xml version="1.0" encoding="UTF-8"?><log xes.version="1.0">').alias("line")), F.struct(F.lit(5).alias("place"), F.lit("</log>").alias("line")))
    frame = every.select("log_id", "file", F.explode(ends).alias("e")).select("log_id", "file", "e.place", F.lit("").alias("key"), "e.line")
    rows = traces.union(frame)
    if headers is not None:
        head = every.join(_header_lines(headers), "log_id")
        rows = rows.union(head.select("log_id", "file", "place", F.col("line").alias("key"), "line"))
    rows = rows.repartition("log_id", "file").sortWithinPartitions("log_id", "file", "place", "key")
    rows.select("log_id", "file", "line").write.partitionBy("log_id", "file").mode("overwrite").text(path)


def _log_id(file: Column) -> Column:
    """The log of a file: its ``log_id=`` folder, else its name."""
    folder = F.regexp_extract(file, r"/log_id=([^/]+)/", 1)
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.xes(\.gz)?$", "")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # once for the path as a URI, once for the name of the folder
    return F.when(folder != "", plain(plain(folder))).otherwise(name)


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """log_id, part, name, detail, value: the headers of all XES files of ``path`` in one table.

    Parts: ``extension`` (name, prefix, URI), ``classifier`` (name, scope, keys
    with one blank between), ``global`` (key, scope, default), ``trace`` and
    ``event`` (the attribute keys in use, over all traces). A log of several
    files has each row once.
    """

    def read(tag: str, schema: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        return rows.withColumn("log_id", _log_id(F.col("_metadata.file_path")))

    none = F.lit(None).cast("string")
    keyed = ",".join(f"{k}:array<struct<_key:string>>" for k in _KINDS)
    valued = ", ".join(f"{k} array<struct<_key:string,_value:string>>" for k in _KINDS)

    def attributes(of: str, kind: str) -> Column:
        return F.concat(*(F.coalesce(F.col(f"{of}{k}"), F.array().cast(f"array<{kind}>")) for k in _KINDS))

    extensions = read("extension", "_name string, _prefix string, _uri string").select("log_id", F.lit("extension"), "_name", "_prefix", "_uri")
    classifiers = read("classifier", "_name string, _scope string, _keys string").select("log_id", F.lit("classifier"), "_name", "_scope", F.trim(F.regexp_replace("_keys", r"\s+", " ")))
    globals_ = read("global", "_scope string, " + valued).select("log_id", "_scope", F.explode(attributes("", "struct<_key:string,_value:string>")).alias("a")).select("log_id", F.lit("global"), "a._key", "_scope", "a._value")
    traces = read("trace", ", ".join(f"{k} array<struct<_key:string>>" for k in _KINDS) + f", event array<struct<{keyed}>>")
    of_trace = traces.select("log_id", F.explode(F.array_distinct(attributes("", "struct<_key:string>"))).alias("a")).select("log_id", F.lit("trace"), "a._key", none, none)
    of_event = traces.select("log_id", F.explode("event").alias("e")).select("log_id", F.explode(attributes("e.", "struct<_key:string>")).alias("a")).select("log_id", F.lit("event"), "a._key", none, none)
    out = extensions.union(classifiers).union(globals_).union(of_trace).union(of_event).toDF("log_id", "part", "name", "detail", "value")
    return out.where("name is not null").distinct()
