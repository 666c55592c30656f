"""Projection, filters and canonical form of event tables and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Other names of the required columns, and old algorithm labels.
ALIASES = {"case:concept:name": "case_id", "concept:name": "activity", "time:timestamp": "ts", "timestamp": "ts", "lifecycle:transition": "lifecycle"}
LEGACY_LABELS = {"heuristic_miner_classic": "heuristics_miner", "heuristic_miner_plusplus": "heuristics_miner_plusplus", "ilp_miner_classic": "ilp_miner", "split_miner_v1": "split_miner"}
REQUIRED = ("case_id", "activity", "ts")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Alias columns renamed, required ones checked and put first, the rest sorted."""
    out = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    first = [c for c in ("log_id", *REQUIRED) if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def canonicalize(df: DataFrame, position: str = "event_index") -> DataFrame:
    """log_id, case_id, activity, ts, event_index without rows that lack a required value; positions count anew by time."""
    typed = df.select("log_id", F.col("case_id").cast("string").alias("case_id"), F.col("activity").cast("string").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), position)
    w = Window.partitionBy("log_id", "case_id").orderBy("ts", position)
    return typed.dropna(subset=list(REQUIRED)).withColumn("event_index", F.row_number().over(w))


def resolve_schema(df: DataFrame, names: dict[str, str], policy: str = "drop", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by ``names`` (ours -> theirs); rows without a required value dropped, or an error with ``fail``."""
    out = df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in names.items()), *keep)
    bad = F.lit(False)
    for c in REQUIRED:
        bad = bad | F.col(c).isNull()
    if policy == "fail":
        n = out.where(bad).limit(1).count()
        if n:
            raise ValueError("rows lack a case, an activity or a timestamp")
    return out.where(~bad)


def parse_timestamps(text: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]")))


def sanitize_text(text: Column) -> Column:
    """Control characters replaced by U+FFFD."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "�")


def compact_labels(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activities as A0001, A0002, ... in sorted order per log, and the mapping."""
    names = log.where("activity is not null").select("log_id", "activity").distinct()
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy("activity")).cast("string")
    width = F.greatest(F.lit(4), F.length(rank))
    mapping = names.withColumn("label", F.concat(F.lit("A"), F.lpad(rank, width, F.lit("0"))))
    return log.join(F.broadcast(mapping), ["log_id", "activity"], "left").drop("activity").withColumnRenamed("label", "activity"), mapping


def complete_projection(log: DataFrame, semantics: str = "standard") -> DataFrame:
    """Complete events of a log with standard lifecycles; all events otherwise."""
    return log.where(F.lower("lifecycle") == "complete") if semantics == "standard" else log


def log_family(log_id: Column) -> Column:
    """The parent of an augmented log; any other log is its own family."""
    return F.when(log_id.startswith("aug_"), F.element_at(F.split(F.substring(log_id, 5, 1 << 30), "__"), 1)).otherwise(log_id)


def log_population(log_id: Column) -> Column:
    """gedi, augmented, synth or real, by the id."""
    return F.when(log_id.startswith("syn_gedi"), "gedi").when(log_id.startswith("aug_"), "augmented").when(log_id.startswith("syn_"), "synth").otherwise("real")


def normalize_labels(df: DataFrame, column: str = "algorithm") -> DataFrame:
    return df.replace(LEGACY_LABELS, subset=[column])


def select_runs(runs: DataFrame, algorithms=None, logs=None, experiments=None, statuses=None) -> DataFrame:
    """Runs that match every filter that is given."""
    for column, wanted in (("algorithm", algorithms), ("log_id", logs), ("experiment_id", experiments), ("status", statuses)):
        if wanted:
            runs = runs.where(F.col(column).isin(*wanted))
    return runs


def regime(runs: DataFrame, name: str) -> DataFrame:
    """Training rows of a regime: ``real``, ``real_synthetic`` (no augmented logs) or ``full``."""
    p = log_population(F.col("log_id"))
    return {"real": runs.where(p == "real"), "real_synthetic": runs.where(p != "augmented"), "full": runs}[name]
