"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none and runs on one machine, as in tests, a
    temporary folder is made and set; on a cluster that is an error, as no
    other machine would see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders that ``materialize`` wrote inside the ``settled`` calls that are open now.
_open: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a file read and not
    a recomputation, and gives later joins exchanges of their own, which
    adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nobody reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            folder = re.match(r"(.*/tracemill-[0-9a-f]{32})/", name)
            if folder:
                _delete(df.sparkSession, folder[1])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, stage: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``stage`` as a written table; every other table that was written on the way to it is deleted."""
    made: list[str] = []
    _open.append(made)
    try:
        out = materialize(stage())
    finally:
        _open.remove(made)
    for folder in made[:-1]:
        _delete(spark, folder)
    return out


def free_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, with underscores before it until no column begins with it (in any case)."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def portions(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds what it makes of a few hundred texts and not of ten thousand."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether a document belongs to the held-out fold (remainder 1)."""
    return remainder(doc_id, modulus) == 1


class HashCache(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.bound:
            self[word] = value
        return value
