"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where the setting is absent, on one machine only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark.sparkContext, "_tissuelake_dir", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="tissuelake-")
            spark.sparkContext._tissuelake_dir = path
    return path


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries inside drop their shuffle files as they end: what they made has been written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` below the shared folder, in a folder a value of ``by``, and read it back: cuts the lineage and survives
    lost executors."""
    spark = df.sparkSession
    path = workspace(spark, label)
    with tidy(spark):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tissuelake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty written tables that nothing will read again."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(t._tissuelake_path)


def discard_part(table: DataFrame, kind: int) -> None:
    """Empty the folder ``kind`` of a table that was written by kind."""
    rows = table.sparkSession.createDataFrame([], table.drop("kind").schema)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{table._tissuelake_path}/kind={kind}")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if a column of ``df`` bears it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that are called like ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in gone])


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod), F.lit(-1))


def held_out(id_col: str, mod: int, value: int) -> Column:
    return remainder(id_col, mod) == F.lit(value)


def bounded_rate(rows: int, bound: int) -> float:
    """Share of the rows to keep so that about ``bound`` of them remain."""
    return 1.0 if rows <= bound else bound / rows


def sampled(id_col: str, rate: Column | float) -> Column:
    """Deterministic sampling predicate on the row's id."""
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < rate


def trim() -> None:
    """Give memory that is no longer used back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker(run: Callable) -> Callable:
    """``run`` for mapInArrow, trimming the worker's memory when its task ends."""

    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed
