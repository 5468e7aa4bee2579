"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

Every application writes below a folder of its own, which the driver's file system client removes when it ends. Tables
that are kept inside a scope() go when the scope ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: str | None = None
_marked: set[str] = set()
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, in local mode only."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="siteloom-")
        atexit.register(shutil.rmtree, _local, True)
    return "file://" + _local


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    own = f"{shared_folder(spark)}/siteloom/{spark.sparkContext.applicationId}"
    if own not in _marked:
        at, files = _file_system(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _marked.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage is cut and executors may be lost."""
    path, context = new_path(df.sparkSession, name), df.sparkSession.sparkContext
    context.setJobDescription(f"siteloom {name}")
    df.write.option("compression", "zstd").parquet(path)
    context.setJobDescription(None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    for scope_ in _scopes:
        scope_.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that keep() wrote and that nothing reads any more."""
    for df in tables:
        at, files = _file_system(df.sparkSession, df.kept_path)
        files.delete(at, True)


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end all tables that were kept inside it; what is to outlive it has to be written before."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.pop()
        release(*held)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A kept table, marked for broadcast only if its counted rows are within the bound; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """df with 1, 2, 3, ... in an order of unique values: rows are numbered in ranges, whose counts then add up."""
    rows = keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range.
    base = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(F.broadcast(base), "__part").withColumn(out, (F.col("__base") + inside).cast("long")).drop("__part", "__base")
