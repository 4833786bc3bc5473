"""Cut lineage in the shared folder, and ranks over a whole table without one task holding it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_made: list[tuple[SparkSession, str]] = []
#: What functions under ``tidy`` have materialised or shared so far.
_scopes: list[list] = []
#: Spark's setting that deletes a query's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, on one machine, a temporary one, which is then set; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them see")
        found = f"file://{tempfile.mkdtemp(prefix='credal-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/credal-{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)


def release(df) -> None:
    """Deletes a table that ``materialise`` wrote, or a broadcast variable of ``share``, that nothing will read again."""
    if not isinstance(df, DataFrame):
        df.destroy()
        for scope in _scopes:
            scope[:] = [x for x in scope if x is not df]
        return
    path = getattr(df, "_credal_path", None)
    if path and any(x[1] == path for x in _made):
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: what follows neither repeats nor plans what came before.

    Survives lost executors; readers read only the columns they need. The shuffle files of the write go with it (from Spark 4.1 on;
    before, when the driver happens to collect its garbage).
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._credal_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def share(spark: SparkSession, value):
    """A broadcast variable; under ``tidy`` it goes when the function's table is written."""
    out = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1].append(out)
    return out


def tidy(tag: str) -> Callable:
    """For functions that return a table: it is written, and what was materialised or shared on the way is deleted."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args, **named) -> DataFrame:
            _scopes.append([])
            try:
                out = materialise(f(*args, **named), tag)
                _scopes[-1].pop()  # the result itself
            finally:
                for t in _scopes.pop():
                    release(t)
            if _scopes:
                _scopes[-1].append(out)
            return out

        return run

    return wrap


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut."""
    return materialise(df, "cut")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's position (from 1) in the whole table by ``order``, whose values must be distinct.

    Rows are range-partitioned by the order and checkpointed, so that places are fixed; the rank is the rows of the partitions
    before (a table of one row a partition, broadcast) plus the place within.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + place).cast("long")).drop("_part", "_start")
