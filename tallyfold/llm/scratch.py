"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: its lineage is cut, its size known to the planner."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tallyfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._tallyfold_path = path
    return back


class Pile:
    """A settled table that grows part by part, however many there are."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/tallyfold-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)
        self.schema = schema
        _left.append((spark, self.path))

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_tallyfold_path", None)
        if path:
            _remove(df.sparkSession, path)
            _left[:] = [x for x in _left if x[1] != path]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, rather than at its next collection of garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside this thread


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the session may have ended
            _remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def unlike(keep: tuple[str, ...], made: Iterable[str]) -> None:
    """Columns that are kept must not have the names of those that an operator makes."""
    both = sorted(set(keep) & set(made))
    if both:
        raise ValueError(f"columns to keep have names of the result: {', '.join(both)}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what Arrow holds of a table of texts at once, on both sides of a Python worker; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
