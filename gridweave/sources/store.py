"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[tuple, DataFrame] = {}
_LOCK = threading.RLock()  # tables are derived from each other


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset: a folder of our own in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table written in the shared folder, so that lost executors cost no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple:
    """A file's or folder's bytes, number of files and time of change; a table that is written anew has another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(at)
    return path, size.getLength(), size.getFileCount(), fs.getFileStatus(at).getModificationTime()


def buckets_for(size: int, least: int = 8, most: int = 4096, each: int = 64 << 20) -> int:
    """How many buckets a table made of ``size`` bytes gets."""
    return max(least, min(most, size // each))


def bucketed(df: DataFrame, by: str, buckets: int, dealt: bool = False) -> DataFrame:
    """The same rows from an external table in the shared folder that is bucketed and sorted by a column.

    Groupings by keys that hold the column, and joins of such tables by it, need no exchange.
    The rows are dealt out by the column first, so each bucket is one file; ``dealt`` rows
    are already, into as many partitions, and are written without another exchange or order.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows = df.write.bucketBy(buckets, by) if dealt else df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
    rows.option("path", new_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def stored(make, spark: SparkSession, sources: list[str], *key: str, by: str | None = None, dealt: int = 0) -> DataFrame:
    """The rows of ``make()``, written once for each application, key and state of the source files; bucketed ``by`` a column.

    ``dealt``: the number of buckets that the rows are dealt out to already.
    """
    states = [state_of(spark, path) for path in sources]
    name = (spark.sparkContext.applicationId, *key, *states)
    with _LOCK:
        if name not in _MADE:
            if by is None:
                path = new_path(spark, "derived")
                make().write.parquet(path)
                _MADE[name] = spark.read.parquet(path)
            else:
                _MADE[name] = bucketed(make(), by, dealt or buckets_for(sum(x[1] for x in states), each=16 << 20), bool(dealt))
        return _MADE[name]
