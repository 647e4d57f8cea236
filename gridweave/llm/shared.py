"""Tables in the shared folder, sample bounds and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Unset: one of our own in local mode, an error on a cluster."""
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


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, most_mb: int = 8) -> None:
    """Arrow batches of ``most_mb`` at most, so that a task holds little text at a time; a smaller setting stays.

    The setting is the session's, because rows are only computed later; README says so.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key, "64m").strip().lower())
    size = int(have[1]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(have[2], 1) if have else 0
    if size > most_mb << 20 or size <= 0:
        spark.conf.set(key, f"{most_mb}m")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n. Null: null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int, rest: int):
    """Whether the id belongs to the held-out rows; a null id does."""
    return F.coalesce(crc_mod(column, n) == rest, F.lit(True))


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A narrow table that goes to all tasks if a count shows that it is small; otherwise it is left to a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs to (node, root): each node's smallest reachable node.

    Large-star and small-star rounds: every round hangs neighbours on the smallest node
    near them, so chains shorten by halves.  Each round is one grouping per star and is
    written to the shared folder; links never reach the driver, only their count and a
    checksum do.  Nodes without links don't appear.  Hot nodes: min() is summed up before the
    shuffle; in the joins one side has a row for each node, so that adaptive execution cuts a
    hub's links into several tasks.  Chains shorten by halves, so ``most_rounds`` is beyond any
    number of links that could be stored.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        near = both(edges)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = written(small.filter("a <> b").distinct(), "links")
        dropped(edges)
        edges = nxt
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def placed(df: DataFrame, key: list[str], order: list, name: str = "place") -> DataFrame:
    """Rows with their place (a long from 0) within ``key`` by ``order``; a key may hold any share of the rows.

    Rows are dealt by ranges of key, order and their number, so that a large key lies in many
    ranges, and written; a place is the rank in the range and the key's rows in earlier
    ranges.  ``order`` must leave only equal rows tied.  Null keys are one key.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*key, *order, "_row")
    rows = written(rows.withColumn("_range", F.spark_partition_id()), "ranges")
    rank = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_range", *key).orderBy(*order, "_row")))
    before = rows.groupBy("_range", *key).count().withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("_before > 0").drop("count")
    on = [rank[c].eqNullSafe(before[c]) for c in ("_range", *key)]
    return rank.join(before, on, "left").select(*(rank[c] for c in df.columns), (F.col("_rank") - 1 + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
