"""Sums in the order of a key's rows, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with the sums of each key's earlier rows by ``order``; a key may hold any share of the rows.

    Rows are dealt by ranges of key, order and their number, so that a large key lies in many
    ranges, and written; to the sums within a range come those of the key's earlier ranges.
    ``order`` must leave only equal rows tied.  Null keys are one key.
    """
    rows = df.withColumns({f"_{n}": x.cast("long") for n, x in sums.items()} | {"_row": F.monotonically_increasing_id()}).repartitionByRange(*key, *order, "_row")
    rows = written(rows.withColumn("_range", F.spark_partition_id()), "ranges")
    within = W.partitionBy("_range", *key).orderBy(*order, "_row").rowsBetween(W.unboundedPreceding, -1)
    inner = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in sums})
    earlier = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *key).agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    before = totals.select("_range", *key, F.row_number().over(W.partitionBy(*key).orderBy("_range")).alias("_k"), *(F.sum(f"_all_{n}").over(earlier).alias(f"_to_{n}") for n in sums)).filter("_k > 1")
    on = [inner[c].eqNullSafe(before[c]) for c in ("_range", *key)]
    return inner.join(before, on, "left").select(*(inner[c] for c in df.columns), *((F.col(f"_in_{n}") + F.coalesce(f"_to_{n}", F.lit(0))).alias(n) for n in sums))


def placed(df: DataFrame, key: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows with their place, a long from 0, within ``key``."""
    return running(df, key, order, {name: F.lit(1)})
