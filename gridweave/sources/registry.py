"""Registry tables as Parquet: partitions replaced by key, append-only logs, exports.

A table's rows lie in ``buckets`` partitions by a hash of their key.  An upsert reads and
overwrites the partitions that its keys fall into (dynamic partition overwrite), so that a
batch costs what it touches.  A run that is repeated writes the same rows again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cables
from ..operators.changes import latest, snapshot, stored_mismatches

c = F.col


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a folder; None if nothing was written there. A stated schema spares reading it from the files."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Table:
    """One table with a key, in ``buckets`` partitions by its hash.

    ``buckets`` should grow with the table: what a batch reads and writes is the partitions
    that its keys fall into.  Each written partition has a row without key, so that one whose
    last row goes is overwritten too; rows without key aren't read back.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, key: str = "drawing_id", buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _stored(self) -> DataFrame | None:
        rows = read_or_none(self.spark, self.path, self.schema and f"{self.schema}, bucket int")
        return None if rows is None else rows.filter(c(self.key).isNotNull())

    def exists(self) -> bool:
        return self._stored() is not None

    def read(self) -> DataFrame:
        rows = self._stored()
        if rows is not None:
            return rows.drop("bucket")
        if self.schema is None:
            raise FileNotFoundError(self.path)
        return self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def hit(self, keys: DataFrame) -> list[int]:
        """The partitions that keys fall into: ``buckets`` numbers at most."""
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def write(self, df: DataFrame, hit: list[int] | None = None) -> None:
        """The rows of ``df`` become those of the partitions ``hit``, or of all that they fall into."""
        self._write_dealt(self._dealt(df, hit))

    def _dealt(self, df: DataFrame, hit: list[int] | None = None) -> DataFrame:
        """The rows dealt out by their partitions; of partitions ``hit`` there is a row without key."""
        rows = df.withColumn("bucket", self._bucket())
        if hit is not None:
            empty = self.spark.range(1).select(F.explode(F.lit(hit)).alias("bucket")).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), c("bucket").cast("int"))
            rows = rows.unionByName(empty)
        return rows.repartition("bucket")

    def _write_dealt(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def touched(self, keys: DataFrame) -> DataFrame:
        """The stored rows in the partitions that ``keys`` fall into."""
        return self.within(self.hit(keys))

    def within(self, hit: list[int]) -> DataFrame:
        rows = self._stored()
        return self.read() if rows is None else rows.filter(c("bucket").isin(hit)).drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; ``keys`` has the key column."""
        keys = keys.select(self.key).distinct()
        return self.touched(keys).join(keys, self.key, "left_semi")

    def replace(self, new: DataFrame, keys: DataFrame | None = None) -> None:
        """K1: the rows of ``keys`` go, those of ``new`` come, all others stay.

        ``keys`` are all that was scanned: one that has no rows any more loses its old ones.
        Left out, they are the keys of ``new``.
        """
        keys = new.select(self.key) if keys is None else keys.select(self.key).union(new.select(self.key))
        hit = self.hit(keys)
        old = self.within(hit) if self.exists() else new.limit(0)
        self._write_dealt(self.merged(old, new, keys, hit))

    def merged(self, old: DataFrame, new: DataFrame, keys: DataFrame, hit: list[int]) -> DataFrame:
        """``replaced`` in the partitions ``hit``, dealt out by them. Keys come as rows that mark theirs, so stored rows move once, not for a join too."""
        marks = keys.select(self.key).distinct().select(self.key, *(F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema if f.name != self.key), F.lit("mark").alias("_from"))
        rows = old.withColumn("_from", F.lit("old")).unionByName(new.withColumn("_from", F.lit("new"))).unionByName(marks)
        marked = F.max(c("_from") == "mark").over(W.partitionBy("bucket", self.key))
        # rows without key, of which new ones stay too, are those of no drawing
        stay = c("_from").isNull() | (c("_from") == "new") | ((c("_from") == "old") & (c(self.key).isNull() | ~c("_marked")))
        return self._dealt(rows, hit).withColumn("_marked", marked).filter(stay).drop("_from", "_marked")


def append(df: DataFrame, path: str) -> None:
    """K4, K5: rows of an append-only log."""
    df.write.mode("append").parquet(path)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Rows of a log that belong to a numbered batch: a batch that is run again replaces its own rows."""
    df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def batch_rows(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    rows = read_or_none(spark, path)
    return None if rows is None else rows.filter(c("batch") == batch).drop("batch")


def store_mismatches(table: Table, found: DataFrame) -> None:
    """K3 after all checks: partitions with open or found mismatches are written, those with resolved ones alone stay."""
    if not table.exists():
        return table.write(stored_mismatches(stored_mismatches_empty(found), found))
    hit = table.hit(table.read().filter("not resolved").select(table.key).union(found.select(table.key)))
    table.write(stored_mismatches(table.within(hit), found), hit)


def stored_mismatches_empty(found: DataFrame) -> DataFrame:
    cols = found.drop("resolution_options", "check_no").withColumns({"detected_at": F.current_timestamp(), "resolved_at": F.lit(None).cast("timestamp"), "resolved": F.lit(False)})
    return cols.filter("false")


def upsert_decisions(table: Table, new: DataFrame) -> None:
    """K6: the latest row of each decision stays; ``table`` has the key decision_id."""
    rows = table.touched(new).unionByName(new, allowMissingColumns=True) if table.exists() else new
    table.write(latest(rows, "decision_id", "timestamp"))


def write_snapshot(components: DataFrame, drawings: DataFrame, path: str) -> None:
    """K2."""
    append(snapshot(components, drawings), path)


#: What one exported file holds at most.
MOST_RECORDS = 1_000_000
DRAWING_JSON = "drawing_id string, drawing_type string, components array<struct<component_id:string,component_type:string,values:array<struct<parameter:string,value:string,unit:string,numeric_value:double>>>>"


def write_drawing_json(drawings: DataFrame, components: DataFrame, path: str, most: int = MOST_RECORDS) -> None:
    """K7: JSON lines, an object for each drawing with its components in order; ``most`` drawings a file at most.

    A task moves its own files to their place, so that the driver doesn't move all of them one by one.
    """
    inner = components.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct("component_id", "component_type", "values"))).alias("components"))
    out = drawings.join(inner, "drawing_id", "left").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    out.option("maxRecordsPerFile", most).json(path)


def read_drawing_json(spark: SparkSession, path: str, schema: str = DRAWING_JSON) -> DataFrame:
    """K7 read back; a drawing without components has none (null)."""
    return spark.read.schema(schema).json(path)


#: K8: the parts of a full export and their columns.
EXPORT = {
    "statistics": "drawings long, component_instances long, unique_components long, shared_components long, connections long, labels long, active_mismatches long",
    "shared": "component_id string, n_drawings long, drawings array<string>",
    "graph": "drawing_id string, n_references long, n_referenced_by long, n_shared long",
}


def export_json(parts: dict[str, DataFrame], path: str, most: int = MOST_RECORDS) -> None:
    """K8: statistics, shared components and the graph, each as JSON lines in a folder of its own."""
    for name, df in parts.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", most).json(f"{path}/{name}")


def read_export(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """K8 read back."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in (schemas or EXPORT).items()}


def write_cables(connections: DataFrame, components: DataFrame, drawings: DataFrame, path: str, drawing_id: str | None = None, most: int = MOST_RECORDS) -> None:
    """K9: cable list in the order of drawing, from and to over its files, schedule, and the list by drawing.

    The list by drawing lies in folders by a hash of the drawing, in the list's order; a
    folder for each drawing would be as many as drawings.
    """
    rows = cables.cable_list(connections, components, drawing_id)
    order = ["drawing_id", "from_component", "to_component", "cable_number"]
    out = lambda df: df.write.mode("overwrite").option("maxRecordsPerFile", most)
    out(rows.repartitionByRange(*order).sortWithinPartitions(*order)).option("header", True).option("quoteAll", True).option("emptyValue", "").csv(f"{path}/cable_list")
    out(cables.cable_schedule(connections, drawings)).option("header", True).csv(f"{path}/cable_schedule")
    by = rows.withColumn("folder", F.pmod(F.xxhash64("drawing_id"), F.lit(64)).cast("int"))
    out(by.repartition("folder").sortWithinPartitions("folder", *order)).partitionBy("folder").parquet(f"{path}/by_drawing")


def read_cables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K9 read back: list, schedule, list by drawing (folder dropped). The list has no nulls, which CSV doesn't tell from empty texts."""
    by = spark.read.parquet(f"{path}/by_drawing").drop("folder")
    read = lambda schema: spark.read.schema(schema).option("header", True).option("emptyValue", "")
    listed = ", ".join(f"{n} {t}" for n, t in by.dtypes)
    return read(listed).csv(f"{path}/cable_list").fillna(""), read("spec string, n long, n_drawings long, n_from long, n_to long").csv(f"{path}/cable_schedule"), by
