"""Cable list, cable schedule and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def cable_list(connections: DataFrame, components: DataFrame, drawing_id: str | None = None) -> DataFrame:
    """A row for each connection; an empty signal is filled from the signals of its first component.

    The cable's number is the wire label, or both ends.
    """
    if drawing_id is not None:
        connections = connections.filter(c("drawing_id") == drawing_id)
    signals = components.select("drawing_id", c("component_id").alias("from_component"), F.array_join("signals", ", ").alias("known"))
    blank = lambda x: F.coalesce(F.col(x), F.lit(""))
    rows = connections.join(signals, ["drawing_id", "from_component"], "left")
    number = F.coalesce(F.nullif(blank("wire_label"), F.lit("")), F.concat("from_component", F.lit("-"), "to_component"))
    signal = F.coalesce(F.nullif(blank("signal_type"), F.lit("")), c("known"), F.lit(""))
    return rows.select("drawing_id", "seq", number.alias("cable_number"), "from_component", "to_component", blank("cable_spec").alias("cable_spec"), signal.alias("signal"))


def schedule_rows(drawings: DataFrame) -> DataFrame:
    """The cable schedules of drawings, a row for each entry."""
    return drawings.select("drawing_id", F.posexplode("cable_schedule").alias("pos", "spec"))


def cable_schedule(connections: DataFrame, drawings: DataFrame) -> DataFrame:
    """A5: by specification, the number of cables and of distinct drawings and ends; entries of schedules count no cable."""
    a = connections.select(F.coalesce(F.nullif("cable_spec", F.lit("")), F.lit("(unspecified)")).alias("spec"), "drawing_id", c("from_component").alias("f"), c("to_component").alias("t"), F.lit(1).alias("one"))
    none = F.lit(None).cast("string")
    b = schedule_rows(drawings).select("spec", "drawing_id", none.alias("f"), none.alias("t"), F.lit(0).alias("one"))
    return a.unionByName(b).groupBy("spec").agg(F.sum("one").alias("n"), F.countDistinct("drawing_id").alias("n_drawings"), F.countDistinct("f").alias("n_from"), F.countDistinct("t").alias("n_to"))


def cable_summary(connections: DataFrame) -> DataFrame:
    """A6. Drawings are grouped, not told apart in one copy of the cables for each count."""
    by = connections.groupBy("drawing_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cables"), F.count("drawing_id").alias("drawings"))
    specs = connections.select(F.nullif("cable_spec", F.lit("")).alias("spec")).distinct().agg(F.count("spec").alias("specs"))
    return by.crossJoin(specs).select("cables", "specs", "drawings")


def cables_by_drawing(rows: DataFrame) -> DataFrame:
    """The cable list dealt out by drawing, each drawing's rows in order."""
    return rows.repartition("drawing_id").sortWithinPartitions("drawing_id", "seq")
