"""Decisions: queries, trees by component, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import newest

c = F.col


def decisions(log: DataFrame, component_id: str | None = None, drawing_id: str | None = None, decision_type: str | None = None, limit: int = 100) -> DataFrame:
    """The newest decisions, with optional filters."""
    return newest(log, limit, "timestamp", "decision_id", component_id=component_id, drawing_id=drawing_id, decision_type=decision_type)


def decision_tree(log: DataFrame, components: DataFrame, component_id: str | None = None, own: int = 500, each: int = 50) -> DataFrame:
    """By component and section, its newest ``own`` decisions and the newest ``each`` classifications of each of its drawings.

    The limits are the report's.  Without an id, for all components.
    """
    if component_id is not None:
        components, mine = components.filter(c("component_id") == component_id), log.filter(c("component_id") == component_id)
    else:
        mine = log
    section = F.when(c("decision_type") == "AUTHORITY", "authority_determinations").when(c("decision_type") == "PROPAGATION", "propagation_actions").when(c("decision_type") == "MISMATCH_DETECTION", "mismatch_detections")
    cols = ["component_id", "section", "drawing_id", "decision_id", "outcome", "confidence", "timestamp"]
    first = mine.withColumn("k", F.row_number().over(W.partitionBy("component_id").orderBy(F.desc("timestamp"), "decision_id"))).filter(c("k") <= own).withColumn("section", section).filter("section is not null").select(*cols)
    sorted_ = log.filter("decision_type = 'CLASSIFICATION'").withColumn("k", F.row_number().over(W.partitionBy("drawing_id").orderBy(F.desc("timestamp"), "decision_id"))).filter(c("k") <= each).drop("component_id")
    second = components.select("component_id", "drawing_id").distinct().join(sorted_, "drawing_id").withColumn("section", F.lit("classifications")).select(*cols)
    return first.unionByName(second)


def statistics(log: DataFrame) -> DataFrame:
    """By type and in all (type null), the number, mean confidence to three places, first and last time."""
    return log.rollup("decision_type").agg(*_totals())


def _totals():
    return [F.count("*").alias("total"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")]


def audit_report(log: DataFrame, components: DataFrame, component_id: str | None = None) -> DataFrame:
    """D3: the number of rows and mean confidence of each section of a component's tree."""
    return decision_tree(log, components, component_id).groupBy("component_id", "section").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
