"""Which drawing is authoritative for a parameter: ranked rules by parameter and component type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import AUTHORITY_RULES

RULES = "rule_pos int, parameter string, component_types array<string>, authority_order array<string>, description string"


def default_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules. Made by an expression, so that the optimiser knows how small they are."""
    text = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = [F.struct(F.lit(k).alias("rule_pos"), F.lit(p).alias("parameter"), text(ts).alias("component_types"), text(o).alias("authority_order"), F.lit("").alias("description")) for k, (p, ts, o) in enumerate(AUTHORITY_RULES)]
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with parameter, component_type) with authority_order: the first rule for the type, else the first for all, else null.

    Rules are cut down to one row a parameter and type, and joined straight; their keys are not looked for first.
    """
    r = rules.withColumn("wild", F.array_contains("component_types", "*"))
    own = r.filter("not wild").withColumn("component_type", F.explode("component_types")).groupBy("parameter", "component_type").agg(F.min_by("authority_order", "rule_pos").alias("_own"))
    every = r.filter("wild").groupBy("parameter").agg(F.min_by("authority_order", "rule_pos").alias("_every"))
    out = rows.join(own, ["parameter", "component_type"], "left").join(every, "parameter", "left")
    return out.withColumn("authority_order", F.coalesce("_own", "_every")).drop("_own", "_every")


def rules_for(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (parameter, component_type) with authority_order; keys without a rule don't come out."""
    return ruled(keys, rules).filter("authority_order is not null").select("parameter", "component_type", "authority_order")


def basis_text(parameter: Column, order: Column, drawing_type: Column) -> Column:
    """Why a drawing type is authoritative."""
    rank = F.array_position(order, drawing_type)
    return F.when(order.isNull(), F.concat(F.lit("No authority rule found for "), parameter)).when(rank > 0, F.concat(drawing_type, F.lit(" is authoritative for "), parameter, F.lit(" (priority "), rank.cast("string"), F.lit(" of "), F.size(order).cast("string"), F.lit(")"))).otherwise(F.concat(drawing_type, F.lit(" is not in the authority chain for "), parameter))


def authority_basis(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (parameter, component_type, drawing_type) with basis."""
    ranked = ruled(rows, rules)
    return ranked.withColumn("basis", basis_text(F.col("parameter"), F.col("authority_order"), F.col("drawing_type"))).drop("authority_order")


def pick_authority(rows: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Y2: of each group's (drawing_id, drawing_type) the one whose type ranks first, then the first drawing.

    ``rows`` has ``keys``, parameter, component_type, drawing_id, drawing_type.  Groups
    without a ranked drawing don't come out.  Adds basis.
    """
    ranked = ruled(rows, rules).withColumn("rank", F.array_position("authority_order", F.col("drawing_type"))).filter("rank > 0")
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct("drawing_id", "drawing_type", "authority_order", F.col("parameter").alias("p")), F.struct("rank", "drawing_id")).alias("b"))
    return best.select(*keys, "b.drawing_id", "b.drawing_type", basis_text(F.col("b.p"), F.col("b.authority_order"), F.col("b.drawing_type")).alias("basis"))
