"""Labels, notes and rules from decoded tables: words of pages, CAD entities, sheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cell_category, entity_category, label_category
from ..operators.authority import RULES

c = F.col


def word_labels(words: DataFrame) -> DataFrame:
    """Words that aren't blank, with their category."""
    return words.withColumn("text", F.trim("text")).filter("text <> ''").select("drawing_id", "page", "seq", "text", "x", "y", label_category(c("text")).alias("category"))


def entity_labels(entities: DataFrame) -> DataFrame:
    """A label for a TEXT, one for each line of an MTEXT, at the same place."""
    lines = entities.filter(c("etype").isin("TEXT", "MTEXT")).select("drawing_id", "seq", "x", "y", F.posexplode(F.when(c("etype") == "MTEXT", F.split("text", "\n")).otherwise(F.array("text"))).alias("line", "text"))
    return lines.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("category", entity_category(c("text")))


def dimension_labels(entities: DataFrame) -> DataFrame:
    """Dimension texts as labels at the origin."""
    return entities.filter("etype = 'DIMENSION' and trim(coalesce(text, '')) <> ''").select("drawing_id", "seq", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("line"), F.trim("text").alias("text"), F.lit("dimension").alias("category"))


def attribute_notes(entities: DataFrame) -> DataFrame:
    """Attribute templates of named blocks as notes."""
    return entities.filter("etype = 'ATTDEF' and not startswith(block_name, '*')").select("drawing_id", "seq", F.format_string("Block %s: %s = %s", c("block_name"), c("tag"), F.coalesce("text", F.lit(""))).alias("note"))


def cell_labels(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Non-empty cells as labels, x the column and y the row, with a category by text and header.

    ``headers``: drawing_id, sheet, header (map of column to text).
    """
    rows = cells.filter("trim(coalesce(value, '')) <> ''").join(headers.select("drawing_id", "sheet", "header"), ["drawing_id", "sheet"], "left")
    text = F.trim("value")
    return rows.select("drawing_id", "sheet", "row", "col", text.alias("text"), c("col").cast("double").alias("x"), (c("row") + 1).cast("double").alias("y"), cell_category(text, F.try_element_at("header", c("col"))).alias("category"))


RULE = "parameter string, component_types array<string>, authority_order array<string>, description string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Authority rules from JSON documents that hold a list of rules; rules without component types hold for all.

    A rule's number is its place in its list, lists in the order of their files' names.  Rules
    without a parameter are left out.
    """
    lists = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{RULE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").alias("rules"))
    rows = lists.select("file", F.posexplode("rules").alias("at", "r")).filter("r.parameter is not null").select("file", "at", "r.*")
    # rule sets are small (each file is one row here)
    rows = rows.withColumn("rule_pos", (F.row_number().over(W.orderBy("file", "at")) - 1).cast("int"))
    own = rows.withColumn("component_types", F.coalesce("component_types", F.array(F.lit("*"))))
    return own.select(*[x.split()[0] for x in RULES.split(", ")])


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as one JSON document, a list in their order. A rule set is small: it is read whole wherever it is used."""
    names = [x.split()[0] for x in RULE.split(", ")]
    ordered = F.array_sort(F.collect_list(F.struct("rule_pos", F.struct(*names).alias("r"))))
    rules.agg(F.to_json(F.transform(ordered, lambda x: x["r"])).alias("value")).write.mode("overwrite").text(path)
