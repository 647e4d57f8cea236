"""Components from CAD block references: one ordered choice of strategy, then one projection for each.

entities: drawing_id, layout, seq, block_name, attribs (map of tag to text), x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import entity_category, id_from_name, type_from_id

c = F.col
_VALUE = "array<struct<parameter:string,value:string>>"


def attribute(tag: str) -> Column:
    return F.try_element_at("attribs", F.lit(tag))


def first_tag(tags) -> Column:
    """The first of the tags that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(attribute(t)), F.lit("")) for t in tags])


def filled() -> Column:
    return F.map_filter("attribs", lambda k, v: F.trim(v) != "")


def is_title() -> Column:
    """B1: a title block."""
    upper = F.upper("block_name")
    return F.contains(upper, F.lit("TITLE")) | (upper.rlike("ATT BLK|ATT_BLK") & attribute("DWGNO").isNotNull())


def is_skipped() -> Column:
    """B2: metadata, revision and tag markers."""
    upper = F.upper("block_name")
    own = attribute("DEVICE").isNotNull() | attribute("FUSE_NUM").isNotNull() | attribute("OUTPUT-#").isNotNull()
    return (upper == "WD_M") | (F.contains(upper, F.lit("REV")) & ~own) | (F.contains(upper, F.lit("TAG")) & attribute("TAGNUMBER").isNotNull())


def title_blocks(entities: DataFrame) -> DataFrame:
    """B1: title block fields by drawing; a later block's value replaces an earlier one's."""
    rows = entities.filter(is_title()).select("drawing_id", "seq", F.explode("attribs").alias("tag", "value")).withColumn("tag", F.upper("tag"))
    field = F.lit(None).cast("string")
    for tag, name in reversed(P.TITLE_TAGS):
        field = F.when(F.contains("tag", F.lit(tag)), name).otherwise(field)
    field = F.when(c("tag") == "DRAWING_NUMBER", "drawing_number").when(F.contains("tag", F.lit("DWGTITLE")) | (c("tag") == "TITLE"), "drawing_name").when(c("tag") == "REVISION", "revision").when(c("tag") == "COMPANY", "company").otherwise(field)
    named = rows.withColumn("field", field).filter("field is not null and value <> ''")
    # the first part of a title stays, a part numbered 1 replaces it
    order = F.when(c("field") == "drawing_name", F.struct(c("tag").endswith("1").cast("int").alias("a"), (-c("seq")).alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), c("seq").cast("bigint").alias("b")))
    return named.groupBy("drawing_id", "field").agg(F.max_by("value", order).alias("value"))


def with_context(entities: DataFrame) -> DataFrame:
    """The last device before or at each block of a layout, in order. One layout's blocks are one window."""
    over = W.partitionBy("drawing_id", "layout").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(~is_title() & ~is_skipped(), first_tag(P.DEVICE_TAGS))
    return entities.withColumn("device", F.last(own, ignorenulls=True).over(over))


def inputs() -> Column:
    """Ids under tags that begin with INPUT-#."""
    named = F.filter(F.map_entries("attribs"), lambda e: e["key"].startswith("INPUT-#") & (F.trim(e["value"]) != "") & ~e["value"].startswith("IN ") & (F.trim(e["value"]) != "IN"))
    return F.transform(named, lambda e: F.trim(e["value"]))


def strategy() -> Column:
    """Which rule takes a block."""
    upper = F.upper("block_name")
    words = "|".join(w for w, _, _ in P.BLOCK_WORDS)
    tag = F.coalesce(F.nullif(F.coalesce(attribute("TAG"), attribute("NAME"), F.lit("")), F.lit("")), F.nullif(id_from_name(c("block_name")), F.lit("")))
    return (
        F.when(is_title(), "title")
        .when(is_skipped(), "skip")
        .when(first_tag(P.DEVICE_TAGS).isNotNull(), "device")
        .when(first_tag(P.FUSE_TAGS).isNotNull(), "fuse")
        .when(first_tag(P.OUTPUT_TAGS).isNotNull(), "output")
        .when(F.size(inputs()) > 0, "input")
        .when(first_tag(P.POWER_TAGS).isNotNull(), "power")
        .when(upper.rlike(words), "keyword")
        .when(upper.rlike("PNL_TERM|RELAY_TERM"), "terminal")
        .when(tag.isNotNull(), "tag")
        .when(~c("block_name").startswith("*") & (F.size("attribs") > 0), "note")
        .otherwise("none")
    )


def _keyword() -> Column:
    """The first block word that the name holds, with its type."""
    upper = F.upper("block_name")
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("kind")) for w, t, *_ in P.BLOCK_WORDS])
    return F.get(F.filter(words, lambda w: F.contains(upper, w["word"])), F.lit(0))


def block_components(entities: DataFrame) -> DataFrame:
    """drawing_id, component_id, component_type, values, attributes.

    Blocks that give the same id of a drawing are merged: the first type stays, the last
    value of an attribute wins, a fuse's values are kept once, a device's as often as they come.
    """
    df = with_context(entities).withColumn("how", strategy())
    df = df.withColumn("keyword", F.when(c("how") == "keyword", _keyword()))
    how = c("how")
    behind = lambda base: F.concat_ws("-", base, c("device"))
    ground = c("keyword.word").isin("GROUND", "GND")
    strip, term = attribute("TAGSTRIP"), F.coalesce(attribute("TERM#"), attribute("TERM"))
    terminal = F.when((F.coalesce(strip, F.lit("")) != "") & (F.coalesce(term, F.lit("")) != ""), F.concat(strip, F.lit("-"), term)).when(F.coalesce(attribute("TERM_DESC"), F.lit("")) != "", F.concat(F.lit("TERM-"), attribute("TERM_DESC"))).otherwise(F.concat(F.lit("TERM-"), c("block_name")))
    tag = F.coalesce(F.nullif(F.coalesce(attribute("TAG"), attribute("NAME"), F.lit("")), F.lit("")), id_from_name(c("block_name")))
    ids = (
        F.when(how == "device", F.array(first_tag(P.DEVICE_TAGS)))
        .when(how == "fuse", F.array(first_tag(P.FUSE_TAGS)))
        .when(how == "output", F.array(first_tag(P.OUTPUT_TAGS)))
        .when(how == "input", inputs())
        .when(how == "power", F.array(behind(F.lit("PWR-SUPPLY"))))
        .when(how == "keyword", F.array(behind(F.when(ground, "GND").otherwise(F.upper(F.replace("block_name", F.lit(" "), F.lit("-")))))))
        .when(how == "terminal", F.array(terminal))
        .when(how == "tag", F.array(tag))
    )
    df = df.filter(how.isin("device", "fuse", "output", "input", "power", "keyword", "terminal", "tag")).withColumn("component_id", F.explode(ids))
    own = type_from_id(c("component_id"))
    kind = F.when(how == "device", F.when(own == "UNKNOWN", "RELAY").otherwise(own)).when(how == "fuse", "FU").when(how.isin("output", "input"), "RELAY").when(how == "power", "BAT").when(how == "keyword", c("keyword.kind")).when(how == "terminal", "TB").otherwise(own)
    given = lambda name, tag: F.when(attribute(tag).isNotNull(), F.struct(F.lit(name).alias("parameter"), attribute(tag).alias("value")))
    values = F.when(how == "device", F.array_compact(F.array(given("relay_assignment", "RELAY"), given("location", "LOC"), given("mount_type", "MOUNT")))).when(how == "fuse", F.array_compact(F.array(given("fuse_rating", "FUSE_SIZE"), given("location", "LOC")))).otherwise(F.array().cast(_VALUE))
    terms = F.map_filter(filled(), lambda k, v: F.contains(k, F.lit("TERM")))
    attributes = F.when(how == "device", F.map_filter(filled(), lambda k, v: ~k.isin(*P.DEVICE_TAGS))).when(how == "fuse", F.map_filter(filled(), lambda k, v: k.isin("LEFT_TERM", "RIGHT_TERM", "TOP_TERM", "BOTTOM_TERM"))).when(how == "output", F.map_filter(filled(), lambda k, v: F.contains(k, F.lit("TERM")) | (k == "POLARITY"))).when(how == "input", F.map_filter(terms, lambda k, v: v != "##")).when(how == "power", terms).otherwise(filled())
    df = df.withColumns({"component_type": kind, "values": values, "attributes": attributes, "at": F.struct("layout", "seq")})
    # one grouping; keyword, terminal and tag blocks give attributes only where they come first
    rows = df.groupBy("drawing_id", "component_id").agg(F.min_by("component_type", "at").alias("component_type"), F.array_sort(F.collect_list(F.struct("at", "how", "values", F.map_entries("attributes").alias("entries")))).alias("rs"))
    tell = F.filter("rs", lambda r, i: ~r["how"].isin("keyword", "terminal", "tag") | (i == 0))
    none = F.create_map().cast("map<string,string>")
    # the last value of an attribute stays
    over = lambda m, n: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(n, k)), n)
    attributes = F.aggregate(F.transform(tell, lambda r: F.map_from_entries(r["entries"])), none, lambda m, n: F.when(F.size(n) == 0, m).otherwise(over(m, n)))
    of = lambda device: F.flatten(F.transform(F.filter("rs", lambda r: (r["how"] == "device") == F.lit(device)), lambda r: r["values"]))
    return rows.select("drawing_id", "component_id", "component_type", F.concat(of(True), F.array_distinct(of(False))).alias("values"), attributes.alias("attributes"))


def block_notes(entities: DataFrame) -> DataFrame:
    """Blocks that no rule takes, as notes and labels."""
    rows = entities.filter(strategy() == "note")
    told = F.array_join(F.transform(F.map_entries("attribs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    return rows.select("drawing_id", "seq", c("block_name").alias("text"), F.lit("block").alias("category"), "x", "y", F.concat(F.lit("Unrecognized electrical block: "), c("block_name"), F.lit(" (attributes: "), told, F.lit(")")).alias("note"))


def attribute_labels(entities: DataFrame) -> DataFrame:
    """The attribute values of blocks that are neither titles nor skipped, as labels."""
    rows = entities.filter(~is_title() & ~is_skipped()).select("drawing_id", "seq", "x", "y", F.explode(filled()).alias("tag", "text"))
    return rows.withColumn("category", entity_category(c("text")))
