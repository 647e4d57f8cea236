"""Components from bill-of-material sheets.

cells: file_name, drawing_id, sheet, sheet_pos, row, col, value.  Only files with BOM in
their name count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import electrical_values, voltages

c = F.col
SHEET = ["drawing_id", "sheet", "sheet_pos"]


def bom_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.contains(F.upper("file_name"), F.lit("BOM"))).withColumn("value", F.trim("value")).filter("value <> ''")


def rows_of(cells: DataFrame) -> DataFrame:
    """One row for each sheet row, its cells as a map of column to text."""
    # a number first in the key, by which cells are sorted faster than by names that begin alike
    return cells.groupBy(F.xxhash64(*SHEET, "row").alias("_h"), *SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells")).drop("_h")


def header_rows(cells: DataFrame) -> DataFrame:
    """Of the first five rows the one with most header words, if two or more; else the first."""
    early = rows_of(cells.filter("row <= 5"))
    upper = F.upper(F.array_join(F.map_values("cells"), " "))
    score = sum((F.contains(upper, F.lit(w)).cast("int") for w in P.HEADER_WORDS), F.lit(0))
    return early.withColumn("score", score).groupBy(F.xxhash64(*SHEET).alias("_h"), *SHEET).agg(F.max_by(F.struct("row", "cells"), F.struct(F.when(c("score") >= 2, c("score")).otherwise(0), -c("row"))).alias("h")).select(*SHEET, c("h.row").alias("header_row"), c("h.cells").alias("header"))


def sheet_kind(header: Column, sheet: Column) -> Column:
    """Nameplate, device_list, material, or empty."""
    cells = F.transform(F.map_values(header), lambda v: F.upper(v))
    has = lambda *words: F.exists(cells, lambda v: v.rlike("|".join(words)))
    return F.when(F.contains(F.array_join(cells, " "), F.lit("NAMEPLATE SCHEDULE")) | F.contains(F.upper(sheet), F.lit("NAMEPLATE")), "nameplate").when(has("ITEM") & has("QTY", "QUANTITY") & has("DEVICE"), "device_list").when(has("ITEM") & has("QTY", "QUANTITY") & (has("MATERIAL") | has("CATALOG")), "material").otherwise("")


def column_of(header: Column, name: str) -> Column:
    """The column of a normalised name: the last that fits; a description only where no material is."""
    def last(test):
        return F.array_max(F.map_keys(F.map_filter(header, lambda k, v: test(F.upper(v)))))

    def lines(n: str, word: str):
        return last(lambda u: F.contains(u, F.lit(word)) | (F.contains(u, F.lit("LINE")) & F.contains(u, F.lit(n))))

    tests = {
        "item": lambda: last(lambda u: F.contains(u, F.lit("ITEM"))),
        "qty": lambda: last(lambda u: u.rlike("QTY|QUANTITY")),
        "catalog": lambda: last(lambda u: F.contains(u, F.lit("CATALOG"))),
        "device": lambda: last(lambda u: F.contains(u, F.lit("DEVICE"))),
        "size": lambda: last(lambda u: F.contains(u, F.lit("SIZE")) & ~F.contains(u, F.lit("LETTER"))),
        "letter_size": lambda: last(lambda u: F.contains(u, F.lit("LETTER"))),
        "material": lambda: F.coalesce(last(lambda u: F.contains(u, F.lit("MATERIAL")) & ~F.contains(u, F.lit("NAMEPLATE"))), F.array_min(F.map_keys(F.map_filter(header, lambda k, v: F.upper(v).rlike("DESCRIPTION|NAME"))))),
        "1st_line": lambda: lines("1", "1ST"),
        "2nd_line": lambda: lines("2", "2ND"),
    }
    return tests[name]()


def cell(name: str) -> Column:
    """Of a row of ``_body`` the text in the column of a normalised name; empty without one."""
    return F.coalesce(F.try_element_at("cells", c(f"col {name}")), F.lit(""))


def material_type(description: Column, qty: Column, catalog: Column) -> Column:
    """E5: the type of a material line; bulk lots first."""
    d = F.upper(description)
    any_of = lambda *words: d.rlike("|".join(w.replace(".", r"\.") for w in words))
    return (
        F.when(F.contains(F.upper(qty), F.lit("LOT")), "CONSUMABLE")
        .when(any_of(*P.CONSUMABLE_WORDS), "CONSUMABLE")
        .when(any_of("TERMINAL BLOCK", "BARRIER"), "TB")
        .when(any_of("FUSE") | F.contains(F.upper(catalog), F.lit("BAF")), "FU")
        .when(any_of("PANEL FOR"), "PANEL")
        .when(any_of("ENCLOSURE", "ENCLOSRE", "CABINET"), "JB")
        .when(any_of("GROUND BAR", "GROUND BUS"), "GND")
        .when(any_of("DIN RAIL"), "BOM")
        .when(any_of("CABLE", "COAX", "RG-58", "FIBER", "BNC"), "CABLE")
        .when(any_of("RESISTOR", "TERMINATOR", "TEE", "T-CONN", "CONNECTOR"), "BOM")
        .when(any_of("POWER SUPPLY"), "PS")
        .otherwise("BOM")
    )


def designation_type(name: Column, description: Column) -> Column:
    """The type of a nameplate by its name, then by its second line."""
    u, d = F.upper(name), F.upper(F.coalesce(description, F.lit("")))
    return (
        F.when(u.rlike(r"^(LT\d+-)?T[BS]\d*$"), "TB")
        .when(u.rlike(r"^FU\d*$") | F.contains(d, F.lit("FUSE")), "FU")
        .when(u.rlike(r"^SW-?\d*$"), "SW")
        .when(d.rlike("JUNCTION BOX|ENCLOSURE"), "JB")
        .when(u.startswith("CT-"), "CT")
        .when(u.startswith("VT-"), "VT")
        .when(u.startswith("PT-"), "PT")
        .when(u.startswith("CCVT"), "CCVT")
        .otherwise("BOM")
    )


def _body(cells: DataFrame, *names: str) -> DataFrame:
    """Rows below their sheet's header, with its kind and the columns of the named cells, which are looked for once a sheet."""
    own = bom_cells(cells)
    heads = header_rows(own).withColumn("kind", sheet_kind(c("header"), c("sheet"))).filter("kind <> ''")
    heads = heads.select(*SHEET, "header_row", "kind", *(column_of(c("header"), n).alias(f"col {n}") for n in names))
    # a bucket's sheets are few and narrow; its rows needn't be sorted to meet them
    return rows_of(own).join(heads.hint("shuffle_hash"), SHEET).filter("row > header_row")


def line_items(cells: DataFrame) -> DataFrame:
    """Material and device lines as components.

    The id is the device, else the catalogue number, else BOM-ITEM-<item>; the second line
    of a drawing with an id gets -<item> (devices) or :<item> (catalogue numbers).
    """
    rows = _body(cells, "item", "qty", "catalog", "material", "device").filter("kind <> 'nameplate'").select(*SHEET, "row", cell("item").alias("item"), cell("qty").alias("qty"), cell("catalog").alias("catalog"), cell("material").alias("description"), cell("device").alias("device_name"))
    rows = rows.filter("item <> '' or description <> '' or catalog <> ''")
    base = F.when(c("device_name") != "", c("device_name")).when(c("catalog") != "", c("catalog")).otherwise(F.concat(F.lit("BOM-ITEM-"), c("item")))
    rows = rows.withColumn("base", base)
    n = F.row_number().over(W.partitionBy(F.xxhash64("drawing_id", "base"), "drawing_id", "base").orderBy("sheet_pos", "row"))
    sign = F.when(c("device_name") != "", F.when(c("n") == 2, "-").otherwise(":")).otherwise(":")
    named = rows.withColumn("n", n).withColumn("component_id", F.when((c("n") == 1) | c("base").startswith("BOM-ITEM-"), c("base")).otherwise(F.concat("base", sign, "item")))
    values = electrical_values(c("description"), "voltage_rating", "current_rating", "impedance")
    return named.select(*SHEET, "row", "component_id", material_type(c("description"), c("qty"), c("catalog")).alias("component_type"), "item", "qty", "catalog", "description", values.alias("values"))


def nameplates(cells: DataFrame) -> DataFrame:
    """Nameplate lines as components; short names get the sheet's prefix. The last row of an id wins."""
    rows = _body(cells, "1st_line", "2nd_line", "item", "size", "letter_size", "qty").filter("kind = 'nameplate'").select(*SHEET, "row", cell("1st_line").alias("line1"), cell("2nd_line").alias("line2"), cell("item").alias("item"), cell("size").alias("size"), cell("letter_size").alias("letter_size"), cell("qty").alias("qty")).filter("line1 <> ''")
    prefix = F.trim(F.replace(F.upper("sheet"), F.lit("NAMEPLATE"), F.lit("")))
    rows = rows.withColumn("prefix", F.when(prefix.isin("", "SCHEDULE"), "").otherwise(prefix))
    placed = F.lit(False)
    for p in P.PLACES:
        placed = placed | c("line1").startswith(p)
    short = (F.length("line1") <= 6) & ~c("line1").rlike(r"^\d") & ~placed
    name = F.when((c("prefix") != "") & (c("line1").isin("TB", "TB1") | short), F.concat("prefix", F.lit("-"), "line1")).otherwise(c("line1"))
    rows = rows.withColumn("component_id", name).withColumn("component_type", designation_type(name, c("line2"))).withColumn("description", F.when(c("line2") != "", c("line2")).otherwise(c("line1")))
    at = F.struct("sheet_pos", "row")
    return rows.groupBy("drawing_id", "component_id").agg(F.min_by("component_type", at).alias("component_type"), F.min_by("description", at).alias("description"), F.max_by("item", at).alias("item"), F.max_by("size", at).alias("size"), F.max_by("qty", at).alias("qty"))


def row_attributes(cells: DataFrame, found: DataFrame, headers: DataFrame) -> DataFrame:
    """For components found in a sheet row, each other cell of the row under its header, or col_<i>; the last wins.

    ``found``: drawing_id, sheet, row, component_id.
    """
    head = headers.select("drawing_id", "sheet", F.explode("header").alias("col", "name"))
    rows = found.join(cells.select("drawing_id", "sheet", "sheet_pos", "row", "col", "value"), ["drawing_id", "sheet", "row"]).filter("value <> component_id").join(head, ["drawing_id", "sheet", "col"], "left")
    key = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("col_"), c("col").cast("string")))
    last = rows.groupBy("drawing_id", "component_id", key.alias("k")).agg(F.max_by("value", F.struct("sheet_pos", "row", "col")).alias("v"))
    return last.groupBy("drawing_id", "component_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attributes"))


#: Drawings of as many ids at most have them tried in their rows.
FEW_IDS = 64


def row_voltages(row_texts: DataFrame, components: DataFrame) -> DataFrame:
    """A voltage in a sheet row goes to the component of the drawing that was seen first and whose id the row holds.

    ``row_texts``: drawing_id, sheet, row, text.  ``components``: drawing_id, component_id, first_seen.
    """
    rows = row_texts.select("drawing_id", "sheet", "row", "text", voltages(c("text")).alias("volts")).filter(F.size("volts") > 0)
    # up to FEW_IDS ids of a drawing go to its rows and are tried there
    place = W.partitionBy("drawing_id").orderBy("first_seen", "component_id")
    known = components.filter("component_id <> ''").select("drawing_id", "component_id", "first_seen", F.row_number().over(place).alias("_k"))
    early = F.collect_list(F.when(c("_k") <= FEW_IDS, F.struct("first_seen", "component_id")))
    ids = known.groupBy("drawing_id").agg(F.max("_k").alias("_n"), early.alias("ids"), F.collect_set(F.length("component_id")).alias("sizes"))
    here = F.array_min(F.filter("ids", lambda i: F.contains("text", i["component_id"])))["component_id"]
    few = rows.join(ids.filter(c("_n") <= FEW_IDS).select("drawing_id", "ids"), "drawing_id").withColumn("component_id", here).filter("component_id is not null").drop("ids", "text")
    # of other drawings, parts of the row as long as the ids are joined by equality: no id is tried in each row
    cut = lambda n: F.when(n <= F.length("text"), F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, n))).otherwise(F.array().cast("array<string>"))
    dense = rows.join(ids.filter(c("_n") > FEW_IDS).select("drawing_id", "sizes"), "drawing_id")
    parts = dense.select("drawing_id", "sheet", "row", F.explode(F.array_distinct(F.flatten(F.transform("sizes", cut)))).alias("component_id"))
    held = parts.join(components.select("drawing_id", "component_id", "first_seen"), ["drawing_id", "component_id"])
    first = held.groupBy("drawing_id", "sheet", "row").agg(F.min_by("component_id", "first_seen").alias("component_id"))
    many = dense.select("drawing_id", "sheet", "row", "volts").join(first, ["drawing_id", "sheet", "row"])
    out = few.unionByName(many).select("drawing_id", "sheet", "row", F.posexplode("volts").alias("pos", "v"), "component_id")
    return out.select("drawing_id", "sheet", "row", "pos", c("v.value").alias("value"), "component_id")
