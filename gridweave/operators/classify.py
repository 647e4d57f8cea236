"""Drawing types from the drawing index, the title block and the drawing's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.patterns import DRAWING_TYPES, NUMBER_SERIES, TITLE_TYPES

c = F.col


def normalise_type(text: Column) -> Column:
    """C4: a type's own name, a known title, or the first known title that holds the text or is held by it."""
    upper = F.trim(F.upper(F.coalesce(text, F.lit(""))))
    out = F.lit("UNKNOWN")
    for words, kind in reversed(TITLE_TYPES):
        out = F.when(F.contains(upper, F.lit(words)) | F.contains(F.lit(words), upper), kind).otherwise(out)
    for words, kind in reversed(TITLE_TYPES):
        out = F.when(upper == words, kind).otherwise(out)
    return F.when(upper.isin(*DRAWING_TYPES), upper).otherwise(out)


def by_number(drawing_id: Column) -> Column:
    """By the first run of one to three digits of the id."""
    n = F.nullif(F.regexp_extract(drawing_id, r"(\d{1,3})", 1), F.lit("")).cast("int")
    out = F.lit("UNKNOWN")
    for low, high, kind in reversed(NUMBER_SERIES):
        out = F.when(n.between(low, high), kind).otherwise(out)
    return out


def by_title(title_type: Column) -> Column:
    """C2, and C1 for an index row's type: blank or null passes on to the next strategy."""
    return F.when(F.trim(F.coalesce(title_type, F.lit(""))) == "", "UNKNOWN").otherwise(normalise_type(title_type))


def index_lookup(drawings: DataFrame, index: DataFrame) -> DataFrame:
    """Each drawing with its index row, by the id, the id without its last .x, or the id with or without NRE-.

    ``index`` has a row for each key (see ``index_entries``).  The first key that is there
    decides.
    """
    own = c("drawing_id")
    keys = F.array(own, F.regexp_replace(own, r"\.[^.]*$", ""), F.concat(F.lit("NRE-"), own), F.regexp_replace(own, "^NRE-", ""))
    tried = drawings.select("drawing_id", F.posexplode(keys).alias("rank", "key"))
    hit = tried.join(index.select(c("drawing_number").alias("key"), F.struct(*index.columns).alias("entry")), "key")
    best = hit.groupBy("drawing_id").agg(F.min_by("entry", "rank").alias("entry"))
    return drawings.join(best, "drawing_id", "left")


def classify(drawings: DataFrame, index: DataFrame) -> DataFrame:
    """``drawings`` (with title_type) with drawing_type, strategy, confidence and alternatives.

    The index (1.0) comes before the title block (0.9) and the number (0.7); a strategy that
    finds nothing passes on.  alternatives: the later strategies that say something else.
    """
    df = index_lookup(drawings.drop("drawing_type"), index)
    df = df.withColumns({"t1": by_title(c("entry.drawing_type")), "t2": by_title(c("title_type")), "t3": by_number(c("drawing_id"))})
    some = lambda x: F.nullif(c(x), F.lit("UNKNOWN"))
    kind = F.coalesce(some("t1"), some("t2"), some("t3"), F.lit("UNKNOWN"))
    which = lambda a, b, d, e: F.when(some("t1").isNotNull(), a).when(some("t2").isNotNull(), b).when(some("t3").isNotNull(), d).otherwise(e)
    said = F.array(F.struct(c("t1").alias("type"), F.lit("index").alias("strategy")), F.struct(c("t2").alias("type"), F.lit("title_block").alias("strategy")), F.struct(c("t3").alias("type"), F.lit("number_series").alias("strategy")))
    df = df.withColumn("drawing_type", kind).withColumn("strategy", which("index", "title_block", "number_series", "none")).withColumn("confidence", which(F.lit(1.0), F.lit(0.9), F.lit(0.7), F.lit(0.0)))
    return df.withColumn("alternatives", F.filter(said, lambda x: (x["type"] != "UNKNOWN") & (x["type"] != c("drawing_type")))).drop("t1", "t2", "t3")


def enrich(classified: DataFrame) -> DataFrame:
    """An empty title or revision is filled from the index row."""
    fill = lambda own, of: F.coalesce(F.nullif(F.coalesce(c(own), F.lit("")), F.lit("")), c(of), F.lit(""))
    return classified.withColumns({"title": fill("title", "entry.drawing_title"), "revision": fill("revision", "entry.current_revision")})


def records(classified: DataFrame) -> DataFrame:
    """One CLASSIFICATION decision for each drawing."""
    return classified.select(stable_id(c("drawing_id"), "CLASSIFICATION").alias("decision_id"), F.current_timestamp().alias("timestamp"), F.lit("CLASSIFICATION").alias("decision_type"), F.lit("").alias("component_id"), "drawing_id", F.create_map(F.lit("strategy"), c("strategy")).alias("input_data"), F.concat(F.lit("by "), c("strategy")).alias("reasoning"), "confidence", c("drawing_type").alias("outcome"), "alternatives")


#: How many parts a sheet's rows are dealt into.
SHEET_PARTS = 256


def index_entries(cells: DataFrame) -> DataFrame:
    """Index rows by drawing number, from the cells of index workbooks.

    The header lies in the first 20 rows, in cells of up to 30 characters: a number column
    (DWG or DRAWING with NO, NUM or #, or alone; if no sheet row has one, any with DWG or
    DRAWING), a TYPE column, perhaps a TITLE, and REV columns, each with the date column to
    its left if that says DATE or nothing.  The last revision that isn't empty is current.
    Later design phases (30 < 60 < 90) win; each row counts with and without NRE-.
    ``cells``: file_name, sheet, sheet_pos, row, col, value.
    """
    sheet = ["file_name", "sheet", "sheet_pos"]
    up = F.trim(F.upper("value"))
    head = cells.filter((c("row") <= 20) & (F.length(up) <= 30) & (up != "")).withColumn("up", up)
    number = c("up").rlike("DWG|DRAWING")
    strict = number & (c("up").rlike("NO|NUM|#") | c("up").isin("DWG", "DRAWING"))
    place = F.struct("row", "col")
    first = lambda test: F.min(F.when(test, place))
    cols = head.groupBy(*sheet).agg(F.coalesce(first(strict), first(number)).alias("dwg"), first(F.contains("up", F.lit("TYPE"))).alias("type"), first(F.contains("up", F.lit("TITLE"))).alias("title"))
    cols = cols.filter("dwg is not null and type is not null").withColumn("header", c("dwg.row"))
    revs = head.join(cols.select(*sheet, "header"), sheet).filter(c("row") == c("header")).groupBy(*sheet).agg(F.map_from_entries(F.collect_list(F.struct("col", "up"))).alias("heads"))
    # a sheet may hold any share of the cells: its header meets them in as many parts
    part = F.pmod("row", F.lit(SHEET_PARTS)).cast("int")
    headed = cols.join(revs, sheet, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SHEET_PARTS - 1)))).repartition(*sheet, "part")
    body = cells.withColumn("part", part).join(headed, [*sheet, "part"]).filter("row > header").groupBy(*sheet, "row", c("dwg.col").alias("dc"), c("type.col").alias("tc"), c("title.col").alias("nc"))
    body = body.agg(F.map_from_entries(F.collect_list(F.struct("col", F.trim("value").alias("v")))).alias("cells"), F.any_value("heads").alias("heads"))
    at = lambda x: F.coalesce(F.try_element_at("cells", x), F.lit(""))
    rev_cols = F.array_sort(F.map_keys(F.map_filter("heads", lambda k, v: F.contains(v, F.lit("REV")))))
    head_of = lambda x: F.coalesce(F.try_element_at("heads", x), F.lit(""))
    dated = lambda x: F.when((x > F.lit(0)) & (F.contains(head_of(x - 1), F.lit("DATE")) | (head_of(x - 1) == "")), at(x - 1)).otherwise("")
    history = F.filter(F.transform(rev_cols, lambda x: F.struct(at(x).alias("revision"), dated(x).alias("date"))), lambda h: h["revision"] != "")
    rows = body.withColumn("revision_history", F.coalesce(history, F.array().cast("array<struct<revision:string,date:string>>"))).select(*sheet, "row", at(c("dc")).alias("drawing_number"), at(c("tc")).alias("drawing_type"), F.when(c("nc").isNotNull(), at(c("nc"))).otherwise("").alias("drawing_title"), "revision_history").filter("drawing_number <> '' and drawing_type <> ''")
    phase = F.when(F.contains("sheet", F.lit("90")), "90%").when(F.contains("sheet", F.lit("60")), "60%").when(F.contains("sheet", F.lit("30")), "30%").otherwise("")
    last = lambda f: F.coalesce(F.try_element_at("revision_history", F.lit(-1)).getField(f), F.lit(""))
    rows = rows.withColumn("design_phase", phase).withColumn("current_revision", last("revision")).withColumn("current_revision_date", last("date"))
    rank = F.when(F.contains("sheet", F.lit("30")), 0).when(F.contains("sheet", F.lit("60")), 1).when(F.contains("sheet", F.lit("90")), 2).otherwise(-1)
    other = F.when(c("drawing_number").startswith("NRE-"), F.regexp_replace("drawing_number", "^NRE-", "")).otherwise(F.concat(F.lit("NRE-"), c("drawing_number")))
    keyed = rows.withColumn("order", F.struct(rank.alias("rank"), "sheet_pos", "row")).withColumn("key", F.explode(F.array("drawing_number", other)))
    kept = ["drawing_type", "drawing_title", "current_revision", "current_revision_date", "design_phase", "revision_history"]
    return keyed.groupBy(c("key").alias("drawing_number")).agg(F.max_by(F.struct(*kept), "order").alias("e")).select("drawing_number", *[f"e.{k}" for k in kept])
