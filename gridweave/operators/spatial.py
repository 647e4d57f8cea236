"""Joins of labels by place: nearest, bands and boxes, on a grid of cells.

A cell is as wide as the bound, so partners lie in the own cell or a neighbouring one: the
joins are by equality on (drawing, cell) with the bound as a residual condition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written

c = F.col


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width)))


def near_pairs(left: DataFrame, right: DataFrame, dy: float, dx: float | None = None, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """All (left, right) of a drawing with abs(dy) below ``dy`` and, if given, abs(dx) below ``dx``.

    Columns come as l_* and r_*; bounds are strict.
    """
    a = left.select(*keys, *[c(x).alias(f"l_{x}") for x in left.columns if x not in keys]).withColumn("cy", _cell(c("l_y"), dy))
    b = right.select(*keys, *[c(x).alias(f"r_{x}") for x in right.columns if x not in keys])
    b = b.withColumn("cy", F.explode(F.array(*[_cell(c("r_y"), dy) + k for k in (-1, 0, 1)])))
    on = [*keys, "cy"]
    if dx is not None:
        a = a.withColumn("cx", _cell(c("l_x"), dx))
        b = b.withColumn("cx", F.explode(F.array(*[_cell(c("r_x"), dx) + k for k in (-1, 0, 1)])))
        on.append("cx")
    out = a.join(b, on).filter(F.abs(c("l_y") - c("r_y")) < dy)
    if dx is not None:
        out = out.filter(F.abs(c("l_x") - c("r_x")) < dx)
    return out.drop("cy", "cx")


#: Labels of a drawing that each of its values may meet; beyond, values go down a pyramid. Labels of a cell that isn't cut again, and levels.
FEW_LABELS, LEAF_LABELS, LEVELS = 64, 16, 28


def nearest_component(values: DataFrame, labels: DataFrame, components: DataFrame) -> DataFrame:
    """Each value goes to the nearest component label of its drawing, if that is a component there.

    The first label wins ties; a value text counts once for a component.  values: drawing_id,
    seq, value, x, y.  labels: drawing_id, seq, text, x, y.  In a drawing of at most
    ``FEW_LABELS`` labels values meet them all; in others they go down a pyramid of cells.
    """
    keys = ["drawing_id", "seq", "value"]
    labels = labels.select("drawing_id", "seq", "text", "x", "y")
    values = values.select(*keys, "x", "y")
    dense = labels.groupBy("drawing_id").count().filter(c("count") > FEW_LABELS).select("drawing_id")
    at = labels.select("drawing_id", c("seq").alias("lseq"), c("text").alias("component_id"), c("x").alias("lx"), c("y").alias("ly"))
    dense = written(dense, "dense")
    rest = at
    best = None
    if not dense.isEmpty():
        rest = at.join(dense, "drawing_id", "left_anti")
        best = _down(values.join(dense, "drawing_id", "left_semi"), at.join(dense, "drawing_id", "left_semi"))
    near = values.join(rest, "drawing_id").groupBy(*keys).agg(F.min_by("component_id", F.struct(_far(), "lseq")).alias("component_id"))
    best = near if best is None else near.unionByName(best)
    best = best.join(components.select("drawing_id", "component_id"), ["drawing_id", "component_id"], "left_semi")
    return best.groupBy("drawing_id", "component_id", "value").agg(F.min("seq").alias("seq"))


def _far() -> Column:
    return F.sqrt((c("x") - c("lx")) ** 2 + (c("y") - c("ly")) ** 2)


def _spread(n: Column) -> Column:
    """Bits of a whole number below 2**28 at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def _down(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(drawing_id, seq, value, component_id): the nearest label, by a pyramid of cells over each drawing's labels.

    A cell's four parts are the level below.  From the whole drawing downwards a value keeps
    the cells that may hold its nearest label: those that begin nearer than another cell
    surely holds one.  Cells of few labels are compared with; others are looked at part by
    part.  So a value meets a few cells of each level, however many labels there are, and
    labels at one place are one.
    """
    box = labels.groupBy("drawing_id").agg(F.min("lx").alias("x0"), F.min("ly").alias("y0"), F.greatest(F.max("lx") - F.min("lx"), F.max("ly") - F.min("ly"), F.lit(1e-9)).alias("side"))
    points = labels.groupBy("drawing_id", "lx", "ly").agg(F.min("lseq").alias("lseq"), F.min_by("component_id", "lseq").alias("component_id")).join(box, "drawing_id")
    index = lambda x, x0: F.least(F.floor((c(x) - c(x0)) / c("side") * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("long")
    code = F.shiftleft(_spread(index("ly", "y0")), 1).bitwiseOR(_spread(index("lx", "x0")))
    points = written(points.withColumn("code", code), "points")
    open_ = written(values.join(box, "drawing_id").withColumns({"v": F.monotonically_increasing_id(), "cell": F.lit(0).cast("long"), "sure": F.lit(float("inf"))}), "open")
    asked = open_.select("v", "drawing_id", "seq", "value", "x", "y")
    met, level = [], 0
    while level < LEVELS and not open_.isEmpty():
        level += 1
        cell = F.shiftright("code", 2 * (LEVELS - level))
        # the cell's place: least and greatest x and y of its labels are tighter than its borders
        cells = points.groupBy("drawing_id", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("lx").alias("ax"), F.max("lx").alias("bx"), F.min("ly").alias("ay"), F.max("ly").alias("by"))
        cells = cells.withColumn("up", F.shiftright("cell", 2))
        parts = open_.withColumnRenamed("cell", "up").join(cells, ["drawing_id", "up"]).drop("up")
        gap = lambda p, a, b: F.greatest(c(a) - c(p), c(p) - c(b), F.lit(0.0))
        reach = lambda p, a, b: F.greatest(F.abs(c(p) - c(a)), F.abs(c(p) - c(b)))
        least, most = F.sqrt(gap("x", "ax", "bx") ** 2 + gap("y", "ay", "by") ** 2), F.sqrt(reach("x", "ax", "bx") ** 2 + reach("y", "ay", "by") ** 2)
        parts = parts.withColumns({"least": least, "sure": F.least("sure", F.min(most).over(W.partitionBy("v")))})
        # a little more than the sure distance, for what rounding takes
        parts = written(parts.filter(c("least") <= c("sure") * (1 + 1e-9)), "parts")
        leaf = (c("n") <= LEAF_LABELS) | F.lit(level == LEVELS)
        ends = parts.filter(leaf).select("v", "drawing_id", "cell")
        met.append(ends.join(points.withColumn("cell", cell), ["drawing_id", "cell"]).select("v", "lx", "ly", "lseq", "component_id"))
        open_ = parts.filter(~leaf).select(*open_.columns)
    near = reduce(DataFrame.union, met).join(asked, "v")
    return near.groupBy("v", "drawing_id", "seq", "value").agg(F.min_by("component_id", F.struct(_far(), "lseq")).alias("component_id")).drop("v")


def terminal_connections(components: DataFrame, terminals: DataFrame) -> DataFrame:
    """Component labels and terminal labels within 50 in y."""
    return near_pairs(components, terminals, 50).select("drawing_id", c("l_seq").alias("component_seq"), c("l_text").alias("component_id"), c("r_text").alias("terminal"), c("r_seq").alias("terminal_seq"))


def signals(components: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct signal words within 30 in y and 200 in x of a component's labels."""
    return near_pairs(components, labels, 30, 200).groupBy("drawing_id", c("l_text").alias("component_id")).agg(F.array_sort(F.collect_set("r_text")).alias("signals"))


def cable_fill(connections: DataFrame, components: DataFrame, cables: DataFrame) -> DataFrame:
    """The k-th cable within 50 in y of a component's label fills the component's k-th connection without a specification.

    connections: drawing_id, component_id, seq, cable_spec.
    """
    near = near_pairs(components, cables, 50).select("drawing_id", c("l_text").alias("component_id"), c("l_seq").alias("a"), c("r_seq").alias("b"), c("r_text").alias("spec"))
    by = W.partitionBy("drawing_id", "component_id")
    ranked = near.withColumn("k", F.row_number().over(by.orderBy("a", "b"))).select("drawing_id", "component_id", "k", "spec")
    open_ = connections.withColumn("empty", F.coalesce("cable_spec", F.lit("")) == "").withColumn("k", F.when(c("empty"), F.sum(c("empty").cast("int")).over(by.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))))
    return open_.join(ranked, ["drawing_id", "component_id", "k"], "left").withColumn("cable_spec", F.coalesce("spec", "cable_spec")).select(*connections.columns)


def drawing_refs(components: DataFrame, references: DataFrame) -> DataFrame:
    """The references within 40 in y and 200 in x of a component's labels."""
    return near_pairs(components, references, 40, 200).groupBy("drawing_id", c("l_text").alias("component_id")).agg(F.array_sort(F.collect_set("r_text")).alias("drawing_refs"))


def label_connections(labels: DataFrame) -> DataFrame:
    """Pairs of component labels, the earlier first, within 15 in y and 300 in x."""
    return near_pairs(labels, labels, 15, 300).filter("l_seq < r_seq").select("drawing_id", c("l_seq").alias("a"), c("r_seq").alias("b"), c("l_text").alias("from_component"), c("r_text").alias("to_component"))


def wire_segments(entities: DataFrame) -> DataFrame:
    """A segment for a line, n - 1 for a polyline of n points."""
    pairs = F.transform(F.slice("points", F.lit(1), F.size("points") - 1), lambda p, i: F.struct(p.alias("a"), F.get("points", i + 1).alias("b")))
    rows = entities.filter(c("etype").isin("LINE", "LWPOLYLINE") & (F.size("points") >= 2)).select("drawing_id", "seq", F.posexplode(pairs).alias("part", "p"))
    return rows.select("drawing_id", "seq", "part", c("p.a.x").alias("x1"), c("p.a.y").alias("y1"), c("p.b.x").alias("x2"), c("p.b.y").alias("y2"))


def wire_connections(segments: DataFrame, labels: DataFrame, reach: float = 5.0) -> DataFrame:
    """Segments whose ends each have a component within ``reach``; the nearest, and different ones.

    A component's place is that of its last label.
    """
    place = labels.groupBy("drawing_id", "text").agg(F.max_by(F.struct("x", "y", "seq"), "seq").alias("p")).select("drawing_id", "text", "p.x", "p.y", "p.seq")
    ends = segments.select("drawing_id", "seq", "part", F.explode(F.array(F.struct(F.lit(1).alias("end"), c("x1").alias("x"), c("y1").alias("y")), F.struct(F.lit(2).alias("end"), c("x2").alias("x"), c("y2").alias("y")))).alias("e")).select("drawing_id", "seq", "part", "e.end", "e.x", "e.y")
    far = F.sqrt((c("l_x") - c("r_x")) ** 2 + (c("l_y") - c("r_y")) ** 2)
    near = near_pairs(ends, place, reach, reach).withColumn("far", far).filter(c("far") < reach)
    best = near.groupBy("drawing_id", c("l_seq").alias("seq"), c("l_part").alias("part"), c("l_end").alias("end")).agg(F.min_by("r_text", F.struct("far", "r_seq")).alias("component_id"))
    both = best.groupBy("drawing_id", "seq", "part").agg(F.max(F.when(c("end") == 1, c("component_id"))).alias("from_component"), F.max(F.when(c("end") == 2, c("component_id"))).alias("to_component"))
    return both.filter("from_component <> to_component")
