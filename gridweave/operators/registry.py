"""Lookups, joins, counts and lists over the registry's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import severity_rank

c = F.col


def get_drawing(drawings: DataFrame, drawing_id: str) -> DataFrame:
    """P1."""
    return drawings.filter(c("drawing_id") == drawing_id)


def drawing_ids(drawings: DataFrame) -> DataFrame:
    """All ids, sorted."""
    return drawings.select("drawing_id").orderBy("drawing_id")


def cross_refs_of(drawings: DataFrame, drawing_id: str) -> DataFrame:
    """P3."""
    return get_drawing(drawings, drawing_id).select(F.posexplode("cross_references").alias("pos", "ref"))


def component_values(components: DataFrame, component_id: str) -> DataFrame:
    """The values of a component by drawing."""
    return components.filter(c("component_id") == component_id).select("drawing_id", F.posexplode("values").alias("pos", "v")).select("drawing_id", "pos", "v.*")


def connections_of(connections: DataFrame, component_id: str, narrow: bool = False) -> DataFrame:
    """P5: connections with the component at either end; narrow: five columns."""
    out = connections.filter((c("from_component") == component_id) | (c("to_component") == component_id))
    return out.select("drawing_id", "from_component", "to_component", "signal_type", "cable_spec") if narrow else out


def drawings_by_type(drawings: DataFrame, drawing_type: str) -> DataFrame:
    """P6."""
    return drawings.filter(c("drawing_type") == drawing_type).select("drawing_id")


def resolve_mismatch(mismatches: DataFrame, mismatch_id: str) -> DataFrame:
    """The table with one row marked resolved now."""
    hit = c("mismatch_id") == mismatch_id
    return mismatches.withColumns({"resolved": F.when(hit, F.lit(True)).otherwise(c("resolved")), "resolved_at": F.when(hit, F.current_timestamp()).otherwise(c("resolved_at"))})


def optional_filters(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal all the values that are given."""
    given = [c(k) == v for k, v in equal.items() if v is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def name_like(name: Column, prefix: str, inner: str | None = None) -> Column:
    """Begins with ``prefix`` in any case, with ``inner`` somewhere after it. % and _ in ids are themselves."""
    literal = prefix.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return name.ilike(literal + "%" + (f"{inner}%" if inner else ""))


def involving(mismatches: DataFrame, drawing_id: str) -> DataFrame:
    """P10: the mismatches that a drawing takes part in."""
    return mismatches.filter(F.array_contains("drawings_involved", drawing_id))


def components_with_drawings(components: DataFrame, drawings: DataFrame) -> DataFrame:
    """Instances with their drawing's type, title and revision."""
    return components.join(drawings.select("drawing_id", "drawing_type", "title", "revision"), "drawing_id")


def all_components(components: DataFrame) -> DataFrame:
    """A1: each component and its drawings, sorted."""
    return components.groupBy("component_id").agg(F.array_sort(F.collect_list("drawing_id")).alias("drawings"))


def shared_components(components: DataFrame, least: int = 2) -> DataFrame:
    """A2: components in ``least`` drawings or more, the most frequent first.

    Counted first, so that lists are gathered for those alone.
    """
    many = components.groupBy("component_id").agg(F.count("*").alias("n_drawings")).filter(c("n_drawings") >= least)
    lists = components.join(many.select("component_id"), "component_id", "left_semi").groupBy("component_id").agg(F.array_sort(F.collect_list("drawing_id")).alias("drawings"))
    return many.join(lists, "component_id").orderBy(F.desc("n_drawings"), "component_id")


def statistics(drawings: DataFrame, components: DataFrame, connections: DataFrame, labels: DataFrame, mismatches: DataFrame) -> DataFrame:
    """A3: one row of seven counts, as name and count rows united and turned."""
    shared = components.groupBy("component_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("u"), F.count_if(c("k") >= 2).alias("s"))
    parts = [
        drawings.agg(F.count("*").alias("n")).withColumn("what", F.lit("drawings")),
        components.agg(F.count("*").alias("n")).withColumn("what", F.lit("component_instances")),
        shared.select(c("u").alias("n"), F.lit("unique_components").alias("what")),
        shared.select(c("s").alias("n"), F.lit("shared_components").alias("what")),
        connections.agg(F.count("*").alias("n")).withColumn("what", F.lit("connections")),
        labels.agg(F.count("*").alias("n")).withColumn("what", F.lit("labels")),
        mismatches.filter("not resolved").agg(F.count("*").alias("n")).withColumn("what", F.lit("active_mismatches")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    names = ["drawings", "component_instances", "unique_components", "shared_components", "connections", "labels", "active_mismatches"]
    return every.agg(*[F.max(F.when(c("what") == w, c("n"))).alias(w) for w in names])


def conflict_groups(last_values: DataFrame) -> DataFrame:
    """A4: parameters of components with more than one value."""
    return last_values.groupBy("component_id", "parameter").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_drawings")).filter("n_values > 1")


def mismatch_summary(mismatches: DataFrame) -> DataFrame:
    """Unresolved mismatches, in all and by severity."""
    of = lambda s: F.count_if(c("severity") == s)
    return mismatches.filter("not resolved").agg(F.count("*").alias("total"), of("CRITICAL").alias("critical"), of("WARNING").alias("warning"), of("INFO").alias("info"))


def type_counts(drawings: DataFrame) -> DataFrame:
    """A10."""
    return drawings.groupBy("drawing_type").agg(F.count("*").alias("n"))


PROTECTION = ("52", "50", "51", "86", "87", "89", "21", "25", "27", "59", "67", "81", "79", "RELAY")


def completeness(components: DataFrame, connections: DataFrame) -> DataFrame:
    """A row for each component of a drawing without values, and for protection equipment without connections there."""
    ends = connections.select("drawing_id", F.explode(F.array("from_component", "to_component")).alias("component_id")).distinct()
    joined = components.join(ends.withColumn("tied", F.lit(True)), ["drawing_id", "component_id"], "left")
    flags = F.array_compact(F.array(F.when(F.size("values") == 0, "no values"), F.when(c("component_type").isin(*PROTECTION) & c("tied").isNull(), "no connections")))
    return joined.select("drawing_id", "component_id", "component_type", F.explode(flags).alias("issue"))


def active_mismatches(mismatches: DataFrame) -> DataFrame:
    """O1: unresolved ones, the gravest first, then the newest."""
    return mismatches.filter("not resolved").orderBy(severity_rank(c("severity")), F.desc("detected_at"), "mismatch_id")


def newest(log: DataFrame, n: int, time_col: str, tie: str, **equal: str | None) -> DataFrame:
    """The newest ``n`` rows of a log, with optional filters."""
    return optional_filters(log, **equal).orderBy(F.desc(time_col), tie).limit(n)


def truncated(names: Column, n: int) -> Column:
    """The first ``n`` names, and how many more there are."""
    more = F.size(names) - n
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def same_values(a: Column, b: Column) -> Column:
    """Equal sets of (parameter, value), whatever their order."""
    pairs = lambda v: F.array_sort(F.array_distinct(F.transform(v, lambda x: F.struct(x["parameter"].alias("parameter"), x["value"].alias("value")))))
    return pairs(a) == pairs(b)


def lockouts_near(connections: DataFrame, components: DataFrame) -> DataFrame:
    """For each component, the lockout relays that a connection joins it to, in either direction."""
    ids = components.filter("component_type = '86'").select(c("component_id").alias("lockout")).distinct()
    to = connections.join(ids, c("to_component") == c("lockout")).select(c("from_component").alias("component_id"), "lockout")
    back = connections.join(ids, c("from_component") == c("lockout")).select(c("to_component").alias("component_id"), "lockout")
    return to.union(back).distinct()
