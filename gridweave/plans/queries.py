"""Queries over the derived registry, one for each operator, and SQL with the same rows.

Maps and arrays come out as joined strings in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import audit, authority, bom, cables, cad, changes, checks, classify, propagation, registry, reports, spatial
from ..sources import decoded, files
from ..sources import registry as registry_files
from ..sources.registry import Table, append
from ..sources.store import new_path, written
from ..streaming import upkeep, watch
from .corpus import Registry, with_tables

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str = ""):
    """Registers a function of the registry; ``tables`` are what ``sql`` (the rest after WITH) needs."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Registry(spark, sf_dir))
        if sql:
            ORACLES[name] = with_tables(*tables.split()) + ("\n" if sql.lstrip().upper().startswith("SELECT") else ",\n") + sql
        return f

    return add


def _text_map(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def flat(df: DataFrame) -> DataFrame:
    """A mismatch row as strings."""
    return df.select("mismatch_id", "severity", "component_id", "parameter", F.array_join(F.array_sort("drawings_involved"), ",").alias("drawings"), _text_map(c("values_found")).alias("found"), "message")


_ID = "substr(sha256({}), 1, 24)"
_SEVERITY = "CASE WHEN parameter IN ('voltage_rating', 'current_rating', 'power_rating') THEN 'CRITICAL' WHEN parameter IN ('impedance', 'ratio', 'cable_specification') THEN 'WARNING' ELSE 'INFO' END"
_RULES = "rule(parameter, ctype, rank, dtype, n) AS (VALUES " + ", ".join(f"('{p}', '{t}', {k}, '{d}', {len(o)})" for p, ts, o in P.AUTHORITY_RULES for t in ts for k, d in enumerate(o, 1)) + ")"
_LAST = "last AS (SELECT component_id, drawing_id, parameter, arg_max(value, pos) AS value FROM line GROUP BY ALL)"
_FIRST = "first AS (SELECT component_id, drawing_id, parameter, arg_min(value, pos) AS value FROM line GROUP BY ALL)"


def _found_sql(keys: str, value: str, source: str) -> str:
    return f"g AS (SELECT {keys}, string_agg(drawing_id, ',' ORDER BY drawing_id) AS drawings, string_agg(drawing_id || '=' || {value}, ', ' ORDER BY drawing_id) AS found FROM {source} GROUP BY {keys} HAVING count(DISTINCT {value}) > 1)"


def _edges() -> str:
    return "edge AS (SELECT from_component AS a, to_component AS b FROM connection UNION SELECT to_component, from_component FROM connection)"


_LISTED = "listed AS (SELECT component_id, string_agg(drawing_id, ',' ORDER BY drawing_id) AS drawings FROM component GROUP BY component_id)"


# Consistency checks


@query("m1_value_mismatch", "line", f"{_LAST}, {_found_sql('component_id, parameter', 'value', 'last')} SELECT {_ID.format("component_id || '|' || parameter || '|value_mismatch'")} AS mismatch_id, {_SEVERITY} AS severity, component_id, parameter, drawings, found FROM g")
def m1(r: Registry) -> DataFrame:
    return flat(checks.value_mismatch(r.typed, r.drawings, authority.default_rules(r.spark)))


@query(
    "m1_resolution_options",
    "line drawing component",
    f"""{_LAST}, {_RULES},
bad AS (SELECT component_id, parameter FROM last GROUP BY ALL HAVING count(DISTINCT value) > 1),
kind AS (SELECT component_id, arg_min(component_type, drawing_id) AS ct FROM component GROUP BY component_id),
held AS (SELECT l.*, CASE WHEN d.drawing_type = '' THEN 'UNKNOWN' ELSE d.drawing_type END AS drawing_type, ct FROM last l JOIN bad USING (component_id, parameter) JOIN drawing d USING (drawing_id) JOIN kind USING (component_id)),
best AS (SELECT component_id, parameter, drawing_id AS auth FROM (SELECT h.*, row_number() OVER (PARTITION BY h.component_id, h.parameter ORDER BY rank, drawing_id) AS k FROM held h JOIN rule r ON r.parameter = h.parameter AND r.dtype = h.drawing_type AND (r.ctype = '*' OR r.ctype = h.ct)) WHERE k = 1)
SELECT component_id, parameter, drawing_id, value, drawing_type, coalesce(drawing_id = auth, false) AS is_authoritative FROM held LEFT JOIN best USING (component_id, parameter)""",
)
def m1_options(r: Registry) -> DataFrame:
    df = checks.value_mismatch(r.typed, r.drawings, authority.default_rules(r.spark))
    return df.select("component_id", "parameter", F.explode("resolution_options").alias("o")).select("component_id", "parameter", "o.*")


@query("m2_type_mismatch", "component", f"{_found_sql('component_id', 'component_type', 'component')} SELECT {_ID.format("component_id || '|type|type_mismatch'")} AS mismatch_id, 'WARNING' AS severity, component_id, 'component_type' AS parameter, drawings, found FROM g")
def m2(r: Registry) -> DataFrame:
    return flat(checks.type_mismatch(r.components))


@query("m3_broken_ref", "reference drawing", f"u AS (SELECT DISTINCT drawing_id, ref, CASE WHEN starts_with(ref, 'NRE-') THEN ref ELSE 'NRE-' || ref END AS f FROM reference) SELECT {_ID.format("drawing_id || '|' || ref || '|broken_ref'")} AS mismatch_id, 'WARNING' AS severity, drawing_id AS component_id, 'cross_reference' AS parameter, drawing_id AS drawings, drawing_id || '=' || ref AS found FROM u WHERE f NOT IN (SELECT drawing_id FROM drawing)")
def m3(r: Registry) -> DataFrame:
    return flat(checks.broken_ref(r.drawings))


@query(
    "m4_cable_mismatch",
    "connection",
    f"p AS (SELECT least(from_component, to_component) AS a, greatest(from_component, to_component) AS b, drawing_id, arg_max(cable_spec, seq) AS spec FROM connection WHERE cable_spec <> '' GROUP BY ALL), {_found_sql('a, b', 'spec', 'p')} SELECT {_ID.format("a || '-' || b || '|cable|cable_mismatch'")} AS mismatch_id, 'WARNING' AS severity, a || ' <-> ' || b AS component_id, 'cable_specification' AS parameter, drawings, found FROM g",
)
def m4(r: Registry) -> DataFrame:
    return flat(checks.cable_mismatch(r.connections))


@query(
    "m5_tb_conflict",
    "terminal",
    f"g AS (SELECT block, string_agg(drawing_id, ',' ORDER BY drawing_id) AS drawings, string_agg(drawing_id || '=' || terminals, ', ' ORDER BY drawing_id) AS found FROM terminal GROUP BY block HAVING count(*) >= 2 AND max(terminals) > 2 * min(terminals) AND min(terminals) > 0) SELECT {_ID.format("block || '|terminals|tb_conflict'")} AS mismatch_id, 'INFO' AS severity, block AS component_id, 'terminal_count' AS parameter, drawings, found FROM g",
)
def m5(r: Registry) -> DataFrame:
    return flat(checks.tb_conflict(r.drawings))


@query("m6_voltage_mismatch", "line", f"{_LAST}, v AS (SELECT * FROM last WHERE parameter = 'voltage_rating'), {_found_sql('component_id', 'value', 'v')} SELECT {_ID.format("component_id || '|voltage|voltage_mismatch'")} AS mismatch_id, 'CRITICAL' AS severity, component_id, 'voltage_rating' AS parameter, drawings, found FROM g")
def m6(r: Registry) -> DataFrame:
    return flat(checks.voltage_mismatch(r.typed, r.drawings, authority.default_rules(r.spark)))


_DEVICE = "dev AS (SELECT drawing_id, component_id, arg_max(device, pos) AS device FROM line WHERE device <> '' GROUP BY ALL), rel AS (SELECT d.* FROM dev d JOIN component c USING (drawing_id, component_id) WHERE component_type = 'RELAY')"


@query("m7_relay_mismatch", "line component", f"{_DEVICE}, {_found_sql('component_id', 'device', 'rel')} SELECT {_ID.format("component_id || '|device|relay_mismatch'")} AS mismatch_id, 'WARNING' AS severity, component_id, 'associated_device' AS parameter, drawings, found FROM g")
def m7(r: Registry) -> DataFrame:
    return flat(checks.relay_mismatch(r.components))


@query(
    "m8_orphan",
    "component reference",
    f"""s AS (SELECT component_id, min(drawing_id) AS drawing_id FROM component GROUP BY component_id HAVING count(*) = 1),
o AS (SELECT s.component_id, s.drawing_id, r.drawing_id AS other FROM s JOIN (SELECT DISTINCT drawing_id, ref FROM reference) r ON r.ref = replace(s.drawing_id, 'NRE-', '') AND r.drawing_id <> s.drawing_id),
e AS (SELECT component_id, drawing_id, drawing_id AS d, 'present' AS w FROM (SELECT DISTINCT component_id, drawing_id FROM o) UNION ALL SELECT component_id, drawing_id, other, 'referenced but missing' FROM o)
SELECT {_ID.format("component_id || '|' || drawing_id || '|orphan'")} AS mismatch_id, 'INFO' AS severity, component_id, 'drawing_coverage' AS parameter, string_agg(d, ',' ORDER BY d) AS drawings, string_agg(d || '=' || w, ', ' ORDER BY d) AS found FROM e GROUP BY component_id, drawing_id""",
)
def m8(r: Registry) -> DataFrame:
    return flat(checks.orphan(r.components, r.drawings))


_PROTECTIVE = ", ".join(f"'{x}'" for x in P.PROTECTIVE)


@query(
    "m9_trip_path",
    "component connection",
    f"""{_edges()}, {_LISTED},
br AS (SELECT substr(component_id, instr(component_id, '-') + 1) AS suffix, max(component_id) AS breaker FROM component WHERE component_type = '52' AND contains(component_id, '-') AND NOT contains(substr(component_id, instr(component_id, '-') + 1), '.') GROUP BY 1),
re AS (SELECT DISTINCT component_id, substr(component_id, instr(component_id, '-') + 1) AS suffix FROM component WHERE component_type IN ({_PROTECTIVE}) AND NOT contains(component_id, '.') AND contains(component_id, '-')),
lo AS (SELECT DISTINCT component_id FROM component WHERE component_type = '86'),
x AS (SELECT component_id, breaker FROM re JOIN br USING (suffix))
SELECT {_ID.format("x.component_id || '|' || breaker || '|trip_path'")} AS mismatch_id, 'WARNING' AS severity, x.component_id, 'trip_path' AS parameter, drawings,
  CASE WHEN x.component_id < breaker THEN x.component_id || '=no trip path found, ' || breaker || '=expected breaker' ELSE breaker || '=expected breaker, ' || x.component_id || '=no trip path found' END AS found
FROM x JOIN listed ON listed.component_id = x.component_id
WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.a = x.component_id AND e.b = breaker)
  AND NOT EXISTS (SELECT 1 FROM edge e JOIN lo ON lo.component_id = e.b JOIN edge f ON f.a = e.b WHERE e.a = x.component_id AND f.b = breaker)
  AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.a = x.component_id || ' RELAY' AND (e.b = breaker OR e.b ILIKE '86%' OR e.a ILIKE '86%'))""",
)
def m9(r: Registry) -> DataFrame:
    return flat(checks.trip_path(r.components, r.connections))


@query(
    "m10_lockout",
    "component connection",
    f"""{_LISTED}, l AS (SELECT DISTINCT component_id FROM component WHERE component_type = '86'),
n AS (SELECT component_id, (SELECT count(*) FROM connection WHERE to_component = component_id) AS i, (SELECT count(*) FROM connection WHERE from_component = component_id) AS o FROM l)
SELECT {_ID.format("component_id || '|' || CASE WHEN i = 0 AND o = 0 THEN 'lockout_completeness' WHEN i = 0 THEN 'lockout_no_input' ELSE 'lockout_no_output' END")} AS mismatch_id, 'WARNING' AS severity, component_id,
  CASE WHEN i = 0 AND o = 0 THEN 'lockout_connections' WHEN i = 0 THEN 'lockout_input' ELSE 'lockout_output' END AS parameter, drawings,
  CASE WHEN i = 0 AND o = 0 THEN component_id || '=no inputs and no outputs' WHEN i = 0 THEN component_id || '=no input connections, outputs=' || o ELSE component_id || '=no output connections, inputs=' || i END AS found
FROM n JOIN listed USING (component_id) WHERE i = 0 OR o = 0""",
)
def m10(r: Registry) -> DataFrame:
    return flat(checks.lockout(r.components, r.connections))


@query(
    "m11_ct_relay",
    "component connection",
    f"""{_LISTED}, rel AS (SELECT DISTINCT component_id FROM component WHERE component_type IN ({_PROTECTIVE}, 'RELAY')),
e AS (SELECT from_component AS a, to_component AS b, drawing_id, seq FROM connection UNION ALL SELECT to_component, from_component, drawing_id, seq FROM connection WHERE from_component <> to_component),
ct AS (SELECT DISTINCT component_id FROM component WHERE component_type = 'CT' AND component_id NOT IN (SELECT a FROM e WHERE b IN (SELECT component_id FROM rel))),
near AS (SELECT a, string_agg(b, ', ' ORDER BY drawing_id, seq, b) AS w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY drawing_id, seq, b) AS k FROM e) WHERE k <= 5 GROUP BY a)
SELECT {_ID.format("component_id || '|ct_relay_assoc'")} AS mismatch_id, 'INFO' AS severity, component_id, 'relay_association' AS parameter, drawings, component_id || '=connections: ' || coalesce(w, 'none') || ', relay_connection=none found' AS found FROM ct JOIN listed USING (component_id) LEFT JOIN near ON a = component_id""",
)
def m11(r: Registry) -> DataFrame:
    return flat(checks.ct_relay(r.components, r.connections))


_SUPPLIED = ", ".join(f"'{x}'" for x in P.DC_SUPPLIED)


@query(
    "m12_dc_supply",
    "component connection line",
    f"""{_edges()}, {_LISTED}, ids AS (SELECT component_id, min(component_type) AS ct FROM component WHERE component_type IN ({_SUPPLIED}) AND NOT contains(component_id, '.') GROUP BY component_id),
s AS (SELECT DISTINCT upper(b) AS u, b FROM edge WHERE a ILIKE '%DC%'), p AS (SELECT DISTINCT upper(a) AS u FROM edge WHERE a ILIKE '%PWR%'),
sig AS (SELECT DISTINCT component_id FROM line WHERE signal ILIKE '%POWER%' OR signal ILIKE '%DC%')
SELECT {_ID.format("component_id || '|dc_supply'")} AS mismatch_id, 'INFO' AS severity, component_id, 'dc_supply' AS parameter, drawings, component_id || '=no DC supply connection found' AS found, component_id || ' (' || ct || ') has no DC supply.' AS message FROM ids JOIN listed USING (component_id)
WHERE NOT EXISTS (SELECT 1 FROM s WHERE starts_with(s.u, upper(component_id))) AND NOT EXISTS (SELECT 1 FROM s WHERE s.b = 'BREAKER ' || component_id)
  AND component_id || '.PWR' NOT IN (SELECT component_id FROM component) AND component_id NOT IN (SELECT component_id FROM sig)
  AND NOT EXISTS (SELECT 1 FROM p WHERE starts_with(p.u, upper(component_id)) AND contains(substr(p.u, length(component_id) + 1), 'PWR'))""",
)
def m12(r: Registry) -> DataFrame:
    return flat(checks.dc_supply(r.components, r.connections))


#: What each check says, from the other columns of its rows; m12 says it by itself.
_MESSAGES = {
    "m1_value_mismatch": "component_id || ': values of ' || parameter || ' differ: ' || found",
    "m2_type_mismatch": "component_id || ': types differ: ' || found",
    "m3_broken_ref": "component_id || ' refers to ' || substr(found, length(component_id) + 2) || ', which was not scanned.'",
    "m4_cable_mismatch": "'Cables between ' || replace(component_id, ' <-> ', ' and ') || ' differ: ' || found",
    "m5_tb_conflict": "'Terminal counts of ' || component_id || ' differ: ' || found",
    "m6_voltage_mismatch": "component_id || ': voltage ratings differ: ' || found",
    "m7_relay_mismatch": "component_id || ': associated devices differ: ' || found",
    "m8_orphan": "component_id || ' is only in ' || regexp_extract(found, '([^ ,=]+)=present', 1) || ', to which ' || (len(string_split(drawings, ',')) - 1) || ' drawings refer: ' || array_to_string(list_filter(string_split(drawings, ','), lambda d: d <> regexp_extract(found, '([^ ,=]+)=present', 1))[:5], ', ')",
    "m9_trip_path": "component_id || ' has no way to ' || regexp_extract(found, '(?:^|, )([^=]*)=expected breaker', 1) || ', direct or over a lockout relay.'",
    "m10_lockout": "'Lockout relay ' || component_id || CASE parameter WHEN 'lockout_connections' THEN ' has neither inputs nor outputs.' WHEN 'lockout_input' THEN ' has no inputs.' ELSE ' has no outputs.' END",
    "m11_ct_relay": "component_id || ' is connected to no protective relay.'",
}
for _name, _said in _MESSAGES.items():
    ORACLES[_name] = f"SELECT *, {_said} AS message FROM ({ORACLES[_name]})"


def _every_check() -> str:
    return " UNION ALL ".join(f"SELECT mismatch_id, severity, component_id, parameter, drawings, found, message FROM ({ORACLES[n]})" for n in CHECKS)


#: The twelve checks.
CHECKS = tuple(n for n in QUERIES if n[0] == "m" and n != "m1_resolution_options")


def _every(r: Registry) -> DataFrame:
    """All checks, for which drawings needn't be put together: what is asked of them is there in parts."""
    references, blocks = r.raw("reference").select("drawing_id", "ref"), r.raw("terminal").select("drawing_id", "block", c("terminals").cast("int").alias("n"))
    return checks.all_checks(r.raw("drawing"), r.typed, r.connections, authority.default_rules(r.spark), references, blocks, scanned=r.raw("drawing").select("drawing_id"), buckets=r.buckets)


@query("u1_all_checks")
def u1(r: Registry) -> DataFrame:
    return flat(_every(r))


@query("a7_mismatch_summary")
def a7(r: Registry) -> DataFrame:
    found = _every(r)
    return registry.mismatch_summary(found.withColumn("resolved", F.lit(False)))


ORACLES["u1_all_checks"] = _every_check()
ORACLES["a7_mismatch_summary"] = f"SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info FROM ({_every_check()})"


# Authority, propagation, changes


@query(
    "y1_authority",
    "component line",
    f"{_RULES}, k AS (SELECT DISTINCT parameter, component_type FROM line), r AS (SELECT k.*, rule.rank, rule.dtype, rule.ctype FROM k JOIN rule ON rule.parameter = k.parameter AND rule.ctype IN ('*', k.component_type)) SELECT parameter, component_type, string_agg(dtype, ',' ORDER BY rank) AS types FROM r GROUP BY ALL",
)
def y1(r: Registry) -> DataFrame:
    keys = r.raw("line").select("parameter", "component_type").distinct()
    return authority.rules_for(keys, authority.default_rules(r.spark)).select("parameter", "component_type", F.array_join("authority_order", ",").alias("types"))


_PLAN = f"""{_FIRST}, {_RULES},
bad AS (SELECT component_id, parameter FROM first GROUP BY ALL HAVING count(DISTINCT value) > 1),
kind AS (SELECT component_id, arg_min(component_type, drawing_id) AS ct FROM component GROUP BY component_id),
held AS (SELECT f.*, d.drawing_type, ct FROM first f JOIN bad USING (component_id, parameter) JOIN drawing d USING (drawing_id) JOIN kind USING (component_id)),
best AS (SELECT component_id, parameter, drawing_id AS auth, drawing_type || ' is authoritative for ' || parameter || ' (priority ' || rank || ' of ' || n || ')' AS basis FROM (SELECT h.*, rank, n, row_number() OVER (PARTITION BY h.component_id, h.parameter ORDER BY rank, drawing_id) AS k FROM held h JOIN rule r ON r.parameter = h.parameter AND r.dtype = h.drawing_type AND (r.ctype = '*' OR r.ctype = h.ct)) WHERE k = 1),
src AS (SELECT h.component_id, h.parameter, coalesce(any_value(auth), min(drawing_id)) AS s, coalesce(any_value(basis), 'No authority rule for ' || h.parameter || '; defaulting to first available drawing') AS basis FROM held h LEFT JOIN best USING (component_id, parameter) GROUP BY h.component_id, h.parameter),
act AS (SELECT substr(sha256(s || '|' || h.drawing_id || '|' || h.component_id || '|' || h.parameter), 1, 24) AS action_id, s AS source_drawing_id, h.drawing_id AS target_drawing_id, h.component_id, h.parameter, h.value AS old_value, f.value AS new_value, basis AS authority_basis, 'PROPOSED' AS status
  FROM held h JOIN src USING (component_id, parameter) JOIN first f ON f.component_id = h.component_id AND f.parameter = h.parameter AND f.drawing_id = s WHERE h.drawing_id <> s AND h.value <> f.value)"""


def _plan(r: Registry) -> DataFrame:
    # components that know their drawing's type don't ask for drawings, so these aren't stored for it
    return propagation.plan(r.typed, r.raw("drawing"), authority.default_rules(r.spark))


@query("y5_plan_all", "line drawing component", f"{_PLAN} SELECT * FROM act")
def y5(r: Registry) -> DataFrame:
    return _plan(r)


@query("a8_propagation_summary", "line drawing component", f"{_PLAN} SELECT status, count(*) AS total, count(DISTINCT component_id) AS components, count(DISTINCT target_drawing_id) AS drawings FROM act GROUP BY status")
def a8(r: Registry) -> DataFrame:
    return propagation.summary(_plan(r))


@query(
    "y6_apply",
    "line drawing component",
    f"""{_PLAN}, w AS (SELECT *, row_number() OVER (PARTITION BY component_id, drawing_id, parameter ORDER BY pos) AS k, row_number() OVER (PARTITION BY component_id, drawing_id ORDER BY pos) - 1 AS idx FROM line)
SELECT w.drawing_id, w.component_id, idx, w.parameter, CASE WHEN k = 1 THEN coalesce(new_value, value) ELSE value END AS value FROM w LEFT JOIN act ON act.component_id = w.component_id AND act.target_drawing_id = w.drawing_id AND act.parameter = w.parameter""",
)
def y6(r: Registry) -> DataFrame:
    after, *_ = propagation.apply_actions(r.typed.drop("drawing_type"), _plan(r))
    return after.select("drawing_id", "component_id", F.posexplode("values").alias("idx", "v")).select("drawing_id", "component_id", "idx", "v.parameter", "v.value")


@query("y6_change_log", "line drawing component", f"{_PLAN} SELECT target_drawing_id AS drawing_id, component_id, old_value, new_value, 'Propagated ' || parameter || ' from ' || source_drawing_id || ': ' || old_value || ' -> ' || new_value || ' (' || authority_basis || ')' AS description FROM act")
def y6_log(r: Registry) -> DataFrame:
    return propagation.apply_actions(r.typed.drop("drawing_type"), _plan(r))[2].drop("timestamp", "change_type")


@query("y8_impact", "line", f"{_LAST}, i AS (SELECT component_id, parameter, source_drawing_id, count(*) AS n FROM (SELECT a.component_id, a.parameter, a.drawing_id AS source_drawing_id FROM last a JOIN last b ON a.component_id = b.component_id AND a.parameter = b.parameter AND a.drawing_id <> b.drawing_id AND a.value <> b.value) GROUP BY ALL) SELECT * FROM i")
def y8(r: Registry) -> DataFrame:
    return propagation.impact_counts(r.components)


@query(
    "y8_impact_rows",
    "line drawing",
    f"{_LAST} SELECT a.component_id, a.parameter, a.drawing_id AS source_drawing_id, a.value AS source_value, b.drawing_id AS affected_drawing_id, b.value AS current_value FROM last a JOIN drawing d ON d.drawing_id = a.drawing_id AND d.k % 40 = 3 JOIN last b ON a.component_id = b.component_id AND a.parameter = b.parameter AND a.drawing_id <> b.drawing_id AND a.value <> b.value",
)
def y8_rows(r: Registry) -> DataFrame:
    """What changed drawings (here a fortieth of them) would change elsewhere."""
    changed = r.raw("drawing").filter("k % 40 = 3").select("drawing_id")
    return propagation.impact(r.components, sources=changed).select("component_id", "parameter", "source_drawing_id", "source_value", "affected_drawing_id", "current_value")


_NEXT = "nl AS (SELECT * FROM line WHERE pk % 17 <> 3)"


@query(
    "h1_detect_changes",
    "line",
    f"""{_NEXT}, o AS (SELECT drawing_id, component_id, string_agg(DISTINCT parameter || '=' || value, '; ' ORDER BY parameter || '=' || value) AS s FROM line GROUP BY ALL),
n AS (SELECT drawing_id, component_id, string_agg(DISTINCT parameter || '=' || CASE WHEN pk % 19 = 1 THEN 'x' ELSE value END, '; ' ORDER BY parameter || '=' || CASE WHEN pk % 19 = 1 THEN 'x' ELSE value END) AS s FROM nl GROUP BY ALL)
SELECT drawing_id, component_id, CASE WHEN n.s IS NULL THEN 'COMPONENT_REMOVED' ELSE 'VALUE_CHANGED' END AS change_type FROM o LEFT JOIN n USING (drawing_id, component_id) WHERE (n.s IS NULL AND drawing_id IN (SELECT drawing_id FROM nl)) OR n.s <> o.s""",
)
def h1(r: Registry) -> DataFrame:
    new = r.raw("line").filter("pk % 17 <> 3").withColumn("value", F.when(c("pk") % 19 == 1, "x").otherwise(c("value")))
    rows = new.groupBy("drawing_id", "component_id").agg(F.collect_list(F.struct("parameter", "value")).alias("values"))
    return changes.detect_changes(r.components, rows).select("drawing_id", "component_id", "change_type")


# Lookups, counts and lists


@query("p2_drawing_ids", "drawing", "SELECT drawing_id FROM drawing")
def p2(r: Registry) -> DataFrame:
    return registry.drawing_ids(r.drawings)


@query("p4_component_values", "line", "SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY pos) - 1 AS pos, parameter, value, unit FROM line WHERE component_id = '50-L7'")
def p4(r: Registry) -> DataFrame:
    return registry.component_values(r.components, "50-L7").drop("numeric_value")


@query("p5_connections_of", "connection", "SELECT drawing_id, from_component, to_component, signal_type, cable_spec FROM connection WHERE from_component = '50-L7' OR to_component = '50-L7'")
def p5(r: Registry) -> DataFrame:
    return registry.connections_of(r.connections, "50-L7", narrow=True)


@query("p6_drawings_by_type", "drawing", "SELECT drawing_id FROM drawing WHERE drawing_type = 'DC_SCHEMATIC'")
def p6(r: Registry) -> DataFrame:
    return registry.drawings_by_type(r.drawings, "DC_SCHEMATIC")


@query("p9_name_like", "connection", "SELECT drawing_id, seq, to_component FROM connection WHERE to_component ILIKE 'dc%pwr%'")
def p9(r: Registry) -> DataFrame:
    return r.connections.filter(registry.name_like(c("to_component"), "dc", "pwr")).select("drawing_id", "seq", "to_component")


@query("j0_components_with_drawings", "component drawing", "SELECT component_id, drawing_id, component_type, drawing_type, title, revision FROM component JOIN drawing USING (drawing_id)")
def j0(r: Registry) -> DataFrame:
    return registry.components_with_drawings(r.components, r.drawings).select("component_id", "drawing_id", "component_type", "drawing_type", "title", "revision")


@query("a1_all_components", "component", "SELECT component_id, string_agg(drawing_id, ',' ORDER BY drawing_id) AS drawings FROM component GROUP BY component_id")
def a1(r: Registry) -> DataFrame:
    return registry.all_components(r.components).withColumn("drawings", F.array_join("drawings", ","))


@query("a2_shared_components", "component", "SELECT component_id, count(*) AS n_drawings, string_agg(drawing_id, ',' ORDER BY drawing_id) AS drawings FROM component GROUP BY component_id HAVING count(*) >= 2")
def a2(r: Registry) -> DataFrame:
    return registry.shared_components(r.components).withColumn("drawings", F.array_join("drawings", ","))


@query(
    "a3_statistics",
    "drawing component connection label mismatch",
    "SELECT (SELECT count(*) FROM drawing) AS drawings, (SELECT count(*) FROM component) AS component_instances, (SELECT count(DISTINCT component_id) FROM component) AS unique_components, (SELECT count(*) FROM (SELECT 1 FROM component GROUP BY component_id HAVING count(*) >= 2)) AS shared_components, (SELECT count(*) FROM connection) AS connections, (SELECT count(*) FROM label) AS labels, (SELECT count(*) FROM mismatch WHERE NOT resolved) AS active_mismatches",
)
def a3(r: Registry) -> DataFrame:
    return registry.statistics(r.drawings, r.components, r.connections, r.labels, r.raw("mismatch"))


@query("a4_conflict_groups", "line", f"{_LAST} SELECT component_id, parameter, count(DISTINCT value) AS n_values, count(*) AS n_drawings FROM last GROUP BY ALL HAVING count(DISTINCT value) > 1")
def a4(r: Registry) -> DataFrame:
    return registry.conflict_groups(checks.last_values(r.components))


@query("a10_type_counts", "drawing", "SELECT drawing_type, count(*) AS n FROM drawing GROUP BY drawing_type")
def a10(r: Registry) -> DataFrame:
    return registry.type_counts(r.drawings)


_KINDS = ", ".join(f"'{x}'" for x in registry.PROTECTION)


@query("a11_completeness", "component connection", f"SELECT drawing_id, component_id, component_type, 'no connections' AS issue FROM component c WHERE component_type IN ({_KINDS}) AND NOT EXISTS (SELECT 1 FROM connection x WHERE x.drawing_id = c.drawing_id AND c.component_id IN (x.from_component, x.to_component))")
def a11(r: Registry) -> DataFrame:
    return registry.completeness(r.components, r.connections)


@query("u3_lockouts_near", "component connection", "l AS (SELECT DISTINCT component_id FROM component WHERE component_type = '86') SELECT from_component AS component_id, to_component AS lockout FROM connection WHERE to_component IN (SELECT component_id FROM l) UNION SELECT to_component, from_component FROM connection WHERE from_component IN (SELECT component_id FROM l)")
def u3(r: Registry) -> DataFrame:
    return registry.lockouts_near(r.connections, r.components)


@query("o2_newest_drawings", "drawing", "SELECT drawing_id, last_scanned FROM drawing ORDER BY last_scanned DESC, drawing_id LIMIT 50")
def o2(r: Registry) -> DataFrame:
    return registry.newest(r.drawings, 50, "last_scanned", "drawing_id").select("drawing_id", "last_scanned")


@query("o5_truncated", "reference", "SELECT drawing_id, string_agg(CASE WHEN k <= 2 THEN ref END, ', ' ORDER BY k) || CASE WHEN max(k) > 2 THEN ' +' || (max(k) - 2) || ' more' ELSE '' END AS refs FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY pos) AS k FROM reference) GROUP BY drawing_id")
def o5(r: Registry) -> DataFrame:
    return r.drawings.filter(F.size("cross_references") > 0).select("drawing_id", registry.truncated(c("cross_references"), 2).alias("refs"))


# Cables


_CABLES = """sig AS (SELECT drawing_id, component_id, string_agg(DISTINCT signal, ', ' ORDER BY signal) AS known FROM line WHERE signal <> '' GROUP BY ALL),
rows AS (SELECT c.drawing_id, seq, CASE WHEN wire_label <> '' THEN wire_label ELSE from_component || '-' || to_component END AS cable_number, from_component, to_component, cable_spec, CASE WHEN signal_type <> '' THEN signal_type ELSE coalesce(known, '') END AS signal FROM connection c LEFT JOIN sig ON sig.drawing_id = c.drawing_id AND sig.component_id = c.from_component)"""


@query("r8_cable_list", "connection line", f"{_CABLES} SELECT * FROM rows")
def r8(r: Registry) -> DataFrame:
    return cables.cable_list(r.connections, r.components)


@query("r10_cables_by_drawing", "connection line", f"{_CABLES} SELECT * FROM rows")
def r10(r: Registry) -> DataFrame:
    return cables.cables_by_drawing(cables.cable_list(r.connections, r.components))


@query("r9_schedule_rows", "schedule", "SELECT drawing_id, 0 AS pos, spec FROM schedule")
def r9(r: Registry) -> DataFrame:
    return cables.schedule_rows(r.drawings)


@query("a5_cable_schedule", "connection schedule", "u AS (SELECT CASE WHEN cable_spec = '' THEN '(unspecified)' ELSE cable_spec END AS spec, drawing_id, from_component AS f, to_component AS t, 1 AS one FROM connection UNION ALL SELECT spec, drawing_id, NULL, NULL, 0 FROM schedule) SELECT spec, CAST(sum(one) AS BIGINT) AS n, count(DISTINCT drawing_id) AS n_drawings, count(DISTINCT f) AS n_from, count(DISTINCT t) AS n_to FROM u GROUP BY spec")
def a5(r: Registry) -> DataFrame:
    return cables.cable_schedule(r.connections, r.drawings)


@query("a6_cable_summary", "connection", "SELECT count(*) AS cables, count(DISTINCT nullif(cable_spec, '')) AS specs, count(DISTINCT drawing_id) AS drawings FROM connection")
def a6(r: Registry) -> DataFrame:
    return cables.cable_summary(r.connections)


# Reports


@query("r1_component_status", "line component", f"{_LAST}, bad AS (SELECT component_id, string_agg(parameter, ',' ORDER BY parameter) AS b FROM (SELECT component_id, parameter FROM last GROUP BY ALL HAVING count(DISTINCT value) > 1) GROUP BY component_id) SELECT component_id, count(*) AS total_drawings, coalesce(any_value(b), '') AS inconsistencies, any_value(b) IS NULL AS is_consistent FROM component LEFT JOIN bad USING (component_id) GROUP BY component_id")
def r1(r: Registry) -> DataFrame:
    return reports.component_status(r.components, checks.last_values(r.components)).withColumn("inconsistencies", F.array_join("inconsistencies", ","))


@query("r1_component_values", "line", f"{_LAST} SELECT component_id, drawing_id, string_agg(parameter || '=' || value, ', ' ORDER BY parameter) AS vals FROM last GROUP BY ALL")
def r1_values(r: Registry) -> DataFrame:
    """A component's values by drawing and parameter."""
    return reports.component_values(checks.last_values(r.components)).select("component_id", "drawing_id", _text_map(c("values")).alias("vals"))


_SHARED = "sh AS (SELECT component_id, count(*) - 1 AS n_others FROM component GROUP BY component_id HAVING count(*) > 1)"


@query(
    "r2_dependency_graph",
    "drawing reference component",
    f"""{_SHARED}, e AS (SELECT drawing_id, CASE WHEN starts_with(ref, 'NRE-') THEN ref ELSE 'NRE-' || ref END AS t FROM reference)
SELECT drawing_id, (SELECT count(*) FROM e WHERE e.drawing_id = d.drawing_id) AS n_references, (SELECT count(*) FROM e WHERE e.t = d.drawing_id) AS n_referenced_by, (SELECT count(*) FROM component c JOIN sh USING (component_id) WHERE c.drawing_id = d.drawing_id) AS n_shared FROM drawing d""",
)
def r2(r: Registry) -> DataFrame:
    return reports.dependency_graph(r.drawings, r.components)


@query("r2_shared_edges", "component", f"{_SHARED} SELECT drawing_id, component_id, n_others FROM component JOIN sh USING (component_id)")
def r2_edges(r: Registry) -> DataFrame:
    return reports.shared_edges(r.components)


@query("r5_scan_report", "drawing line component connection label", "SELECT drawing_id, drawing_type, (SELECT count(*) FROM component x WHERE x.drawing_id = d.drawing_id) AS n_components, (SELECT count(*) FROM line x WHERE x.drawing_id = d.drawing_id) AS n_values, (SELECT count(*) FROM connection x WHERE x.drawing_id = d.drawing_id) AS n_connections, (SELECT count(*) FROM label x WHERE x.drawing_id = d.drawing_id) AS n_labels FROM drawing d")
def r5(r: Registry) -> DataFrame:
    return reports.scan_report(r.drawings, r.components, r.connections, r.labels)


@query("r11_classification_listing", "drawing", "SELECT drawing_id, CASE WHEN drawing_type = '' THEN 'UNKNOWN' ELSE drawing_type END AS drawing_type, substr(title, 1, 48) AS title FROM drawing")
def r11(r: Registry) -> DataFrame:
    return reports.classification_listing(r.drawings)


@query("r3_sync_report")
def r3(r: Registry) -> DataFrame:
    found = _every(r)
    return reports.sync_report(r.components, found.withColumn("resolved", F.lit(False)))


# Audit


def _log(r: Registry) -> DataFrame:
    return r.raw("decision").withColumnRenamed("stamp", "timestamp")


_DEC = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY stamp DESC) AS k FROM decision) WHERE k = 1)"


@query("k6_latest_decision", "decision", f"{_DEC} SELECT decision_id, decision_type, component_id, drawing_id, confidence, stamp, outcome FROM latest")
def k6(r: Registry) -> DataFrame:
    return changes.latest(r.raw("decision"), "decision_id", "stamp")


@query("d1_decisions", "decision", "SELECT decision_id, stamp AS timestamp, component_id FROM decision WHERE decision_type = 'PROPAGATION' ORDER BY stamp DESC, decision_id LIMIT 100")
def d1(r: Registry) -> DataFrame:
    return audit.decisions(_log(r), decision_type="PROPAGATION").select("decision_id", "timestamp", "component_id")


@query(
    "d3_audit_report",
    "decision component",
    """f AS (SELECT component_id, 'propagation_actions' AS section, confidence FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY stamp DESC, decision_id) AS k FROM decision) WHERE k <= 500 AND decision_type = 'PROPAGATION'),
g AS (SELECT drawing_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY stamp DESC, decision_id) AS k FROM decision WHERE decision_type = 'CLASSIFICATION') WHERE k <= 50),
t AS (SELECT * FROM f UNION ALL SELECT component_id, 'classifications', confidence FROM component JOIN g USING (drawing_id))
SELECT component_id, section, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM t GROUP BY ALL""",
)
def d3(r: Registry) -> DataFrame:
    return audit.audit_report(_log(r), r.components)


@query("a9_audit_statistics", "decision", "SELECT decision_type, count(*) AS total, round(avg(confidence), 3) AS mean_confidence, min(stamp) AS first, max(stamp) AS last FROM decision GROUP BY ROLLUP (decision_type)")
def a9(r: Registry) -> DataFrame:
    return audit.statistics(_log(r))


# Text


def _has(x: str, rx: str) -> str:
    return f"regexp_matches({x}, '{rx.replace(chr(39), chr(39) * 2)}')"


_LABEL_SQL = f"""CASE WHEN {_has('upper(trim(text))', X.COMPONENT)} THEN 'component' WHEN {_has('upper(trim(text))', P.VOLTAGE)} OR {_has('upper(trim(text))', P.CURRENT)} THEN 'value' WHEN {_has('text', P.CABLE)} OR {_has('upper(trim(text))', P.PAIRS)} THEN 'cable' WHEN {_has('text', P.DRAWING_REF)} THEN 'reference' WHEN {_has('text', P.TERMINAL)} THEN 'terminal'
WHEN starts_with(upper(trim(text)), 'NOTE') OR starts_with(upper(trim(text)), 'REV') THEN 'note' WHEN {_has('upper(trim(text))', '|'.join(P.TITLE_WORDS))} THEN 'title' WHEN {_has('upper(trim(text))', '|'.join(rf'\b{w}\b' for w in P.SIGNAL_WORDS))} THEN 'signal' ELSE 'text' END"""


@query("x2_label_category", "label", f"SELECT drawing_id, seq, text, {_LABEL_SQL} AS category FROM label")
def x2(r: Registry) -> DataFrame:
    return r.labels.select("drawing_id", "seq", "text", X.label_category(c("text")).alias("category"))


@query("s4_word_labels", "label", f"SELECT drawing_id, 1 AS page, seq, trim(text) AS text, x, y, {_LABEL_SQL} AS category FROM label WHERE trim(text) <> ''")
def s4(r: Registry) -> DataFrame:
    return decoded.word_labels(r.labels.withColumn("page", F.lit(1)))


@query("x2b_entity_category", "label", f"SELECT drawing_id, seq, CASE WHEN {_has('upper(trim(text))', X.COMPONENT)} THEN 'component' WHEN {_has('upper(trim(text))', P.VOLTAGE)} OR {_has('upper(trim(text))', P.CURRENT)} THEN 'value' WHEN {_has('text', P.CABLE)} THEN 'cable' WHEN {_has('text', P.DRAWING_REF)} THEN 'reference' WHEN {_has('text', P.TERMINAL)} THEN 'terminal' ELSE 'text' END AS category FROM label")
def x2b(r: Registry) -> DataFrame:
    return r.labels.select("drawing_id", "seq", X.entity_category(c("text")).alias("category"))


@query("x3_cell_category", "label", f"SELECT drawing_id, seq, CASE WHEN {_has('text', P.CELL_COMPONENT)} THEN 'component' WHEN {_has('text', P.CELL_VALUE)} THEN 'value' WHEN {_has('text', P.CELL_CABLE)} THEN 'cable' WHEN seq % 3 = 0 THEN 'reference' WHEN seq % 3 = 1 THEN 'quantity' ELSE 'text' END AS category FROM label")
def x3(r: Registry) -> DataFrame:
    header = F.when(c("seq") % 3 == 0, "Dwg Number").when(c("seq") % 3 == 1, "Qty")
    return r.labels.select("drawing_id", "seq", X.cell_category(c("text"), header).alias("category"))


def _rx(p: P.Pattern) -> str:
    return p.regex.replace(r"\b(?!-)", r"(?:[^\w-]|$)").replace("'", "''")


_HITS = "[" + ", ".join(f"{{'prio': {k}, 'kind': '{p.kind}', 'ids': list_transform(regexp_extract_all(text, '{_rx(p)}', 1), lambda h: '{p.name.split('{}')[0]}' || trim(h))}}" for k, p in enumerate(P.CATALOGUE, 1) if "p" in p.sources) + "]"
_X1 = f"""h AS (SELECT drawing_id, page, unnest({_HITS}) AS h FROM unit_text),
i AS (SELECT drawing_id, page, h.prio AS prio, h.kind AS kind, unnest(h.ids) AS component_id, unnest(range(len(h.ids))) AS place FROM h),
x1 AS (SELECT drawing_id, component_id, kind AS component_type FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, component_id ORDER BY page, prio, place) AS k FROM i) WHERE k = 1)"""


@query("x1_pattern_extract", "unit_text", f"{_X1} SELECT * FROM x1")
def x1(r: Registry) -> DataFrame:
    return X.extract_components(r.raw("unit_text")).drop("first_seen")


@query("x12_noise_filter", "unit_text", f"{_X1} SELECT * FROM x1 WHERE length(trim(component_id)) >= 2 AND NOT regexp_matches(component_id, '^[0-9]+$')")
def x12(r: Registry) -> DataFrame:
    return X.drop_noise(X.extract_components(r.raw("unit_text"))).drop("first_seen")


_DESCRIBED = "CASE component_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.DESCRIPTIONS.items()) + " ELSE component_type END || ' ' || component_id"


@query("x13_describe", "component", f"SELECT DISTINCT component_id, component_type, {_DESCRIBED} AS description FROM component")
def x13(r: Registry) -> DataFrame:
    return r.components.select("component_id", "component_type").distinct().withColumn("description", X.describe(c("component_type"), c("component_id")))


def _all(rx: str, g: int) -> str:
    return f"regexp_extract_all(text, '{rx}', {g})"


@query(
    "x4_electrical_values",
    "unit_text",
    f"""v AS (SELECT drawing_id, page, 'voltage_rating' AS parameter, unnest(list_transform(list_zip({_all(P.VOLTAGE, 1)}, {_all(P.VOLTAGE, 2)}, {_all(P.VOLTAGE, 3)}), lambda z: rtrim(z[1] || z[2] || ' ' || coalesce(z[3], '')))) AS value FROM unit_text
UNION ALL SELECT drawing_id, page, 'current_rating', unnest(list_transform(list_zip({_all(P.CURRENT, 1)}, {_all(P.CURRENT, 2)}), lambda z: z[1] || z[2])) FROM unit_text
UNION ALL SELECT drawing_id, page, 'impedance', unnest({_all(P.IMPEDANCE, 0)}) FROM unit_text
UNION ALL SELECT drawing_id, page, 'power_rating', unnest(list_transform(list_zip({_all(P.POWER, 1)}, {_all(P.POWER, 2)}), lambda z: z[1] || z[2])) FROM unit_text
UNION ALL SELECT drawing_id, page, 'ratio', unnest({_all(P.RATIO, 1)}) FROM unit_text) SELECT * FROM v""",
)
def x4(r: Registry) -> DataFrame:
    return r.raw("unit_text").select("drawing_id", "page", F.explode(X.electrical_values(c("text"))).alias("v")).select("drawing_id", "page", "v.parameter", "v.value")


@query("x5_cable_specs", "unit_text", f"SELECT drawing_id, page, array_to_string(list_distinct({_all(P.CABLE, 1)}), ';') AS cables FROM unit_text")
def x5(r: Registry) -> DataFrame:
    return r.raw("unit_text").select("drawing_id", "page", F.array_join(X.cable_specs(c("text")), ";").alias("cables"))


@query("x6_terminal_blocks", "unit_text", f"SELECT drawing_id, page, 'TB' || {_all(P.BLOCK_TERMINAL, 1)}[1] || '=' || {_all(P.BLOCK_TERMINAL, 2)}[1] AS blocks FROM unit_text")
def x6(r: Registry) -> DataFrame:
    blocks = F.array_join(F.transform(F.map_entries(X.terminal_blocks(c("text"))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return r.raw("unit_text").select("drawing_id", "page", blocks.alias("blocks"))


def _each(rx: str, g: int = 1) -> str:
    return f"regexp_extract_all(text, '{rx}', {g})"


_KINDS = f"list_concat({_each(P.CABLE)}, list_transform({_each(P.NAMED_CABLE)}, lambda x: upper(x)), {_each(P.CABLE_LABEL)}, {_each(P.PAIRS)})"


@query("x5_cable_kinds", "spec_text", f"k AS (SELECT drawing_id, page, {_KINDS} AS l FROM spec_text) SELECT drawing_id, page, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS cables FROM k")
def x5_kinds(r: Registry) -> DataFrame:
    """X5 with all four kinds, repeated and in lower case, in one text."""
    return r.raw("spec_text").select("drawing_id", "page", F.array_join(X.cable_specs(c("text")), ";").alias("cables"))


_PAIRS_SQL = f"""p AS (SELECT drawing_id, page, unnest(list_concat(list_transform({_each(P.BLOCK_TERMINAL)}, lambda b, i: {{'b': 'TB' || b, 't': {_each(P.BLOCK_TERMINAL, 2)}[i], 'k': i}}), list_transform({_each(P.STRIP_TERMINAL)}, lambda b, i: {{'b': 'TS-TS' || b, 't': {_each(P.STRIP_TERMINAL, 2)}[i], 'k': 1000 + i}}))) AS p FROM spec_text),
f AS (SELECT drawing_id, page, p.b AS b, p.t AS t, min(p.k) AS k FROM p GROUP BY ALL), g AS (SELECT drawing_id, page, b, min(k) AS k, string_agg(t, ',' ORDER BY k) AS ts FROM f GROUP BY ALL)
SELECT s.drawing_id, s.page, coalesce(string_agg(b || '=' || ts, ';' ORDER BY k), '') AS blocks FROM spec_text s LEFT JOIN g USING (drawing_id, page) GROUP BY ALL"""


@query("x6_terminal_lists", "spec_text", _PAIRS_SQL)
def x6_lists(r: Registry) -> DataFrame:
    """X6 with several blocks and strips, and repeated terminals, in one text."""
    blocks = F.array_join(F.transform(F.map_entries(X.terminal_blocks(c("text"))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return r.raw("spec_text").select("drawing_id", "page", blocks.alias("blocks"))


@query("x7_cross_references", "unit_text", f"SELECT drawing_id, page, array_to_string(list_sort(list_filter(list_distinct({_all(P.DRAWING_REF, 1)}), lambda x: x <> replace(drawing_id, 'NRE-', ''))), ',') AS refs FROM unit_text")
def x7(r: Registry) -> DataFrame:
    return r.raw("unit_text").select("drawing_id", "page", F.array_join(X.cross_references(c("text"), c("drawing_id")), ",").alias("refs"))


@query("x10_voltage_levels", "unit_text", r"SELECT drawing_id, page, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '([0-9]+\.?[0-9]*)\s*(?:kV|KV)', 1), lambda x: x || 'kV'), list_transform(list_zip(regexp_extract_all(text, '([0-9]+)\s*V\s*(AC|DC)', 1), regexp_extract_all(text, '([0-9]+)\s*V\s*(AC|DC)', 2)), lambda z: z[1] || 'V ' || z[2])))), ',') AS levels FROM unit_text")
def x10(r: Registry) -> DataFrame:
    return r.raw("unit_text").select("drawing_id", "page", F.array_join(X.voltage_levels(c("text")), ",").alias("levels"))


@query("x14_id_from_name")
def x14(r: Registry) -> DataFrame:
    return r.raw("unit_text").select("drawing_id", "page", X.id_from_name(c("text")).alias("component_id"))


@query("x15_type_from_id", "component", "SELECT DISTINCT component_id, CASE WHEN starts_with(component_id, '86') THEN 'UNKNOWN' ELSE split_part(component_id, '-', 1) END AS component_type FROM component")
def x15(r: Registry) -> DataFrame:
    return r.components.select("component_id").distinct().withColumn("component_type", X.type_from_id(c("component_id")))


# Places


def _at(word: str) -> str:
    return f"{word} AS (SELECT * FROM label WHERE seq % 6 " + {"comp": "IN (1, 3)", "tb": "= 0", "sig": "= 2", "cab": "= 4", "ref": "= 5"}[word] + ")"


def _labels(r: Registry) -> dict[str, DataFrame]:
    rows = r.labels.select("drawing_id", "seq", "text", "x", "y")
    of = lambda *k: rows.filter((c("seq") % 6).isin(*k))
    return {"comp": of(1, 3), "tb": of(0), "sig": of(2), "cab": of(4), "ref": of(5)}


@query("j1_nearest_component", "label component", f"{_at('comp')}, {_at('cab')}, n AS (SELECT v.drawing_id, v.seq, v.text AS value, l.text AS component_id, row_number() OVER (PARTITION BY v.drawing_id, v.seq ORDER BY sqrt((v.x - l.x) * (v.x - l.x) + (v.y - l.y) * (v.y - l.y)), l.seq) AS k FROM cab v JOIN comp l USING (drawing_id)) SELECT drawing_id, component_id, value, min(seq) AS seq FROM n JOIN component USING (drawing_id, component_id) WHERE k = 1 GROUP BY ALL")
def j1(r: Registry) -> DataFrame:
    at = _labels(r)
    return spatial.nearest_component(at["cab"].withColumnRenamed("text", "value"), at["comp"], r.components)


@query("j2_terminal_band", "label", f"{_at('comp')}, {_at('tb')} SELECT a.drawing_id, a.seq AS component_seq, a.text AS component_id, b.text AS terminal, b.seq AS terminal_seq FROM comp a JOIN tb b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) < 50")
def j2(r: Registry) -> DataFrame:
    at = _labels(r)
    return spatial.terminal_connections(at["comp"], at["tb"])


@query("j3_signals", "label", f"{_at('comp')}, {_at('sig')} SELECT drawing_id, t AS component_id, string_agg(DISTINCT s, ',' ORDER BY s) AS signals FROM (SELECT a.drawing_id, a.text AS t, b.text AS s FROM comp a JOIN sig b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) < 30 AND abs(a.x - b.x) < 200) GROUP BY ALL")
def j3(r: Registry) -> DataFrame:
    at = _labels(r)
    return spatial.signals(at["comp"], at["sig"]).withColumn("signals", F.array_join("signals", ","))


@query(
    "j4_cable_fill",
    "label connection",
    f"""{_at('comp')}, {_at('cab')}, n AS (SELECT a.drawing_id, a.text AS component_id, b.text AS spec, row_number() OVER (PARTITION BY a.drawing_id, a.text ORDER BY a.seq, b.seq) AS k FROM comp a JOIN cab b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) < 50),
o AS (SELECT drawing_id, from_component AS component_id, seq, cable_spec, sum(CASE WHEN cable_spec = '' THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id, from_component ORDER BY seq) AS k FROM connection)
SELECT o.drawing_id, o.component_id, o.seq, CASE WHEN cable_spec = '' THEN coalesce(spec, '') ELSE cable_spec END AS cable_spec FROM o LEFT JOIN n ON n.drawing_id = o.drawing_id AND n.component_id = o.component_id AND n.k = o.k""",
)
def j4(r: Registry) -> DataFrame:
    at = _labels(r)
    return spatial.cable_fill(r.connections.select("drawing_id", c("from_component").alias("component_id"), "seq", "cable_spec"), at["comp"], at["cab"])


@query("j5_drawing_refs", "label", f"{_at('comp')}, {_at('ref')} SELECT drawing_id, t AS component_id, string_agg(DISTINCT s, ',' ORDER BY s) AS drawing_refs FROM (SELECT a.drawing_id, a.text AS t, b.text AS s FROM comp a JOIN ref b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) < 40 AND abs(a.x - b.x) < 200) GROUP BY ALL")
def j5(r: Registry) -> DataFrame:
    at = _labels(r)
    return spatial.drawing_refs(at["comp"], at["ref"]).withColumn("drawing_refs", F.array_join("drawing_refs", ","))


@query("j6_label_pairs", "label", f"{_at('comp')} SELECT a.drawing_id, a.seq AS a, b.seq AS b, a.text AS from_component, b.text AS to_component FROM comp a JOIN comp b ON a.drawing_id = b.drawing_id AND a.seq < b.seq AND abs(a.y - b.y) < 15 AND abs(a.x - b.x) < 300")
def j6(r: Registry) -> DataFrame:
    return spatial.label_connections(_labels(r)["comp"])


_SEGMENTS = "seg AS (SELECT drawing_id, seq, 0 AS part, x + qty % 7 AS x1, y + 1 AS y1, x2, y2 FROM (SELECT a.drawing_id, a.seq, a.x, a.y, b.x - 2 AS x2, b.y + 2 AS y2, a.seq + a.ok AS qty FROM label a JOIN label b ON a.drawing_id = b.drawing_id AND b.seq = a.seq + 2))"


@query(
    "j7_wire_connections",
    "label",
    f"""{_SEGMENTS}, {_at('comp')}, pl AS (SELECT drawing_id, text, arg_max(x, seq) AS x, arg_max(y, seq) AS y, max(seq) AS seq FROM comp GROUP BY ALL),
e AS (SELECT drawing_id, seq, part, 1 AS w, x1 AS x, y1 AS y FROM seg UNION ALL SELECT drawing_id, seq, part, 2, x2, y2 FROM seg),
n AS (SELECT e.*, pl.text, row_number() OVER (PARTITION BY e.drawing_id, e.seq, part, w ORDER BY sqrt((e.x - pl.x) * (e.x - pl.x) + (e.y - pl.y) * (e.y - pl.y)), pl.seq) AS k FROM e JOIN pl ON pl.drawing_id = e.drawing_id AND sqrt((e.x - pl.x) * (e.x - pl.x) + (e.y - pl.y) * (e.y - pl.y)) < 5)
SELECT drawing_id, seq, part, from_component, to_component FROM (SELECT drawing_id, seq, part, max(CASE WHEN w = 1 THEN text END) AS from_component, max(CASE WHEN w = 2 THEN text END) AS to_component FROM n WHERE k = 1 GROUP BY ALL) WHERE from_component <> to_component""",
)
def j7(r: Registry) -> DataFrame:
    a, b = r.labels.alias("a"), r.labels.alias("b")
    seg = a.join(b, (c("a.drawing_id") == c("b.drawing_id")) & (c("b.seq") == c("a.seq") + 2)).select(c("a.drawing_id").alias("drawing_id"), c("a.seq").alias("seq"), F.lit(0).alias("part"), (c("a.x") + (c("a.seq") + c("a.ok")) % 7).alias("x1"), (c("a.y") + 1).alias("y1"), (c("b.x") - 2).alias("x2"), (c("b.y") + 2).alias("y2"))
    return spatial.wire_connections(seg, _labels(r)["comp"])


@query("s8_wire_segments", "label", "w AS (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2, row_number() OVER q - 1 AS part FROM label WINDOW q AS (PARTITION BY drawing_id ORDER BY seq)) SELECT drawing_id, part, x AS x1, y AS y1, x2, y2 FROM w WHERE x2 IS NOT NULL")
def s8(r: Registry) -> DataFrame:
    lines = r.labels.groupBy("drawing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")).withColumns({"etype": F.lit("LWPOLYLINE"), "seq": F.lit(0)})
    return spatial.wire_segments(lines).drop("seq")


# Classification


def _titled(r: Registry) -> tuple[DataFrame, DataFrame]:
    drawings = r.drawings.withColumn("title_type", F.when(c("k") % 4 == 0, "DC Elementary Diagram").when(c("k") % 4 == 1, "one-line").otherwise(""))
    index = r.raw("drawing").filter("k % 6 = 0").select(F.replace("drawing_id", F.lit("NRE-"), F.lit("")).alias("drawing_number"), F.when(c("k") % 12 == 0, "Panel Layout").otherwise("sketch").alias("drawing_type"), F.lit("indexed").alias("drawing_title"), F.lit("B").alias("current_revision"))
    return drawings, index


_SERIES = "CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in P.NUMBER_SERIES) + " ELSE 'UNKNOWN' END"
_CLASSIFIED = f"""n AS (SELECT *, CAST(regexp_extract(drawing_id, '([0-9]{{1,3}})', 1) AS INTEGER) AS n FROM drawing),
t AS (SELECT *, CASE WHEN k % 12 = 0 THEN 'PANEL_LAYOUT' ELSE 'UNKNOWN' END AS t1, CASE WHEN k % 4 = 0 THEN 'DC_SCHEMATIC' WHEN k % 4 = 1 THEN 'ONE_LINE' ELSE 'UNKNOWN' END AS t2, {_SERIES} AS t3 FROM n),
cl AS (SELECT *, coalesce(nullif(t1, 'UNKNOWN'), nullif(t2, 'UNKNOWN'), nullif(t3, 'UNKNOWN'), 'UNKNOWN') AS ty, CASE WHEN t1 <> 'UNKNOWN' THEN 1.0 WHEN t2 <> 'UNKNOWN' THEN 0.9 WHEN t3 <> 'UNKNOWN' THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM t)"""


@query("c5_classify", "drawing", f"{_CLASSIFIED} SELECT drawing_id, ty AS drawing_type, confidence, (CASE WHEN t1 NOT IN ('UNKNOWN', ty) THEN 1 ELSE 0 END + CASE WHEN t2 NOT IN ('UNKNOWN', ty) THEN 1 ELSE 0 END + CASE WHEN t3 NOT IN ('UNKNOWN', ty) THEN 1 ELSE 0 END)::INTEGER AS n_alternatives FROM cl")
def c5(r: Registry) -> DataFrame:
    return classify.classify(*_titled(r)).select("drawing_id", "drawing_type", "confidence", F.size("alternatives").alias("n_alternatives"))


@query("c3_by_number", "drawing", f"n AS (SELECT drawing_id, CAST(regexp_extract(drawing_id, '([0-9]{{1,3}})', 1) AS INTEGER) AS n FROM drawing) SELECT drawing_id, {_SERIES} AS drawing_type FROM n")
def c3(r: Registry) -> DataFrame:
    return r.drawings.select("drawing_id", classify.by_number(c("drawing_id")).alias("drawing_type"))


@query("c6_enrich", "drawing", "SELECT drawing_id, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 6 = 0 THEN 'indexed' ELSE '' END ELSE title END AS title, revision FROM drawing")
def c6(r: Registry) -> DataFrame:
    drawings, index = _titled(r)
    drawings = drawings.withColumn("title", F.when(c("k") % 5 == 0, "").otherwise(c("title")))
    return classify.enrich(classify.classify(drawings, index)).select("drawing_id", "title", "revision")


@query("c8_records", "drawing", f"{_CLASSIFIED} SELECT {_ID.format("drawing_id || '|CLASSIFICATION'")} AS decision_id, drawing_id, confidence, ty AS outcome FROM cl")
def c8(r: Registry) -> DataFrame:
    return classify.records(classify.classify(*_titled(r))).select("decision_id", "drawing_id", "confidence", "outcome")


# CAD blocks


def _entities(r: Registry) -> DataFrame:
    tag = F.when(c("tag") != "NONE", F.create_map(c("tag"), c("tag_value"), F.lit("LOC"), c("loc"), F.lit("LEFT_TERM"), c("loc"))).otherwise(F.create_map(F.lit("NOTE"), c("loc")))
    return r.raw("entity").withColumn("attribs", tag)


_CONTEXT = "w AS (SELECT *, last_value(CASE WHEN tag = 'DEVICE' THEN tag_value END IGNORE NULLS) OVER (PARTITION BY drawing_id, layout ORDER BY seq) AS device FROM entity)"


@query("w4_device_context", "entity", f"{_CONTEXT} SELECT drawing_id, layout, seq, device FROM w")
def w4(r: Registry) -> DataFrame:
    return cad.with_context(_entities(r)).select("drawing_id", "layout", "seq", "device")


@query(
    "b_block_components",
    "entity",
    f"""{_CONTEXT}, b AS (SELECT *, CASE tag WHEN 'PWR_SUP' THEN concat_ws('-', 'PWR-SUPPLY', device) WHEN 'NONE' THEN CASE block_name WHEN 'GROUND BAR' THEN concat_ws('-', 'GND', device) WHEN 'ETHERNET PORT' THEN concat_ws('-', 'ETHERNET-PORT', device) END ELSE tag_value END AS component_id FROM w),
kind AS (SELECT DISTINCT component_id, CASE WHEN starts_with(component_id, '86') THEN 'UNKNOWN' ELSE split_part(component_id, '-', 1) END AS t FROM b),
k AS (SELECT b.*, CASE tag WHEN 'DEVICE' THEN CASE WHEN t = 'UNKNOWN' THEN 'RELAY' ELSE t END WHEN 'FUSE_NUM' THEN 'FU' WHEN 'OUTPUT-#' THEN 'RELAY' WHEN 'INPUT-#1' THEN 'RELAY' WHEN 'PWR_SUP' THEN 'BAT' WHEN 'TAG' THEN t ELSE CASE block_name WHEN 'GROUND BAR' THEN 'GND' ELSE 'UNKNOWN' END END AS kind FROM b JOIN kind USING (component_id) WHERE b.component_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, component_id ORDER BY layout, seq) AS n FROM k)
SELECT drawing_id, component_id, max(CASE WHEN n = 1 THEN kind END) AS component_type, (count(CASE WHEN tag = 'DEVICE' THEN 1 END) + count(DISTINCT CASE WHEN tag = 'FUSE_NUM' THEN loc END)) AS n_values FROM r GROUP BY ALL""",
)
def b_blocks(r: Registry) -> DataFrame:
    return cad.block_components(_entities(r)).select("drawing_id", "component_id", "component_type", F.size("values").cast("long").alias("n_values"))


@query("b11_block_notes", "entity", "SELECT drawing_id, seq, 'Unrecognized electrical block: PLAIN (attributes: NOTE=' || loc || ')' AS note FROM entity WHERE tag = 'NONE' AND block_name = 'PLAIN'")
def b11(r: Registry) -> DataFrame:
    return cad.block_notes(_entities(r)).select("drawing_id", "seq", "note")


@query("b12_attribute_labels", "entity", "SELECT drawing_id, seq, unnest(CASE WHEN tag = 'NONE' THEN [loc] ELSE [tag_value, loc, loc] END) AS text FROM entity WHERE block_name <> 'TITLEBLOCK'")
def b12(r: Registry) -> DataFrame:
    return cad.attribute_labels(_entities(r)).select("drawing_id", "seq", "text")


# Sheets


def _cells(r: Registry) -> DataFrame:
    return r.raw("cell").select(F.lit("list BOM.xlsx").alias("file_name"), "drawing_id", F.lit("mat").alias("sheet"), F.lit(0).alias("sheet_pos"), c("rw").alias("row"), c("cl").alias("col"), "value")


@query("e1_header_rows", "drawing", "SELECT drawing_id, 1 AS header_row, 'material' AS kind FROM drawing")
def e1(r: Registry) -> DataFrame:
    heads = bom.header_rows(bom.bom_cells(_cells(r)))
    return heads.select("drawing_id", "header_row", bom.sheet_kind(c("header"), c("sheet")).alias("kind"))


def _book(r: Registry) -> DataFrame:
    return r.raw("book").select(F.lit("list BOM.xlsx").alias("file_name"), "drawing_id", "sheet", "sheet_pos", c("rw").alias("row"), c("cl").alias("col"), "value")


@query(
    "e1_book_headers",
    "drawing line",
    """SELECT drawing_id, 'Material' AS sheet, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS header_row, 'material' AS kind FROM drawing UNION ALL SELECT drawing_id, 'Devices', 1, 'device_list' FROM drawing UNION ALL SELECT drawing_id, 'Remarks', 3, '' FROM drawing WHERE k % 5 = 0""",
)
def e1_book(r: Registry) -> DataFrame:
    """E1, E2 where the header's row and the sheet's kind differ."""
    heads = bom.header_rows(bom.bom_cells(_book(r)))
    return heads.select("drawing_id", "sheet", c("header_row").cast("int").alias("header_row"), bom.sheet_kind(c("header"), c("sheet")).alias("kind"))


@query(
    "e4_book_items",
    "line",
    """b AS (SELECT drawing_id, pos, pos % 2 = 0 AS dev, qty, CASE WHEN pos % 2 = 1 THEN CASE WHEN pk % 7 <> 0 THEN 'C-' || (pk % 3) ELSE '' END ELSE CASE sk % 3 WHEN 0 THEN component_id WHEN 1 THEN 'C-' || (pk % 3) ELSE '' END END AS own FROM line),
n AS (SELECT *, CASE WHEN own = '' THEN 'BOM-ITEM-' || pos ELSE own END AS base, row_number() OVER (PARTITION BY drawing_id, CASE WHEN own = '' THEN 'BOM-ITEM-' || pos ELSE own END ORDER BY dev, pos) AS n FROM b)
SELECT drawing_id, CASE WHEN dev THEN 'Devices' ELSE 'Material' END AS sheet, pos + 2 AS row, CASE WHEN n = 1 OR own = '' THEN base ELSE base || CASE WHEN dev AND n = 2 THEN '-' ELSE ':' END || pos END AS component_id,
  CASE WHEN qty % 9 = 0 THEN 'CONSUMABLE' ELSE CASE qty % 5 WHEN 0 THEN 'FU' WHEN 3 THEN 'PS' ELSE 'BOM' END END AS component_type,
  CASE qty % 5 WHEN 0 THEN 'voltage_rating=600V;current_rating=30A' WHEN 1 THEN 'voltage_rating=12.5kV;impedance=5%Z' WHEN 3 THEN 'voltage_rating=48V DC;current_rating=5A' ELSE '' END AS vals FROM n""",
)
def e4_book(r: Registry) -> DataFrame:
    """E4, E6, E9 and W5 over two sheets: an id of the first counts on the second."""
    vals = F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["parameter"], v["value"])), ";")
    return bom.line_items(_book(r)).select("drawing_id", "sheet", "row", "component_id", "component_type", vals.alias("vals"))


@query(
    "e4_line_items",
    "line",
    """b AS (SELECT drawing_id, pos, pos + 1 AS rw, CASE WHEN pk % 7 <> 0 THEN 'C-' || (pk % 5) ELSE 'BOM-ITEM-' || pos END AS base, qty, pk % 7 <> 0 AS cat FROM line),
n AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, base ORDER BY rw) AS n FROM b)
SELECT drawing_id, rw AS row, CASE WHEN n = 1 OR NOT cat THEN base ELSE base || ':' || pos END AS component_id, CASE WHEN qty % 9 = 0 THEN 'CONSUMABLE' ELSE CASE qty % 6 WHEN 0 THEN 'FU' WHEN 1 THEN 'JB' WHEN 2 THEN 'CONSUMABLE' WHEN 3 THEN 'TB' WHEN 4 THEN 'PS' ELSE 'BOM' END END AS component_type,
  CASE qty % 6 WHEN 0 THEN 'current_rating=30A' WHEN 1 THEN 'voltage_rating=125V DC' WHEN 4 THEN 'impedance=5%Z' ELSE '' END AS vals FROM n""",
)
def e4(r: Registry) -> DataFrame:
    vals = F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["parameter"], v["value"])), ";")
    return bom.line_items(_cells(r)).select("drawing_id", "row", "component_id", "component_type", vals.alias("vals"))


@query("e5_material_type", "line", "SELECT drawing_id, pos, CASE WHEN qty % 9 = 0 THEN 'CONSUMABLE' WHEN component_type = 'CT' THEN 'FU' ELSE 'BOM' END AS kind FROM line")
def e5(r: Registry) -> DataFrame:
    lot = F.when(c("qty") % 9 == 0, "1 lot").otherwise("2")
    catalog = F.when(c("component_type") == "CT", "baf-3").otherwise("")
    return r.raw("line").select("drawing_id", "pos", bom.material_type(c("component_id"), lot, catalog).alias("kind"))


@query("s9_cell_labels", "cell", f"SELECT drawing_id, rw AS row, cl AS col, value AS text, CASE WHEN {_has('value', P.CELL_COMPONENT)} THEN 'component' WHEN {_has('value', P.CELL_VALUE)} THEN 'value' WHEN cl = 1 THEN 'quantity' WHEN cl = 2 THEN 'reference' WHEN cl = 3 THEN 'description' ELSE 'text' END AS category FROM cell")
def s9(r: Registry) -> DataFrame:
    cells = _cells(r)
    return decoded.cell_labels(cells, bom.header_rows(bom.bom_cells(cells))).select("drawing_id", "row", "col", "text", "category")


@query(
    "s10_index_entries",
    "drawing",
    """e AS (SELECT replace(drawing_id, 'NRE-', '') AS id, CASE WHEN k % 3 = 0 THEN 'Layout' ELSE 'Cable' END AS drawing_type, CASE WHEN k % 3 = 0 THEN '90%' ELSE '30%' END AS design_phase, CASE WHEN k % 6 = 0 THEN 'r2' WHEN k % 3 = 0 THEN '' ELSE 'r1' END AS current_revision, CASE WHEN k % 6 = 0 THEN 'd9' ELSE '' END AS current_revision_date FROM drawing)
SELECT id AS drawing_number, drawing_type, design_phase, current_revision, current_revision_date FROM e UNION ALL SELECT 'NRE-' || id, drawing_type, design_phase, current_revision, current_revision_date FROM e""",
)
def s10(r: Registry) -> DataFrame:
    cells = r.raw("index_cell").select(F.lit("index.xlsx").alias("file_name"), "sheet", "sheet_pos", c("rw").alias("row"), c("cl").alias("col"), "value")
    return classify.index_entries(cells).select("drawing_number", "drawing_type", "design_phase", "current_revision", "current_revision_date")


@query("p3_cross_refs_of", "reference", "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, ref FROM reference WHERE drawing_id = 'NRE-EC-205.0'")
def p3(r: Registry) -> DataFrame:
    return registry.cross_refs_of(r.drawings, "NRE-EC-205.0")


@query("p10_involving", "reference drawing", "SELECT drawing_id, ref FROM (SELECT DISTINCT drawing_id, ref, CASE WHEN starts_with(ref, 'NRE-') THEN ref ELSE 'NRE-' || ref END AS f FROM reference) WHERE f NOT IN (SELECT drawing_id FROM drawing) AND drawing_id = 'NRE-EC-140.23'")
def p10(r: Registry) -> DataFrame:
    found = registry.involving(checks.broken_ref(r.drawings), "NRE-EC-140.23")
    return found.select(c("component_id").alias("drawing_id"), F.explode("values_found").alias("k", "ref")).select("drawing_id", "ref")


@query(
    "y2_authoritative_drawing",
    "line drawing component",
    f"""{_FIRST}, {_RULES}, kind AS (SELECT component_id, arg_min(component_type, drawing_id) AS ct FROM component GROUP BY component_id),
q AS (SELECT f.component_id, f.parameter, f.drawing_id, d.drawing_type, rank, n, row_number() OVER (PARTITION BY f.component_id, f.parameter ORDER BY rank, f.drawing_id) AS k FROM first f JOIN drawing d USING (drawing_id) JOIN kind USING (component_id) JOIN rule r ON r.parameter = f.parameter AND r.dtype = d.drawing_type AND (r.ctype = '*' OR r.ctype = ct))
SELECT component_id, parameter, drawing_id, drawing_type, drawing_type || ' is authoritative for ' || parameter || ' (priority ' || rank || ' of ' || n || ')' AS basis FROM q WHERE k = 1""",
)
def y2(r: Registry) -> DataFrame:
    kinds = r.components.groupBy("component_id").agg(F.min_by("component_type", "drawing_id").alias("component_type"))
    rows = propagation.first_values(r.components).join(kinds, "component_id").join(r.drawings.select("drawing_id", "drawing_type"), "drawing_id")
    return authority.pick_authority(rows, authority.default_rules(r.spark), ["component_id", "parameter"])


@query("k1_replaced", "component", "SELECT drawing_id, component_id FROM component WHERE drawing_id NOT LIKE 'NRE-EC-1%' UNION ALL SELECT DISTINCT drawing_id, 'new' FROM component WHERE drawing_id LIKE 'NRE-EC-1%'")
def k1(r: Registry) -> DataFrame:
    rows = r.components.select("drawing_id", "component_id")
    new = rows.filter(c("drawing_id").like("NRE-EC-1%")).select("drawing_id", F.lit("new").alias("component_id")).distinct()
    return changes.replaced(rows, new)


_RESCAN = """d AS (SELECT drawing_id, k % 10 = 0 AS scanned, k % 20 = 0 AS filled FROM drawing),
n AS (SELECT component.drawing_id, component_id, scanned, CASE WHEN NOT scanned THEN component_type WHEN filled AND component_type <> '52' THEN 'LOR' END AS component_type FROM component JOIN d USING (drawing_id))"""


def _rescanned(r: Registry) -> tuple[DataFrame, DataFrame, Table]:
    """A tenth of the drawings is scanned again: of half of these some components stay, with another type and no values, and the others have become empty."""
    old = r.components.select("drawing_id", "component_id", "component_type", "values")
    scanned = r.raw("drawing").filter("k % 10 = 0").select("drawing_id", "k")
    new = old.filter("component_type <> '52'").join(scanned.filter("k % 20 = 0"), "drawing_id").drop("k")
    new = new.withColumns({"component_type": F.lit("LOR"), "values": F.slice("values", 1, 0)})
    table = Table(r.spark, f"{new_path(r.spark, 'registry')}/components", "drawing_id string, component_id string, component_type string, values array<struct<parameter:string,value:string,unit:string,numeric_value:double>>", buckets=max(16, r.buckets))
    table.write(old)
    changed = written(changes.detect_changes(table.of(scanned), new, scanned), "changed")
    table.replace(new, scanned)
    return scanned, changed, table


@query("k1_rescan", "drawing component", f"{_RESCAN} SELECT drawing_id, component_id, component_type FROM n WHERE component_type IS NOT NULL")
def k1_rescan(r: Registry) -> DataFrame:
    """K1 written and read back, with drawings that have become empty."""
    return _rescanned(r)[2].read().select("drawing_id", "component_id", "component_type")


@query("h1_rescan", "drawing component", f"{_RESCAN} SELECT drawing_id, component_id, CASE WHEN component_type IS NULL THEN 'COMPONENT_REMOVED' ELSE 'VALUE_CHANGED' END AS change_type FROM n WHERE scanned")
def h1_rescan(r: Registry) -> DataFrame:
    """H1 with the removal of a drawing's last components, appended to a log and read back (K4)."""
    log = f"{new_path(r.spark, 'registry')}/change_log"
    append(_rescanned(r)[1], log)
    return r.spark.read.parquet(log).select("drawing_id", "component_id", "change_type")


# Files and streams


def _manifest(r: Registry) -> tuple[DataFrame, DataFrame]:
    known = r.raw("drawing").filter("k % 5 <> 0").select("drawing_id", F.sha2("title", 256).alias("file_hash"))
    found = r.raw("drawing").select("drawing_id", F.sha2(F.when(c("k") % 3 == 0, F.lit("changed")).otherwise(c("title")), 256).alias("sha256"))
    return found, known


_DELTA = "m AS (SELECT drawing_id, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 3 = 0 THEN 'updated' ELSE 'skipped' END AS status FROM drawing)"


@query("s2_hash_delta", "drawing", f"{_DELTA} SELECT * FROM m")
def s2(r: Registry) -> DataFrame:
    return files.hash_delta(*_manifest(r)).select("drawing_id", "status")


@query("s3_scan_results", "drawing", f"{_DELTA} SELECT status, count(*) AS n FROM m GROUP BY status")
def s3(r: Registry) -> DataFrame:
    return files.scan_results(files.hash_delta(*_manifest(r)))


@query(
    "s1_incremental_scan",
    "drawing",
    """f AS (SELECT drawing_id, k % 3 AS m, k % 4 AS q FROM drawing WHERE k % 25 = 0),
r(scan, drawing_id, status) AS (SELECT 1, drawing_id, 'new' FROM f WHERE m <> 2 UNION ALL SELECT 2, drawing_id, CASE WHEN m = 2 THEN 'new' WHEN m = 1 AND q = 0 THEN 'updated' ELSE 'skipped' END FROM f UNION ALL SELECT 3, drawing_id, 'skipped' FROM f)
SELECT * FROM r""",
)
def s1_scan(r: Registry) -> DataFrame:
    """A file for each 25th drawing, scanned, some changed, touched or added, and scanned twice again."""
    at = new_path(r.spark, "files")
    known = files.Table(r.spark, f"{at}/known", files.MANIFEST, buckets=8)
    drawings = r.raw("drawing").filter("k % 25 = 0").select("k", F.concat("drawing_id", F.lit(".pdf")).alias("name"), F.concat_ws(" ", "drawing_id", "title", "revision").alias("text"))
    text = lambda rows: rows.withColumn("content", F.col("text").cast("binary"))
    files.write_files(text(drawings.filter("k % 3 <> 2")), f"{at}/in")
    seen = [files.rescan(r.spark, f"{at}/in", known)]
    files.write_files(text(drawings.filter("k % 3 = 2 OR k % 3 = 1 AND k % 4 = 1")), f"{at}/in")  # new ones, and some with the same bytes
    files.write_files(text(drawings.filter("k % 3 = 1 AND k % 4 = 0").withColumn("text", F.concat("text", F.lit(" B")))), f"{at}/in")
    seen += [files.rescan(r.spark, f"{at}/in", known), files.rescan(r.spark, f"{at}/in", known)]
    rows = [df.select(F.lit(n).alias("scan"), "drawing_id", "status") for n, df in enumerate(seen, 1)]
    return reduce(DataFrame.union, rows)


@query("s11_rules", "drawing", "SELECT k AS rule_pos, title AS parameter, CASE WHEN k % 2 = 0 THEN '*' ELSE revision END AS types, drawing_type || ',' || revision AS ranked FROM drawing WHERE k % 100 = 0")
def s11(r: Registry) -> DataFrame:
    """S11 written and read back: rules that are made of drawings, in an order that isn't their names'."""
    at = f"{new_path(r.spark, 'rules')}/rules"
    rules = r.raw("drawing").filter("k % 100 = 0").select(c("k").alias("rule_pos"), c("title").alias("parameter"), F.when(c("k") % 2 == 1, F.array("revision")).alias("component_types"), F.array("drawing_type", "revision").alias("authority_order"), F.lit("").alias("description"))
    decoded.write_rules(rules, at)
    # the places in the list are dense; the numbers that were given ascend as they do
    given = rules.select("rule_pos", (F.row_number().over(W.orderBy("rule_pos")) - 1).alias("at"))
    back = decoded.read_rules(r.spark, at).withColumnRenamed("rule_pos", "at").join(given, "at")
    return back.select("rule_pos", "parameter", F.array_join("component_types", ",").alias("types"), F.array_join("authority_order", ",").alias("ranked"))


@query("k7_drawing_json", "drawing line component", "SELECT drawing_id, drawing_type, component_id, component_type, row_number() OVER (PARTITION BY drawing_id, component_id ORDER BY l.pos) - 1 AS idx, parameter, value, l.unit FROM drawing JOIN component USING (drawing_id) JOIN line l USING (drawing_id, component_id)".replace("component_type, row", "component.component_type, row"))
def k7(r: Registry) -> DataFrame:
    """K7 written and read back, a hundred drawings a file at most."""
    at = f"{new_path(r.spark, 'json')}/drawings"
    registry_files.write_drawing_json(r.drawings.select("drawing_id", "drawing_type"), r.components, at, most=100)
    parts = registry_files.read_drawing_json(r.spark, at).select("drawing_id", "drawing_type", F.explode("components").alias("p"))
    return parts.select("drawing_id", "drawing_type", "p.component_id", "p.component_type", F.posexplode("p.values").alias("idx", "v")).select("drawing_id", "drawing_type", "component_id", "component_type", "idx", "v.parameter", "v.value", "v.unit")


@query(
    "k8_full_json",
    "drawing component connection label",
    """s AS (SELECT component_id, count(*) AS n FROM component GROUP BY component_id)
SELECT 'statistics' AS part, 'drawings' AS name, count(*)::VARCHAR AS value FROM drawing UNION ALL SELECT 'statistics', 'component_instances', count(*)::VARCHAR FROM component UNION ALL SELECT 'statistics', 'unique_components', count(*)::VARCHAR FROM s
UNION ALL SELECT 'statistics', 'connections', count(*)::VARCHAR FROM connection UNION ALL SELECT 'statistics', 'labels', count(*)::VARCHAR FROM label UNION ALL SELECT 'statistics', 'shared_components', count(*)::VARCHAR FROM s WHERE n >= 2 UNION ALL SELECT 'statistics', 'active_mismatches', '0'
UNION ALL SELECT 'shared', component_id, string_agg(drawing_id, ',' ORDER BY drawing_id) FROM component JOIN s USING (component_id) WHERE n >= 2 GROUP BY component_id
UNION ALL SELECT 'graph', drawing_id, (SELECT count(*) FROM component c JOIN s USING (component_id) WHERE c.drawing_id = drawing.drawing_id AND n >= 2)::VARCHAR FROM drawing""",
)
def k8(r: Registry) -> DataFrame:
    """K8 written and read back: all three parts as (part, name, value)."""
    at = new_path(r.spark, "export")
    none = r.spark.createDataFrame([], "mismatch_id string, resolved boolean")
    parts = {"statistics": registry.statistics(r.drawings, r.components, r.connections, r.labels, none), "shared": registry.shared_components(r.components), "graph": reports.dependency_graph(r.drawings, r.components)}
    registry_files.export_json(parts, at, most=5000)
    back = registry_files.read_export(r.spark, at)
    counts = back["statistics"].select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in back["statistics"].columns)), F.array(*(F.coalesce(c(n), F.lit(0)).cast("string") for n in back["statistics"].columns)))).alias("name", "value"))
    rows = counts.select(F.lit("statistics").alias("part"), "name", "value")
    rows = rows.union(back["shared"].select(F.lit("shared"), "component_id", F.array_join("drawings", ",")))
    return rows.union(back["graph"].select(F.lit("graph"), "drawing_id", c("n_shared").cast("string")))


@query("k9_cable_tables")
def k9(r: Registry) -> DataFrame:
    """K9 written and read back: the list, with its place among the rows of its drawing, and the schedule."""
    at = new_path(r.spark, "cables")
    registry_files.write_cables(r.connections, r.components, r.drawings, at, most=10000)
    listed, schedule, by = registry_files.read_cables(r.spark, at)
    numbers = lambda df, name: df.select(F.lit(name).alias("part"), "drawing_id", "seq", "cable_number", "from_component", "to_component", "cable_spec", "signal")
    rows = numbers(listed, "list").union(numbers(by, "by drawing"))
    return rows.union(schedule.select(F.lit("schedule"), F.lit(""), "n", "spec", c("n_drawings").cast("string"), c("n_from").cast("string"), c("n_to").cast("string"), F.lit("")))


_LIST = "drawing_id, seq, cable_number, from_component, to_component, cable_spec, signal"
ORACLES["k9_cable_tables"] = f"""SELECT part, {_LIST} FROM ({ORACLES["r8_cable_list"]}), (VALUES ('list'), ('by drawing')) AS p(part)
UNION ALL SELECT 'schedule', '', n, spec, n_drawings::VARCHAR, n_from::VARCHAR, n_to::VARCHAR, '' FROM ({ORACLES["a5_cable_schedule"]})"""


@query("t4_event_filter", "event", "SELECT event_id, path FROM event WHERE NOT ends_with(path, '.tmp')")
def t4(r: Registry) -> DataFrame:
    return r.raw("event").filter(files.wanted(c("path"))).select("event_id", "path")


def _walk_sql(table: str, time: str, gap: str) -> str:
    return f"""RECURSIVE_ t AS (SELECT path, {time} AS t, min(event_id) AS event_id FROM {table} GROUP BY ALL),
a(path, t) AS (SELECT path, min(t) FROM t GROUP BY path UNION ALL SELECT path, min(n) FROM (SELECT a.path, t.t AS n FROM a JOIN t ON t.path = a.path AND t.t >= a.t + {gap}) GROUP BY path)
SELECT t.path, t.event_id, CAST(t.t AS VARCHAR) AS t FROM a JOIN t USING (path, t)"""


@query("t2_debounce", "event", _walk_sql("event", "ts", "INTERVAL 1 HOUR"))
def t2(r: Registry) -> DataFrame:
    """W9 with an hour's gap: the given events of a path are far apart."""
    return watch.debounce(r.raw("event").select("path", "event_id", "ts"), seconds=3600.0).select("path", "event_id", c("ts").cast("string").alias("t"))


def _burst(r: Registry) -> DataFrame:
    return r.raw("burst").select("path", "event_id", F.timestamp_micros("us").alias("ts"))


@query("w9_debounce_close", "burst", _walk_sql("burst", "us", "2000000"))
def w9(r: Registry) -> DataFrame:
    """W9 at two seconds over events less than a second apart in few paths."""
    return watch.debounce(_burst(r)).select("path", "event_id", F.unix_micros("ts").cast("string").alias("t"))


def _streamed(r: Registry, events: DataFrame, seconds: float, parts: int) -> DataFrame:
    """T2 over events that come in parts of the time, the stream being started again for each."""
    at = new_path(r.spark, "debounce")
    low, high = events.select(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for k in range(parts if low is not None else 0):
        part = F.least(F.floor((F.unix_micros("ts") - low) * parts / max(high - low, 1)), F.lit(parts - 1))
        events.filter(part == k).write.mode("append").parquet(f"{at}/in")
        watch.run_debounce(r.spark, f"{at}/in", f"{at}/out", f"{at}/state", seconds)
    return r.spark.read.schema("path string, event_id bigint, ts timestamp").parquet(f"{at}/out")


@query("t2_stream_hour", "event", _walk_sql("event", "ts", "INTERVAL 1 HOUR"))
def t2_hour(r: Registry) -> DataFrame:
    """T2 on a stream, an hour's gap."""
    return _streamed(r, r.raw("event").select("path", "event_id", c("ts").cast("timestamp").alias("ts")), 3600.0, 2).select("path", "event_id", c("ts").cast("string").alias("t"))


@query("t2_stream_close", "burst", _walk_sql("burst", "us", "2000000"))
def t2_close(r: Registry) -> DataFrame:
    """T2 on a stream at two seconds, started three times."""
    return _streamed(r, _burst(r), 2.0, 3).select("path", "event_id", F.unix_micros("ts").cast("string").alias("t"))


for _name in ("t2_debounce", "w9_debounce_close", "t2_stream_hour", "t2_stream_close"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_ ", "")


def scans_of(r: Registry) -> DataFrame:
    """The registry's drawings as scans, with all that was extracted from them."""
    values = F.struct("component_id", "component_type", "values", "attributes", "signals")
    parts = r.components.groupBy("drawing_id").agg(F.collect_list(values).alias("components"))
    ends = r.connections.groupBy("drawing_id").agg(F.collect_list(F.struct("from_component", "to_component", "cable_spec", "wire_label", "signal_type", "seq")).alias("connections"))
    rows = r.drawings.select("drawing_id", "drawing_type", c("title").alias("file_hash"), F.lit(None).cast("timestamp").alias("scanned"), "cross_references", "terminal_blocks", "k")
    return rows.join(parts, "drawing_id", "left").join(ends, "drawing_id", "left")


_SCANNED = [x.split()[0] for x in upkeep.SCAN.split(", ")]


def _kept_up(r: Registry, cuts) -> tuple[str, list[DataFrame]]:
    """Batches of scans through the change stream, the stream being started for each; its root and the batches."""
    scans = written(scans_of(r), "scans")
    root, batches = new_path(r.spark, "upkeep"), [cut(scans).select(*_SCANNED) for cut in cuts]
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/in")
        upkeep.change_stream(r.spark, f"{root}/in", root, authority.default_rules(r.spark), buckets=8).awaitTermination()
    return root, batches


def _emptied(scans: DataFrame) -> DataFrame:
    return scans.withColumns({n: F.slice(n, 1, 0) for n in ("components", "connections", "cross_references")})


def _relabelled(scans: DataFrame) -> DataFrame:
    """Other values, types and references than the drawing has in the end."""
    parts = F.transform("components", lambda p: p.withField("values", F.slice(p["values"], 1, 1)).withField("component_type", F.lit("86")))
    return scans.withColumns({"components": F.slice(parts, 2, 100000), "cross_references": F.array(F.lit("EC-100.0"), F.lit("EC-999.9")), "drawing_type": F.lit("LEGEND")})


@query("t1_change_stream")
def t1(r: Registry) -> DataFrame:
    """Open mismatches after three batches: some drawings as they are, others altered or empty, and then those as they are."""
    cuts = [
        lambda s: s.filter("k % 5 <> 0").unionByName(_relabelled(s.filter("k % 10 = 5"))),
        lambda s: _emptied(s.filter("k % 15 = 1")).unionByName(_relabelled(s.filter("k % 30 = 0"))),
        lambda s: s.filter("k % 5 = 0 OR k % 15 = 1"),
    ]
    root, _ = _kept_up(r, cuts)
    rows = upkeep.Upkeep(r.spark, root, authority.default_rules(r.spark), buckets=8).mismatches.read()
    return flat(rows.filter("not resolved"))


ORACLES["t1_change_stream"] = ORACLES["u1_all_checks"]


# Page texts and tables


@query("x8_title_fields", "page", "SELECT drawing_id, 'Station ' || (k % 9) AS project, CASE WHEN k % 3 = 0 THEN 'D' || (k % 7) ELSE '' END AS drawn_by, CASE WHEN k % 5 = 0 THEN 'E' || (k % 4) ELSE '' END AS designed_by FROM page")
def x8(r: Registry) -> DataFrame:
    return r.raw("page").select("drawing_id", X.title_fields(c("text")).alias("t")).select("drawing_id", "t.*")


def _notes(r: Registry) -> DataFrame:
    return r.raw("page").select("drawing_id", F.explode(X.notes(c("text"))).alias("note"))


@query(
    "x9_notes",
    "page",
    "SELECT drawing_id, CASE WHEN k % 2 = 0 THEN '1. WIRE SIZE IS #10 UNLESS' || chr(10) || '   MARKED | ' ELSE '' END || 'CHECK THE LINE OF BAY ' || (k % 11) || CASE WHEN k % 4 = 0 THEN ' | WARNING: live parts' ELSE '' END AS notes FROM page",
)
def x9(r: Registry) -> DataFrame:
    return r.raw("page").select("drawing_id", F.array_join(X.notes(c("text")), " | ").alias("notes"))


@query("r5_warnings", "page", "SELECT drawing_id, 'WARNING: live parts' AS warning FROM page WHERE k % 4 = 0")
def r5_warnings(r: Registry) -> DataFrame:
    return reports.warnings(_notes(r))


@query("r5_voltages", "page", "SELECT drawing_id, CASE WHEN k % 6 = 0 THEN '34.5kV' ELSE '13.8kV' END AS level FROM page UNION ALL SELECT drawing_id, '125V DC' FROM page")
def r5_voltages(r: Registry) -> DataFrame:
    return reports.voltages(r.raw("page"))


@query(
    "r5_inventory",
    "line component",
    """v AS (SELECT drawing_id, component_id, string_agg(CASE WHEN k <= 3 THEN parameter || '=' || value END, ', ' ORDER BY k) || CASE WHEN max(k) > 3 THEN ' +' || (max(k) - 3) || ' more' ELSE '' END AS shown, arg_max(device, pos) FILTER (device <> '') AS dev FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, component_id ORDER BY pos) AS k FROM line) GROUP BY ALL)
SELECT drawing_id, component_id, component_type, shown, CASE WHEN dev IS NULL THEN '' ELSE 'associated_device=' || dev END AS attributes FROM v JOIN component USING (drawing_id, component_id)""",
)
def r5_inventory(r: Registry) -> DataFrame:
    return reports.inventory(r.components)


@query("x11_in_table", "table_row component line", "SELECT drawing_id, component_id, bool_or(pk % 3 = 0 AND component_id NOT LIKE '86%' AND component_id NOT LIKE 'RTAC%') AS in_table FROM line GROUP BY ALL")
def x11(r: Registry) -> DataFrame:
    return X.in_table(r.components.select("drawing_id", "component_id"), r.raw("table_row"))


@query("x14_block_names", "component", "SELECT DISTINCT component_id AS name, CASE WHEN component_id LIKE '86%' THEN '' WHEN component_id LIKE 'RTAC%' THEN 'RTAC' ELSE component_id END AS component_id FROM component")
def x14_names(r: Registry) -> DataFrame:
    """X14 on the names of symbols that show one component each."""
    return r.components.select(c("component_id").alias("name")).distinct().select("name", X.id_from_name(F.concat(F.lit("SYMBOL "), c("name"))).alias("component_id"))


# Entities of every kind


_MARK_KIND = "CASE WHEN text = '125V' THEN 'value' WHEN text LIKE '86%' THEN 'text' ELSE 'component' END"


@query("s5_entity_labels", "mark", f"t AS (SELECT drawing_id, seq, x, y, 0 AS line, trim(text) AS text FROM mark WHERE etype = 'TEXT' UNION ALL SELECT drawing_id, seq, x, y, 0, string_split(text, chr(10))[1] FROM mark WHERE etype = 'MTEXT' UNION ALL SELECT drawing_id, seq, x, y, 2, '125V' FROM mark WHERE etype = 'MTEXT') SELECT *, {_MARK_KIND} AS category FROM t")
def s5(r: Registry) -> DataFrame:
    return decoded.entity_labels(r.raw("mark"))


@query("s6_dimension_labels", "mark", "SELECT drawing_id, seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0 AS line, trim(text) AS text, 'dimension' AS category FROM mark WHERE etype = 'DIMENSION' AND trim(text) <> ''")
def s6(r: Registry) -> DataFrame:
    return decoded.dimension_labels(r.raw("mark"))


@query("s7_attribute_notes", "mark", "SELECT drawing_id, seq, 'Block ' || block_name || ': ' || tag || ' = ' || coalesce(text, '') AS note FROM mark WHERE etype = 'ATTDEF' AND block_name NOT LIKE '*%'")
def s7(r: Registry) -> DataFrame:
    return decoded.attribute_notes(r.raw("mark"))


@query(
    "b1_title_blocks",
    "drawing",
    "SELECT drawing_id, 'drawing_number' AS field, drawing_id AS value FROM drawing UNION ALL SELECT drawing_id, 'drawing_type', 'Cable' FROM drawing UNION ALL SELECT drawing_id, 'drawing_name', title FROM drawing UNION ALL SELECT drawing_id, 'revision', CASE WHEN k % 3 = 0 THEN 'Z' ELSE revision END FROM drawing UNION ALL SELECT drawing_id, 'drawn_by', 'second' FROM drawing WHERE k % 3 = 0",
)
def b1(r: Registry) -> DataFrame:
    """A second block replaces the revision, and its title is a second part."""
    texts = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    first = r.raw("drawing").select("drawing_id", F.lit(1).alias("seq"), F.lit("A TITLE").alias("block_name"), texts(DWGNO=c("drawing_id"), DWGTYPE=F.lit("Cable"), CURRREV=c("revision"), DWGTITLE1=c("title")).alias("attribs"))
    second = r.raw("drawing").filter("k % 3 = 0").select("drawing_id", F.lit(2).alias("seq"), F.lit("TITLE 2").alias("block_name"), texts(CURRREV=F.lit("Z"), DRWNBY=F.lit("second"), DWGTITLE2=F.lit("part two")).alias("attribs"))
    return cad.title_blocks(first.union(second))


@query("b9_terminals", "line", "SELECT DISTINCT drawing_id, CASE pk % 3 WHEN 0 THEN 'TB' || (sk % 9) || '-' || qty WHEN 1 THEN 'TERM-D' || qty ELSE 'TERM-PNL_TERM' END AS component_id, 'TB' AS component_type FROM line")
def b9(r: Registry) -> DataFrame:
    attribs = F.when(c("pk") % 3 == 0, F.create_map(F.lit("TAGSTRIP"), F.concat(F.lit("TB"), (c("sk") % 9).cast("string")), F.lit("TERM#"), c("qty").cast("string"))).when(c("pk") % 3 == 1, F.create_map(F.lit("TERM_DESC"), F.concat(F.lit("D"), c("qty").cast("string")))).otherwise(F.create_map(F.lit("X"), F.lit("1")))
    blocks = r.raw("line").select("drawing_id", F.lit(0).alias("layout"), c("pos").alias("seq"), F.lit("PNL_TERM").alias("block_name"), attribs.alias("attribs"), "x", "y")
    return cad.block_components(blocks).select("drawing_id", "component_id", "component_type")


# Nameplates and sheet rows


def _plates(r: Registry) -> DataFrame:
    return r.raw("plate").select(F.lit("plates BOM.xlsx").alias("file_name"), "drawing_id", F.lit("P1 NAMEPLATE").alias("sheet"), F.lit(0).alias("sheet_pos"), c("rw").alias("row"), c("cl").alias("col"), "value")


_PLATE = """p AS (SELECT drawing_id, pos, CASE sk % 6 WHEN 0 THEN 'P1-TB' || (sk % 4) WHEN 1 THEN 'P1-FU' || qty WHEN 2 THEN 'P1-SW-' || qty WHEN 3 THEN 'NORTH BAY' WHEN 4 THEN '138kV LINE' ELSE 'CT-LONG NAME' END AS component_id, CASE WHEN qty % 4 = 0 THEN '' ELSE CASE qty % 3 WHEN 0 THEN 'MAIN FUSE' WHEN 1 THEN 'JUNCTION BOX' ELSE 'OTHER' END END AS d FROM line),
q AS (SELECT *, CASE WHEN contains(d, 'FUSE') THEN 'FU' WHEN d = 'JUNCTION BOX' THEN 'JB' WHEN starts_with(component_id, 'CT-') THEN 'CT' ELSE 'BOM' END AS kind FROM p)"""


@query("e7_nameplates", "line", f"{_PLATE} SELECT drawing_id, component_id, arg_min(kind, pos) AS component_type, CAST(max(pos) AS VARCHAR) AS item FROM q GROUP BY ALL")
def e7(r: Registry) -> DataFrame:
    return bom.nameplates(_plates(r)).select("drawing_id", "component_id", "component_type", "item")


_DESIGNATION = "CASE WHEN t IN ('TB', 'TS') THEN 'TB' WHEN t = 'FU' OR qty % 4 = 0 THEN 'FU' WHEN t = 'SW' THEN 'SW' WHEN qty % 4 = 1 THEN 'JB' WHEN t IN ('CT', 'VT', 'PT', 'CCVT') THEN t ELSE 'BOM' END"


@query("e8_designation_type", "line", f"d AS (SELECT drawing_id, pos, qty, CASE sk % 9 WHEN 0 THEN 'TB' WHEN 1 THEN 'TS' WHEN 2 THEN 'FU' WHEN 3 THEN 'SW' WHEN 4 THEN 'CT' WHEN 5 THEN 'VT' WHEN 6 THEN 'PT' WHEN 7 THEN 'CCVT' ELSE 'ZZ' END AS t FROM line) SELECT drawing_id, pos, {_DESIGNATION} AS kind FROM d")
def e8(r: Registry) -> DataFrame:
    k = c("sk") % 9
    number = c("qty").cast("string")
    name = F.when(k == 0, F.concat(F.lit("LT1-TB"), number)).when(k == 1, "TS").when(k == 2, F.concat(F.lit("FU"), number)).when(k == 3, F.concat(F.lit("SW-"), number)).when(k == 4, "CT-1").when(k == 5, "VT-A").when(k == 6, "PT-2").when(k == 7, "CCVT9").otherwise("ZZ")
    what = F.when(c("qty") % 4 == 0, "spare fuse").when(c("qty") % 4 == 1, "Junction Box").when(c("qty") % 4 == 2, "other")
    return r.raw("line").select("drawing_id", "pos", bom.designation_type(name, what).alias("kind"))


@query(
    "e10_row_attributes",
    "line",
    """f AS (SELECT drawing_id, component_id, max(pos) AS pos FROM line GROUP BY ALL),
g AS (SELECT drawing_id, component_id, k, arg_max(v, pos) AS v FROM (SELECT drawing_id, component_id, pos, 'QTY' AS k, CASE WHEN qty % 9 = 0 THEN 'LOT' ELSE CAST(qty AS VARCHAR) END AS v FROM line UNION ALL SELECT drawing_id, component_id, pos, 'col_9', 'x' || sk FROM line) GROUP BY ALL)
SELECT drawing_id, component_id, string_agg(k || '=' || v, ', ' ORDER BY k) AS attributes FROM g GROUP BY ALL""",
)
def e10(r: Registry) -> DataFrame:
    line = r.raw("line")
    at = lambda col, value: line.select("drawing_id", F.lit("s").alias("sheet"), F.lit(0).alias("sheet_pos"), (c("pos") + 1).alias("row"), F.lit(col).alias("col"), value.alias("value"))
    cells = at(0, c("component_id")).union(at(1, F.when(c("qty") % 9 == 0, "LOT").otherwise(c("qty").cast("string")))).union(at(9, F.concat(F.lit("x"), c("sk").cast("string"))))
    heads = r.raw("drawing").select("drawing_id", F.lit("s").alias("sheet"), F.create_map(F.lit(0), F.lit("DEVICE"), F.lit(1), F.lit(" QTY "), F.lit(9), F.lit(" ")).alias("header"))
    found = line.select("drawing_id", F.lit("s").alias("sheet"), (c("pos") + 1).alias("row"), "component_id")
    return bom.row_attributes(cells, found, heads).withColumn("attributes", _text_map(c("attributes")))


@query("e11_row_voltages", "line component", "SELECT l.drawing_id, pos AS row, (qty % 4 + 1) || 'kV' AS value, arg_min(i.component_id, i.first_pos) AS component_id FROM line l JOIN (SELECT drawing_id, component_id, min(pos) AS first_pos FROM line GROUP BY ALL) i ON i.drawing_id = l.drawing_id AND contains(l.component_id, i.component_id) WHERE qty % 2 = 0 GROUP BY ALL")
def e11(r: Registry) -> DataFrame:
    line = r.raw("line")
    rows = line.select("drawing_id", F.lit("s").alias("sheet"), c("pos").alias("row"), F.when(c("qty") % 2 == 0, F.concat(F.lit("ITEM "), c("component_id"), F.lit(" AT "), (c("qty") % 4 + 1).cast("string"), F.lit("kV"))).otherwise(c("component_id")).alias("text"))
    first = line.groupBy("drawing_id", "component_id").agg(F.min("pos").alias("first_seen"))
    return bom.row_voltages(rows, first).select("drawing_id", "row", "value", "component_id")


# Logs and stored mismatches


def _mismatches(r: Registry) -> DataFrame:
    return r.raw("mismatch").withColumn("drawings_involved", F.array("drawing_id"))


@query("p1_get_drawing", "drawing", "SELECT drawing_id, drawing_type, title, revision FROM drawing WHERE drawing_id = 'NRE-EC-205.0'")
def p1(r: Registry) -> DataFrame:
    return registry.get_drawing(r.drawings, "NRE-EC-205.0").select("drawing_id", "drawing_type", "title", "revision")


@query("p7_resolve", "mismatch", "SELECT mismatch_id, resolved OR mismatch_id = 'mm1-1' AS resolved FROM mismatch")
def p7(r: Registry) -> DataFrame:
    return registry.resolve_mismatch(_mismatches(r).withColumn("resolved_at", F.lit(None).cast("timestamp")), "mm1-1").select("mismatch_id", "resolved")


@query("o1_active_mismatches", "mismatch", "SELECT mismatch_id, severity, detected_at FROM mismatch WHERE NOT resolved")
def o1(r: Registry) -> DataFrame:
    return registry.active_mismatches(_mismatches(r)).select("mismatch_id", "severity", "detected_at")


@query("o1_gravest", "mismatch", "SELECT mismatch_id FROM mismatch WHERE NOT resolved ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, detected_at DESC, mismatch_id LIMIT 40")
def o1_top(r: Registry) -> DataFrame:
    """The order of O1, by its first rows."""
    return registry.active_mismatches(_mismatches(r)).limit(40).select("mismatch_id")


@query("o2_change_log", "change", "SELECT stamp, component_id, change_type, description FROM change ORDER BY stamp DESC, component_id LIMIT 50")
def o2_log(r: Registry) -> DataFrame:
    return registry.newest(r.raw("change"), 50, "stamp", "component_id").select("stamp", "component_id", "change_type", "description")


@query("o3_propagation_log", "action", "SELECT action_id, stamp, status, approved_by FROM action WHERE status = 'APPLIED' ORDER BY stamp DESC, action_id LIMIT 50")
def o3(r: Registry) -> DataFrame:
    return registry.newest(r.raw("action"), 50, "stamp", "action_id", status="APPLIED").select("action_id", "stamp", "status", "approved_by")


@query("k5_propagation_rows", "line drawing component", f"{_PLAN} SELECT *, 'A. Planner' AS approved_by FROM act")
def k5(r: Registry) -> DataFrame:
    return propagation.propagation_log(_plan(r), "A. Planner").drop("timestamp")


@query("r7_change_report", "change", "SELECT stamp AS timestamp, drawing_id, component_id, change_type FROM change WHERE drawing_id = 'NRE-EC-101.0' ORDER BY stamp DESC, component_id LIMIT 50")
def r7(r: Registry) -> DataFrame:
    return reports.change_report(r.raw("change").withColumnRenamed("stamp", "timestamp"), drawing_id="NRE-EC-101.0").select("timestamp", "drawing_id", "component_id", "change_type")


@query("r6_mismatch_report", "mismatch drawing", "SELECT mismatch_id, severity, component_id, parameter, drawing_id, revision FROM mismatch JOIN drawing USING (drawing_id) WHERE NOT resolved")
def r6(r: Registry) -> DataFrame:
    return reports.mismatch_report(_mismatches(r), r.drawings).drop("rank")


_MANY = "sh AS (SELECT component_id, count(*) - 1 AS n_others FROM component GROUP BY component_id)"
_ADVICE_SQL = f"""{_MANY}, adv AS (SELECT drawing_id, 'recommendation' AS section, mismatch_id AS name, CASE severity WHEN 'CRITICAL' THEN '[RED FLAG] ' ELSE '[WARNING] ' END || message || ' ' || recommendation AS detail FROM mismatch WHERE NOT resolved AND severity <> 'INFO'
UNION ALL SELECT drawing_id, 'recommendation', component_id, 'in ' || (n_others + 1) || ' drawings: change them together' FROM component JOIN sh USING (component_id) WHERE n_others > 5)"""


@query("r4_recommendations", "mismatch component", f"{_ADVICE_SQL} SELECT * FROM adv")
def r4(r: Registry) -> DataFrame:
    return reports.recommendations(r.raw("mismatch").filter("not resolved"), r.components)


@query(
    "r3_sync_report_stored",
    "mismatch component",
    f"{_ADVICE_SQL} SELECT * FROM adv UNION ALL SELECT drawing_id, 'mismatch', mismatch_id, severity FROM mismatch WHERE NOT resolved UNION ALL SELECT drawing_id, 'component', component_id, CAST(n_others AS VARCHAR) FROM component JOIN sh USING (component_id)",
)
def r3_stored(r: Registry) -> DataFrame:
    """R3 over stored mismatches."""
    return reports.sync_report(r.components, _mismatches(r))


@query("k2_snapshot", "drawing component", "SELECT drawing_id, count(*) AS n_components, any_value(title) AS file_hash FROM component JOIN drawing USING (drawing_id) GROUP BY drawing_id")
def k2(r: Registry) -> DataFrame:
    made = changes.snapshot(r.components, r.raw("drawing").select("drawing_id", c("title").alias("file_hash")))
    return made.select("drawing_id", F.size("components").cast("long").alias("n_components"), "file_hash")


@query("k3_stored_mismatches", "mismatch", "SELECT mismatch_id, NOT found AS resolved FROM (SELECT mismatch_id, detected_at % 2 = 0 AS was, detected_at % 3 = 0 AS found FROM mismatch) WHERE was OR found")
def k3(r: Registry) -> DataFrame:
    rows = _mismatches(r).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    old = rows.filter("detected_at % 2 = 0").withColumn("detected_at", F.current_timestamp())
    found = rows.filter("detected_at % 3 = 0").drop("detected_at", "resolved", "resolved_at")
    return changes.stored_mismatches(old, found).select("mismatch_id", "resolved")


@query("k4_change_rows", "line drawing component", f"{_PLAN} SELECT target_drawing_id AS drawing_id, component_id, 'PROPAGATION' AS change_type, old_value, new_value FROM act")
def k4(r: Registry) -> DataFrame:
    return propagation.apply_actions(r.typed.drop("drawing_type"), _plan(r))[2].drop("timestamp", "description")


@query(
    "t3_event_rows",
    "drawing component mismatch line",
    f"""{_LAST}, p AS (SELECT a.drawing_id, count(*) AS n FROM last a JOIN drawing d ON d.drawing_id = a.drawing_id AND d.k % 10 = 0 JOIN last b ON a.component_id = b.component_id AND a.parameter = b.parameter AND a.drawing_id <> b.drawing_id AND a.value <> b.value GROUP BY a.drawing_id)
SELECT d.drawing_id, 'modified' AS event, (SELECT count(*) FROM component x WHERE x.drawing_id = d.drawing_id) AS n_components, (SELECT count(*) FROM mismatch x WHERE x.drawing_id = d.drawing_id) AS n_mismatches, coalesce(p.n, 0) AS n_affected FROM drawing d LEFT JOIN p USING (drawing_id) WHERE d.k % 10 = 0""",
)
def t3(r: Registry) -> DataFrame:
    changed = r.raw("drawing").filter("k % 10 = 0").select("drawing_id")
    return watch.event_rows(changed.withColumn("event", F.lit("modified")), r.components, _mismatches(r), propagation.impact(r.components, sources=changed))
