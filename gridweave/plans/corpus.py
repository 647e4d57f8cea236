"""A registry derived from the given tables, by SQL that Spark and DuckDB both run.

Orders are drawings, parts are components, line items are their instances, values and
connections.  Every table below grows with orders and lineitem.  As a registry is filled once
and then asked, the tables that most queries read are written to the shared folder at their
first use and read from there after.

Line items are exchanged once, as numbers, and written in buckets by drawing; their texts are
made after that.  What is grouped or joined within drawings (components, connections) then
needs no exchange.  The same rows come out as from the SQL, which the tests compare.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import buckets_for, state_of, stored

_TYPES = ("ONE_LINE", "AC_SCHEMATIC", "DC_SCHEMATIC", "PANEL_WIRING", "CABLE_WIRING", "PANEL_LAYOUT", "SYSTEM_DIAGRAM", "RELAY_FUNCTIONAL", "LEGEND", "COMMUNICATION")
_CODES = ("52", "50", "51", "87", "21", "CT", "86", "RTAC")


def _pick(n: str, values, other: str = "''") -> str:
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {other} END"


def _number(k: str) -> str:
    return f"'EC-' || CAST(100 + ({k}) % 650 AS STRING) || '.' || CAST(CAST(floor(({k}) / 650) AS BIGINT) AS STRING)"


_INST = f"'NRE-' || {_number('l_orderkey')}"
#: One line item in fifty has a component of its own, which no other drawing has.
_PART = f"{_pick('l_partkey % 8', _CODES)} || CASE WHEN l_quantity >= 50 THEN '-X' || CAST(l_orderkey AS STRING) ELSE '-L' || CAST(CAST(floor(l_partkey / 8) AS BIGINT) AS STRING) END"
#: A line item's place in its drawing.
_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)"
#: Common table expressions by name, in order.
TABLES = {
    "drawing": f"""SELECT o_orderkey AS k, 'NRE-' || {_number("o_orderkey")} AS drawing_id, {_pick("(o_orderkey * 7) % 11", _TYPES)} AS drawing_type,
  'Sheet ' || o_orderpriority AS title, o_orderstatus AS revision, o_orderdate AS last_scanned FROM orders""",
    "reference": f"""SELECT drawing_id, 0 AS pos, {_number("k + 1")} AS ref FROM drawing WHERE k % 3 = 0
  UNION ALL SELECT drawing_id, 1 AS pos, {_number("k * 7 + 3")} AS ref FROM drawing WHERE k % 5 = 0
  UNION ALL SELECT drawing_id, 2 AS pos, 'NRE-' || {_number("k * 2 + 1")} AS ref FROM drawing WHERE k % 7 = 0""",
    "terminal": """SELECT drawing_id, 'TB' || CAST(k % 4000 AS STRING) AS block, 1 + k % 2 AS terminals FROM drawing WHERE k % 4 <> 1
  UNION ALL SELECT drawing_id, 'TB' || CAST((k + 7) % 4000 AS STRING) AS block, 2 + k % 4 AS terminals FROM drawing WHERE k % 4 = 1""",
    "line": f"""SELECT {_INST} AS drawing_id, {_PART} AS component_id, l_orderkey AS ok, {_POS} AS pos, l_partkey AS pk,
  CASE WHEN l_linenumber = 7 AND l_partkey % 11 = 0 THEN 'RELAY' ELSE {_pick("l_partkey % 8", _CODES)} END AS component_type,
  {_pick("l_linenumber % 5", ("voltage_rating", "current_rating", "power_rating", "impedance", "ratio"))} AS parameter,
  CAST(CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 50 ELSE CAST(floor(l_quantity) AS BIGINT) % 3 END + 1 AS STRING) || {_pick("l_linenumber % 5", ("kV", "A", "MVA", "%", ":1"))} AS value,
  {_pick("l_linenumber % 5", ("kV", "A", "MVA", "%", ""))} AS unit,
  CASE WHEN l_partkey % 16 = 7 THEN '50-L' || CAST(CAST(floor(l_quantity) AS BIGINT) % 2 AS STRING) ELSE '' END AS device,
  CASE WHEN l_linenumber = 3 AND l_partkey % 5 = 0 THEN 'DC POWER' WHEN l_linenumber = 2 THEN 'TRIP' ELSE '' END AS signal,
  CAST(floor(l_extendedprice) AS BIGINT) % 900 AS x, CAST(floor(l_quantity * 17) AS BIGINT) % 600 AS y, CAST(floor(l_quantity) AS BIGINT) AS qty, l_suppkey AS sk FROM lineitem""",
    "instance": """SELECT drawing_id, component_id, min(pos) AS first_pos FROM line GROUP BY drawing_id, component_id""",
    "component": """SELECT i.drawing_id, i.component_id, l.component_type FROM instance i JOIN line l ON l.drawing_id = i.drawing_id AND l.component_id = i.component_id AND l.pos = i.first_pos""",
    "connection": """SELECT a.drawing_id, a.component_id AS from_component, CASE WHEN a.qty % 9 = 0 THEN 'BREAKER ' || b.component_id WHEN a.qty % 10 = 1 THEN a.component_id || ' RELAY' WHEN a.sk % 13 = 0 THEN 'DC' || CAST(a.sk % 4 AS STRING) || '.PWR' ELSE b.component_id END AS to_component,
  CASE WHEN a.qty % 4 = 0 THEN '' ELSE CAST(2 + a.qty % 3 AS STRING) || '/C#10' END AS cable_spec,
  CASE WHEN a.qty % 3 = 0 THEN '' ELSE 'W' || CAST(a.qty AS STRING) END AS wire_label,
  CASE WHEN a.qty % 5 = 0 THEN 'TRIP' ELSE '' END AS signal_type, a.pos AS seq FROM line a JOIN line b ON a.ok = b.ok AND b.pos = a.pos + 1""",
    "schedule": """SELECT drawing_id, CAST(2 + k % 6 AS STRING) || '/C#10' AS spec FROM drawing WHERE k % 2 = 0""",
    "label": """SELECT drawing_id, ok, pos AS seq, CASE pos % 6 WHEN 0 THEN 'TB' || CAST(sk % 9 AS STRING) || '-' || CAST(qty AS STRING) WHEN 1 THEN component_id WHEN 2 THEN CASE WHEN qty % 2 = 0 THEN 'TRIP' ELSE 'ALARM' END WHEN 3 THEN component_id WHEN 4 THEN CAST(qty AS STRING) || '/C#10' ELSE 'EC-' || CAST(100 + pk % 300 AS STRING) || '.' || CAST(qty % 10 AS STRING) END AS text,
  CAST(x % 400 AS DOUBLE) AS x, CAST(y % 120 AS DOUBLE) AS y FROM line""",
    "unit_text": """SELECT drawing_id, pos AS page, component_id || ' RATED ' || value || ' FED BY ' || CAST(qty AS STRING) || '/C #10 AT TB' || CAST(sk % 9 AS STRING) || '-' || CAST(qty AS STRING) || ' SEE EC-' || CAST(100 + pk % 300 AS STRING) || '.' || CAST(qty % 10 AS STRING)
  || CASE qty % 7 WHEN 0 THEN ' DPAC1 OUT101' WHEN 1 THEN ' 86MP SEL-451 SEL-C662' WHEN 2 THEN ' BREAKER 12 FU12A' WHEN 3 THEN ' CT-A.1 500kVA 125V DC' WHEN 4 THEN ' EMS-RTAC BECKWITH-M2001' WHEN 5 THEN ' CISCO IE-4010 UPS-1' ELSE ' BATTERY BANK #1 TC1' END AS text FROM line""",
    "spec_text": """SELECT drawing_id, pos AS page, CASE qty % 4 WHEN 0 THEN '' ELSE CAST(qty AS STRING) || '/C #10 and ' || CAST(sk % 5 AS STRING) || '/C#12AWG, ' END || CASE sk % 4 WHEN 0 THEN 'cat6e ' WHEN 1 THEN 'MM FIBER, Cat5 ' WHEN 2 THEN 'COAX coax ' ELSE 'CATALOG ' END
  || CASE qty % 3 WHEN 0 THEN 'W' || CAST(pk % 7 AS STRING) || '.05-B' || CAST(qty AS STRING) || '.AX ' ELSE '' END || CASE pk % 3 WHEN 0 THEN '12PR #16S 2/C #10 ' WHEN 1 THEN '4PR #18SH 4PR #18SH ' ELSE '' END
  || 'TB' || CAST(sk % 3 AS STRING) || '-' || CAST(qty AS STRING) || ' TS' || CAST(pk % 2 AS STRING) || '-' || CAST(qty % 3 AS STRING) || ' TB' || CAST(sk % 2 AS STRING) || '-' || CAST(qty % 7 AS STRING) || ' TB1-1 TB1-1 TS1-2' AS text FROM line""",
    "entity": """SELECT drawing_id, pk % 2 AS layout, pos AS seq, CASE pos % 7 WHEN 1 THEN 'DEVICE' WHEN 2 THEN 'FUSE_NUM' WHEN 3 THEN 'OUTPUT-#' WHEN 4 THEN 'INPUT-#1' WHEN 5 THEN 'PWR_SUP' WHEN 6 THEN 'TAG' ELSE 'NONE' END AS tag,
  CASE pos % 7 WHEN 2 THEN 'FU' || CAST(qty AS STRING) WHEN 3 THEN 'OUT1' || CAST(qty AS STRING) WHEN 4 THEN 'IN1' || CAST(qty AS STRING) WHEN 5 THEN '125V DC' ELSE component_id END AS tag_value,
  CASE pos % 7 WHEN 0 THEN CASE qty % 4 WHEN 0 THEN 'GROUND BAR' WHEN 1 THEN 'ETHERNET PORT' WHEN 2 THEN 'PLAIN' ELSE 'TITLEBLOCK' END ELSE 'SYMBOL' END AS block_name, CAST(qty AS STRING) AS loc, x, y FROM line""",
    "decision": """SELECT 'd' || CAST(ok AS STRING) || '-' || CAST(pos % 4 AS STRING) AS decision_id, CASE pos % 2 WHEN 0 THEN 'CLASSIFICATION' ELSE 'PROPAGATION' END AS decision_type, component_id, drawing_id, CAST(sk % 4 AS DOUBLE) / 4 AS confidence, ok * 10 + pos AS stamp, 'o' || CAST(qty AS STRING) AS outcome FROM line""",
    "cell": """SELECT drawing_id, 1 AS rw, 0 AS cl, 'ITEM#' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 1 AS cl, 'QTY' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 2 AS cl, 'CATALOG#' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 3 AS cl, 'MATERIAL' AS value FROM drawing
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 0 AS cl, CAST(pos AS STRING) AS value FROM line
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 1 AS cl, CASE WHEN qty % 9 = 0 THEN 'LOT' ELSE CAST(qty AS STRING) END AS value FROM line
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 2 AS cl, 'C-' || CAST(pk % 5 AS STRING) AS value FROM line WHERE pk % 7 <> 0
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 3 AS cl, CASE qty % 6 WHEN 0 THEN 'FUSE 30A' WHEN 1 THEN 'ENCLOSURE 125V DC' WHEN 2 THEN 'WIRE NO 10' WHEN 3 THEN 'TERMINAL BLOCK' WHEN 4 THEN 'POWER SUPPLY 5%Z' ELSE 'DIN RAIL' END AS value FROM line""",
    #: a book of two lists and a sheet that is none; the first list has a title above its header in a third of the drawings
    "book": """SELECT drawing_id, 'Material' AS sheet, 0 AS sheet_pos, 1 AS rw, 0 AS cl, 'STATION ' || CAST(k AS STRING) AS value FROM drawing WHERE k % 3 = 0
  UNION ALL SELECT drawing_id, 'Material' AS sheet, 0 AS sheet_pos, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS rw, cl, value FROM drawing, (SELECT 0 AS cl, 'ITEM#' AS value UNION ALL SELECT 1 AS cl, 'QTY' AS value UNION ALL SELECT 2 AS cl, 'CATALOG#' AS value UNION ALL SELECT 3 AS cl, 'MATERIAL' AS value) h
  UNION ALL SELECT drawing_id, 'Devices' AS sheet, 1 AS sheet_pos, 1 AS rw, cl, value FROM drawing, (SELECT 0 AS cl, 'ITEM' AS value UNION ALL SELECT 1 AS cl, 'QUANTITY' AS value UNION ALL SELECT 2 AS cl, 'DEVICE' AS value UNION ALL SELECT 3 AS cl, 'DESCRIPTION' AS value) h
  UNION ALL SELECT drawing_id, 'Remarks' AS sheet, 2 AS sheet_pos, 3 AS rw, 1 AS cl, 'AS BUILT' AS value FROM drawing WHERE k % 5 = 0
  UNION ALL SELECT drawing_id, CASE WHEN pos % 2 = 1 THEN 'Material' ELSE 'Devices' END AS sheet, CAST((pos + 1) % 2 AS INT) AS sheet_pos, pos + 2 AS rw, 0 AS cl, CAST(pos AS STRING) AS value FROM line
  UNION ALL SELECT drawing_id, CASE WHEN pos % 2 = 1 THEN 'Material' ELSE 'Devices' END AS sheet, CAST((pos + 1) % 2 AS INT) AS sheet_pos, pos + 2 AS rw, 1 AS cl, CASE WHEN qty % 9 = 0 THEN 'LOT' ELSE CAST(qty AS STRING) END AS value FROM line
  UNION ALL SELECT drawing_id, CASE WHEN pos % 2 = 1 THEN 'Material' ELSE 'Devices' END AS sheet, CAST((pos + 1) % 2 AS INT) AS sheet_pos, pos + 2 AS rw, 2 AS cl, CASE WHEN pos % 2 = 1 THEN CASE WHEN pk % 7 <> 0 THEN 'C-' || CAST(pk % 3 AS STRING) ELSE '' END ELSE CASE sk % 3 WHEN 0 THEN component_id WHEN 1 THEN 'C-' || CAST(pk % 3 AS STRING) ELSE ' ' END END AS value FROM line
  UNION ALL SELECT drawing_id, CASE WHEN pos % 2 = 1 THEN 'Material' ELSE 'Devices' END AS sheet, CAST((pos + 1) % 2 AS INT) AS sheet_pos, pos + 2 AS rw, 3 AS cl, CASE qty % 5 WHEN 0 THEN 'FUSE 30A 600V' WHEN 1 THEN 'TRANSFORMER 5%Z 12.5kV' WHEN 2 THEN 'SWITCH' WHEN 3 THEN 'POWER SUPPLY 48V DC 5A' ELSE 'LAMP' END AS value FROM line""",
    "index_cell": """SELECT sheet, sheet_pos, CAST(2 AS BIGINT) AS rw, cl, value FROM (SELECT 'Set 30%' AS sheet, 0 AS sheet_pos UNION ALL SELECT 'Set 90%' AS sheet, 1 AS sheet_pos) s, (SELECT 0 AS cl, 'DWG NO' AS value UNION ALL SELECT 1 AS cl, 'TYPE' AS value UNION ALL SELECT 2 AS cl, 'REV A' AS value UNION ALL SELECT 3 AS cl, 'DATE' AS value UNION ALL SELECT 4 AS cl, 'REV B' AS value) h
  UNION ALL SELECT 'Set 30%' AS sheet, 0 AS sheet_pos, k + 3 AS rw, 0 AS cl, replace(drawing_id, 'NRE-', '') AS value FROM drawing UNION ALL SELECT 'Set 30%' AS sheet, 0 AS sheet_pos, k + 3 AS rw, 1 AS cl, 'Cable' AS value FROM drawing UNION ALL SELECT 'Set 30%' AS sheet, 0 AS sheet_pos, k + 3 AS rw, 2 AS cl, 'r1' AS value FROM drawing
  UNION ALL SELECT 'Set 90%' AS sheet, 1 AS sheet_pos, k + 3 AS rw, 0 AS cl, drawing_id AS value FROM drawing WHERE k % 3 = 0 UNION ALL SELECT 'Set 90%' AS sheet, 1 AS sheet_pos, k + 3 AS rw, 1 AS cl, 'Layout' AS value FROM drawing WHERE k % 3 = 0 UNION ALL SELECT 'Set 90%' AS sheet, 1 AS sheet_pos, k + 3 AS rw, 3 AS cl, 'd9' AS value FROM drawing WHERE k % 3 = 0 UNION ALL SELECT 'Set 90%' AS sheet, 1 AS sheet_pos, k + 3 AS rw, 4 AS cl, 'r2' AS value FROM drawing WHERE k % 6 = 0""",
    "page": """SELECT drawing_id, k, 'PROJECT: old' || chr(10) || 'PROJECT: Station ' || CAST(k % 9 AS STRING) || chr(10) || CASE WHEN k % 3 = 0 THEN 'DRAWN BY: D' || CAST(k % 7 AS STRING) || chr(10) ELSE '' END || CASE WHEN k % 5 = 0 THEN 'Designed by E' || CAST(k % 4 AS STRING) || chr(10) ELSE '' END
  || 'NOTES:' || chr(10) || 'CHECK THE LINE OF BAY ' || CAST(k % 11 AS STRING) || chr(10) || 'abc' || chr(10) || CASE WHEN k % 4 = 0 THEN 'WARNING: live parts' || chr(10) ELSE '' END || chr(10) || CASE WHEN k % 2 = 0 THEN '1. WIRE SIZE IS #10 UNLESS' || chr(10) || '   MARKED' || chr(10) ELSE '' END
  || CASE WHEN k % 6 = 0 THEN '34.5kV' ELSE '13.8 KV' END || ' AND 125V DC' AS text FROM drawing""",
    "table_row": """SELECT drawing_id, 1 AS page, 0 AS table_no, pos AS row_no, CASE WHEN pk % 3 = 0 THEN 'ITEM ' || CAST(qty AS STRING) || ' ' || component_id || ' EA' ELSE 'SPARE' END AS row_text FROM line""",
    "mismatch": """SELECT 'mm' || CAST(ok AS STRING) || '-' || CAST(pos AS STRING) AS mismatch_id, CASE pos % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, component_id, parameter, drawing_id, component_id || ' differs' AS message, 'Check ' || component_id || '.' AS recommendation, ok * 10 + pos AS detected_at, pk % 4 = 0 AS resolved FROM line""",
    "change": """SELECT ok * 10 + pos AS stamp, drawing_id, component_id, CASE WHEN pk % 2 = 0 THEN 'VALUE_CHANGED' ELSE 'COMPONENT_ADDED' END AS change_type, 'c' || CAST(qty AS STRING) AS description FROM line""",
    "action": """SELECT 'a' || CAST(ok AS STRING) || '-' || CAST(pos AS STRING) AS action_id, ok * 10 + pos AS stamp, component_id, drawing_id AS target_drawing_id, CASE WHEN pk % 3 = 0 THEN 'APPLIED' ELSE 'FAILED' END AS status, 'u' || CAST(sk % 5 AS STRING) AS approved_by FROM line""",
    "mark": """SELECT drawing_id, pos AS seq, CASE pos % 4 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'MTEXT' WHEN 2 THEN 'DIMENSION' ELSE 'ATTDEF' END AS etype, CASE WHEN qty % 5 = 0 THEN '*U' || CAST(qty AS STRING) ELSE 'SYM' || CAST(qty AS STRING) END AS block_name, 'T' || CAST(sk % 3 AS STRING) AS tag,
  CASE pos % 4 WHEN 0 THEN ' ' || component_id WHEN 1 THEN component_id || chr(10) || ' ' || chr(10) || '125V' WHEN 2 THEN CASE WHEN qty % 3 = 0 THEN ' ' ELSE CAST(qty AS STRING) || ' mm' END ELSE CASE WHEN qty % 3 = 0 THEN NULL ELSE 'v' || CAST(qty AS STRING) END END AS text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM line""",
    "plate": """SELECT drawing_id, 1 AS rw, 0 AS cl, '1ST LINE' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 1 AS cl, '2ND LINE' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 2 AS cl, 'ITEM' AS value FROM drawing UNION ALL SELECT drawing_id, 1 AS rw, 3 AS cl, 'QTY' AS value FROM drawing
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 0 AS cl, CASE sk % 6 WHEN 0 THEN 'TB' || CAST(sk % 4 AS STRING) WHEN 1 THEN 'FU' || CAST(qty AS STRING) WHEN 2 THEN 'SW-' || CAST(qty AS STRING) WHEN 3 THEN 'NORTH BAY' WHEN 4 THEN '138kV LINE' ELSE 'CT-LONG NAME' END AS value FROM line
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 1 AS cl, CASE qty % 3 WHEN 0 THEN 'MAIN FUSE' WHEN 1 THEN 'JUNCTION BOX' ELSE 'OTHER' END AS value FROM line WHERE qty % 4 <> 0
  UNION ALL SELECT drawing_id, pos + 1 AS rw, 2 AS cl, CAST(pos AS STRING) AS value FROM line""",
    "event": """SELECT event_id, 'f' || CAST(user_id AS STRING) || CASE event_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.dxf' WHEN 2 THEN '.xlsx' ELSE '.tmp' END AS path, event_type AS event, ts FROM events""",
    #: events of few files, two thirds of a second apart and slightly out of order, some at one time
    "burst": """SELECT event_id, 'f' || CAST(user_id % 5 AS STRING) || '.pdf' AS path, (event_id + 100 - CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) * 150000 + CAST((event_id + 100 - CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) * 7919 % 1000 AS BIGINT) * 1000 AS us FROM events""",
}


#: The given tables that a registry is derived from.
GIVEN = ("orders", "lineitem", "events")
#: Written at their first use.
STORED = ("line", "component", "connection")
#: Sheets, whose cells of line items and of drawings lie together by drawing.
SHEETS = ("cell", "book")


def _needs(name: str, seen: list[str], known: tuple[str, ...] = ()) -> list[str]:
    for other in TABLES:
        if other != name and other not in seen and other not in known and re.search(rf"\b(?:FROM|JOIN) {other}\b", TABLES[name]):
            _needs(other, seen, known)
    if name not in seen:
        seen.append(name)
    return seen


def with_tables(*names: str, known: tuple[str, ...] = ()) -> str:
    """WITH and the common table expressions that the named ones need; ``known`` ones are there as views."""
    seen: list[str] = []
    for n in names:
        _needs(n, seen, known)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in seen)


class Registry:
    """The registry's tables, with nested columns, over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # joins by drawing and component need no exchange of tables in buckets by one of them
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.sources = [f"{sf_dir}/{t}.parquet" for t in GIVEN]
        self._made: dict[str, DataFrame] = {}

    def _derived(self, name: str) -> DataFrame:
        known = tuple(n for n in STORED if n != name) + (("drawing",) if name in SHEETS else ())
        used = _needs(name, [], known)
        read = {t: self.spark.read.parquet(path) for t, path in zip(GIVEN, self.sources, strict=True)}
        read |= {n: self.numbers if n == "drawing" else self.raw(n) for n in known if any(re.search(rf"\b(?:FROM|JOIN) {n}\b", TABLES[t]) for t in used)}
        if name in SHEETS:
            # marked columns are named by each part of a union, which Spark then knows to lie by them
            mark = F.col("drawing_id").alias("drawing_id", metadata={"buckets": self.buckets})
            read |= {n: df.withColumn("drawing_id", mark) for n, df in read.items() if n in known}
        # the tables are arguments of the statement, so no view of the caller's is replaced
        text = re.sub(r"\b(FROM|JOIN) (" + "|".join(read) + r")\b", r"\1 {\2}", f"{with_tables(name, known=known)}\nSELECT * FROM {name}")
        return self.spark.sql(text, **{n: df for n, df in read.items() if f"{{{n}}}" in text})

    def raw(self, name: str) -> DataFrame:
        if name not in self._made:
            make = {"line": self._line, "component": self._component, "connection": self._connection}.get(name)
            self._made[name] = self._derived(name) if make is None else self._by_drawing(make, name)
        return self._made[name]

    @cached_property
    def numbers(self) -> DataFrame:
        """Drawings with their numbers in the buckets of the line items, so that their cells need no exchange to meet."""
        return self._by_drawing(lambda: self.raw("drawing").select("k", "drawing_id").repartition(self.buckets, "drawing_id"), "numbers of drawings")

    @cached_property
    def buckets(self) -> int:
        """Of tables by drawing: few enough rows in each for a task to sort them in memory."""
        return buckets_for(sum(state_of(self.spark, path)[1] for path in self.sources), each=8 << 20)

    def _by_drawing(self, make, name: str) -> DataFrame:
        """A stored table in buckets by drawing, of rows that are dealt out so already."""
        return stored(make, self.spark, self.sources, name, by="drawing_id", dealt=self.buckets)

    def _line(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        items = self.spark.read.parquet(self.sources[GIVEN.index("lineitem")]).select("l_orderkey", *order)
        items = items.withColumn("drawing_id", F.expr(_INST)).repartition(self.buckets, "drawing_id")
        # the number first: drawings' names begin alike, so rows sorted by them are compared whole
        items = items.withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey", "drawing_id").orderBy(*order)))
        text = TABLES["line"].replace(f"{_POS} AS pos", "pos").replace(f"{_INST} AS drawing_id", "drawing_id")
        return self.spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=items)

    def _component(self) -> DataFrame:
        rows = self.raw("line").filter("drawing_id is not null and component_id is not null")
        return rows.groupBy("drawing_id", "component_id").agg(F.min_by("component_type", "pos").alias("component_type"))

    def _connection(self) -> DataFrame:
        rows = self.raw("line").filter("ok is not null")
        after = lambda name: F.lead(name).over(W.partitionBy("drawing_id", "ok").orderBy("pos"))
        rows = rows.select("drawing_id", "component_id", "ok", "pos", "qty", "sk", after("pos").alias("next_pos"), after("component_id").alias("next")).filter("next_pos is not null")
        select, _ = TABLES["connection"].split(" FROM line a JOIN line b ON ")
        return self.spark.sql(f"{select.replace('b.component_id', 'a.next')} FROM {{rows}} a", rows=rows)

    @cached_property
    def drawings(self) -> DataFrame:
        return stored(self._drawings, self.spark, self.sources, "drawings")

    def _drawings(self) -> DataFrame:
        refs = self.raw("reference").groupBy("drawing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda r: r["ref"]).alias("cross_references"))
        blocks = self.raw("terminal").select("drawing_id", F.create_map("block", F.transform(F.sequence(F.lit(1), F.col("terminals").cast("int")), lambda t: t.cast("string"))).alias("terminal_blocks"))
        specs = self.raw("schedule").select("drawing_id", F.array("spec").alias("cable_schedule"))
        out = self.raw("drawing").join(refs, "drawing_id", "left").join(blocks, "drawing_id", "left").join(specs, "drawing_id", "left")
        empty = F.array().cast("array<string>")
        return out.withColumns({"cross_references": F.coalesce("cross_references", empty), "cable_schedule": F.coalesce("cable_schedule", empty)})

    @cached_property
    def typed(self) -> DataFrame:
        """Components with the type of their drawing, which checks by component then need no join for."""
        return stored(self._components, self.spark, self.sources, "components", by="component_id")

    @cached_property
    def components(self) -> DataFrame:
        """Components in buckets by drawing, for what isn't grouped by component."""
        return self._by_drawing(lambda: self._components().drop("drawing_type"), "components of drawings")

    def _components(self) -> DataFrame:
        value = F.struct("pos", F.struct("parameter", "value", "unit", F.lit(None).cast("double").alias("numeric_value")).alias("v"))
        # a number first in the key, by which rows are sorted faster than by names that begin alike
        rows = self.raw("line").groupBy(F.xxhash64("drawing_id").alias("h"), "drawing_id", "component_id").agg(
            F.min_by("component_type", "pos").alias("component_type"),
            F.transform(F.sort_array(F.collect_list(value)), lambda x: x["v"]).alias("values"),
            F.max_by("device", F.when(F.col("device") != "", F.col("pos"))).alias("device"),
            F.array_sort(F.collect_set(F.when(F.col("signal") != "", F.col("signal")))).alias("signals"),
        )
        attributes = F.when(F.col("device").isNotNull(), F.create_map(F.lit("associated_device"), F.col("device"))).otherwise(F.create_map().cast("map<string,string>"))
        rows = rows.withColumn("attributes", attributes).drop("device", "h")
        # a bucket's drawings are few; its components, which are wide, needn't be sorted to meet them
        return rows.join(self.raw("drawing").select("drawing_id", "drawing_type").hint("shuffle_hash"), "drawing_id")

    @property
    def connections(self) -> DataFrame:
        return self.raw("connection")

    @property
    def labels(self) -> DataFrame:
        return self.raw("label")
