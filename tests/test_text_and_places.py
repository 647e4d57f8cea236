"""Golden rows of text, places, classification, CAD blocks, sheets, sources and streams."""

from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave.functions import patterns as P
from gridweave.functions import text as X
from gridweave.operators import bom, cad, classify, spatial
from gridweave.sources import decoded, files

c = F.col


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr(c("text")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("CASCADE", "text"), ("STRIP", "text"), ("TRIP", "signal"), ("138kV", "value"), ("2/C#10", "cable"), ("EC-301.1", "reference"), ("TB6-71", "terminal"), ("52-L1", "component"), ("Note 1", "note"), ("drawn by", "title"), ("sel-451", "component")])
def test_label_category(spark, text, want):
    assert one(spark, X.label_category, text) == want


def test_type_precedence(spark):
    units = spark.createDataFrame([("A", 2, "TC1 86MP EMS-RTAC DPAC1 and DPAC-1"), ("A", 1, "BREAKER 7 52-L1.A BECKWITH-M20 GE L90"), ("B", 1, None), ("B", 2, "nothing 12")], "drawing_id string, page int, text string")
    got = {r.component_id: r.component_type for r in X.extract_components(units).collect()}
    assert got == {"TC1": "52", "86MP": "86", "RTAC": "RTAC", "EMS-RTAC": "RTAC", "DPAC-1": "RELAY", "BREAKER-7": "52", "52-L1.A": "52", "BECKWITH-BECKWITH-M20": "RELAY", "GE-L90": "RELAY"}


def test_values_keep_false_positives(spark):
    got = [(v.parameter, v.value, v.numeric_value) for v in one(spark, X.electrical_values, "500kVA 125 V DC 10%Z 700/1200:1:1 5A")]
    assert ("voltage_rating", "500kV", 500.0) in got and ("power_rating", "500kVA", None) in got and ("voltage_rating", "125V DC", 0.125) in got
    assert ("impedance", "10%Z", 10.0) in got and ("ratio", "700/1200:1:1", None) in got and ("current_rating", "5A", 5.0) in got


def test_lists_of_a_text(spark):
    text = "2/C #10 cat5e 3PR #24SH TB1-2 TB1-1 TB1-2 TS3-4 EC-301.1 EC-100.0 138kV 125V DC\nNOTES:\nfirst line here\nx\n"
    assert one(spark, X.cable_specs, text) == ["2/C #10", "CAT5E", "3PR #24SH"]
    assert one(spark, X.terminal_blocks, text) == {"TB1": ["2", "1"], "TS-TS3": ["4"]}
    assert one(spark, lambda t: X.cross_references(t, F.lit("NRE-EC-100.0")), text) == ["EC-301.1"]
    assert one(spark, X.voltage_levels, text) == ["125V DC", "138kV"]
    assert one(spark, X.notes, text) == ["first line here"]
    assert one(spark, X.title_fields, "PROJECT: One\nDRAWN BY: AB\nDRAWN BY: CD").asDict() == {"project": "One", "drawn_by": "CD", "designed_by": ""}


def test_ids_and_types(spark):
    assert [one(spark, X.id_from_name, t) for t in ("X 52-L1 Y", "DFR2", "plain", "BECKWITH M-20")] == ["52-L1", "DFR-2", "", "M-20"]
    assert [one(spark, X.type_from_id, t) for t in ("52-L1", "TB1", "X52-L1", "SEL-C662", "RTAC")] == ["52", "TB", "UNKNOWN", "CABLE", "RTAC"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="5286-CTLUPSMGEN1 0.AB", min_size=0, max_size=24), min_size=5, max_size=20))
def test_patterns_agree_with_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    cols = [X.all_of(c("text"), p.regex).alias(f"p{i}") for i, p in enumerate(P.CATALOGUE)]
    for r in df.select("k", *cols).collect():
        for i, p in enumerate(P.CATALOGUE):
            assert list(r[f"p{i}"]) == re.findall(p.regex, texts[r.k], re.ASCII)


def labels(spark, rows):
    return spark.createDataFrame(rows, "drawing_id string, seq long, text string, x double, y double")


def test_nearest_takes_the_first_of_equals(spark):
    at = labels(spark, [("A", 1, "52-1", 0.0, 0.0), ("A", 2, "52-2", 10.0, 0.0), ("A", 3, "note", 100.0, 0.0)])
    values = labels(spark, [("A", 7, "5A", 5.0, 0.0), ("A", 8, "9A", 101.0, 0.0), ("A", 9, "5A", 1.0, 0.0)]).withColumnRenamed("text", "value")
    known = spark.createDataFrame([("A", "52-1"), ("A", "52-2")], "drawing_id string, component_id string")
    assert [tuple(r) for r in spatial.nearest_component(values, at, known).collect()] == [("A", "52-1", "5A", 7)]


@pytest.mark.parametrize(("dy", "dx", "want"), [(14.9, 0.0, 1), (15.0, 0.0, 0), (0.0, 299.0, 1), (0.0, 300.0, 0), (-14.9, -299.0, 1)])
def test_bounds_are_strict(spark, dy, dx, want):
    rows = labels(spark, [("A", 1, "a", 1000.0, 1000.0), ("A", 2, "b", 1000.0 + dx, 1000.0 + dy), ("B", 3, "c", 1000.0, 1000.0)])
    assert spatial.label_connections(rows).count() == want


def test_wires(spark):
    at = labels(spark, [("A", 1, "52-1", 0.0, 0.0), ("A", 2, "52-2", 50.0, 0.0), ("A", 3, "52-1", 1.0, 0.0)])
    ends = spark.createDataFrame([("A", "LWPOLYLINE", 5, [(4.0, 3.9), (45.1, 0.0), (55.0, 0.0)]), ("A", "LINE", 6, [(1.0, 1.0), (1.0, 2.0)]), ("A", "TEXT", 7, None)], "drawing_id string, etype string, seq long, points array<struct<x:double,y:double>>")
    seg = spatial.wire_segments(ends)
    assert seg.count() == 3
    got = [(r.seq, r.part, r.from_component, r.to_component) for r in spatial.wire_connections(seg, at).collect()]
    assert got == [(5, 0, "52-1", "52-2")]


def test_classification(spark):
    drawings = spark.createDataFrame([("NRE-EC-300.1", "ONE LINE", "", ""), ("EC-999.0", "dc elementary", "t", "B"), ("EC-210.0", " ", "t", "B"), ("X", None, "t", "B")], "drawing_id string, title_type string, title string, revision string")
    index = spark.createDataFrame([("EC-300.1", "Panel Layout", "from index", "C")], "drawing_number string, drawing_type string, drawing_title string, current_revision string")
    got = {r.drawing_id: r for r in classify.enrich(classify.classify(drawings, index)).collect()}
    assert {k: (r.drawing_type, r.confidence) for k, r in got.items()} == {"NRE-EC-300.1": ("PANEL_LAYOUT", 1.0), "EC-999.0": ("DC_SCHEMATIC", 0.9), "EC-210.0": ("AC_SCHEMATIC", 0.7), "X": ("UNKNOWN", 0.0)}
    first = got["NRE-EC-300.1"]
    assert (first.title, first.revision) == ("from index", "C") and {(a.type, a.strategy) for a in first.alternatives} == {("ONE_LINE", "title_block"), ("DC_SCHEMATIC", "number_series")}


def test_index_phases(spark):
    def sheet(name, pos, rows):
        return [("i.xlsx", name, pos, r, k, v) for r, row in enumerate(rows, 1) for k, v in enumerate(row) if v]

    head = ["DWG NO", "TYPE", "TITLE", "DATE", "REV 0", "REV 1"]
    cells = sheet("90% set", 0, [["a"], head, ["EC-1.0", "LAYOUT", "ninety", "d1", "A", "B"], ["EC-2.0", "", "no type"]]) + sheet("30% set", 1, [head, ["EC-1.0", "INDEX", "thirty", "d0", "A"], ["NRE-EC-3.0", "CABLE", "c"]])
    df = spark.createDataFrame(cells, "file_name string, sheet string, sheet_pos int, row int, col int, value string")
    got = {r.drawing_number: r for r in classify.index_entries(df).collect()}
    assert set(got) == {"EC-1.0", "NRE-EC-1.0", "NRE-EC-3.0", "EC-3.0"}
    one_ = got["NRE-EC-1.0"]
    assert (one_.drawing_type, one_.design_phase, one_.current_revision) == ("LAYOUT", "90%", "B") and [(h.revision, h.date) for h in one_.revision_history] == [("A", "d1"), ("B", "")]


ENTITIES = "drawing_id string, layout string, seq long, block_name string, attribs map<string,string>, x double, y double"


def test_blocks(spark):
    rows = [
        ("A", "m", 1, "TITLEBLOCK", {"DWGNO": "1", "DWGTYPE": "ONE LINE"}),
        ("A", "m", 2, "R", {"DEVICE": "SEL-451", "LOC": "P1", "MODEL": "x"}),
        ("A", "m", 3, "P", {"PWR_SUP": "125V", "TERM1": "9"}),
        ("A", "m", 4, "GROUND BAR", {}),
        ("A", "n", 5, "GND", {"Q": "1"}),
        ("A", "m", 6, "F", {"FUSE_NUM": "FU1", "LOC": "P2", "FUSE_SIZE": "5A"}),
        ("A", "m", 7, "F", {"FUSE_NUM": "FU1", "LOC": "P2", "LEFT_TERM": "7"}),
        ("A", "m", 8, "I", {"INPUT-#1": "IN101", "INPUT-#2": "IN 5", "TERM": "##", "TERM2": "4"}),
        ("A", "m", 9, "PNL_TERM", {"TAGSTRIP": "TBX", "TERM#": "3"}),
        ("A", "m", 10, "52-L9", {}),
        ("A", "m", 11, "ODD", {"Q": "1"}),
        ("A", "m", 12, "WD_M", {"DEVICE": "no"}),
        ("A", "m", 13, "O", {"OUTPUT": "OUT1", "POLARITY": "+"}),
    ]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], ENTITIES)
    got = {r.component_id: r for r in cad.block_components(df).collect()}
    assert {k: r.component_type for k, r in got.items()} == {"SEL-451": "RELAY", "PWR-SUPPLY-SEL-451": "BAT", "GND-SEL-451": "GND", "GND": "GND", "FU1": "FU", "IN101": "RELAY", "TBX-3": "TB", "52-L9": "52", "OUT1": "RELAY"}
    assert [(v.parameter, v.value) for v in got["FU1"]["values"]] == [("fuse_rating", "5A"), ("location", "P2")] and got["FU1"].attributes == {"LEFT_TERM": "7"}
    assert got["IN101"].attributes == {"TERM2": "4"} and got["SEL-451"].attributes == {"LOC": "P1", "MODEL": "x"} and got["OUT1"].attributes == {"POLARITY": "+"}
    assert [r.text for r in cad.block_notes(df).collect()] == ["ODD"]
    assert {r.field: r.value for r in cad.title_blocks(df).collect()} == {"drawing_number": "1", "drawing_type": "ONE LINE"}
    assert "no" not in {r.text for r in cad.attribute_labels(df).collect()}


def bom_cells(spark, sheets, name="x BOM.xlsx"):
    rows = [(name, "D", s, p, r, k, v) for p, (s, table) in enumerate(sheets) for r, row in enumerate(table, 1) for k, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "file_name string, drawing_id string, sheet string, sheet_pos int, row int, col int, value string")


def test_material_lines(spark):
    table = [["title"], ["ITEM#", "QTY", "CATALOG#", "MATERIAL"], ["1", "2", "C-1", "FUSE 30A"], ["2", "1", "C-1", "ENCLOSURE 125V DC"], ["3", "LOT", "", "WIRE 5%Z"], ["", "", "", ""]]
    got = {r.component_id: r for r in bom.line_items(bom_cells(spark, [("mat", table)])).collect()}
    assert {k: r.component_type for k, r in got.items()} == {"C-1": "FU", "C-1:2": "JB", "BOM-ITEM-3": "CONSUMABLE"}
    assert [(v.parameter, v.value) for v in got["C-1:2"]["values"]] == [("voltage_rating", "125V DC")]
    devices = [["ITEM#", "DEVICE#", "QTY"], ["1", "K1", "1"], ["2", "K1", "1"], ["3", "K1", "1"]]
    assert sorted(r.component_id for r in bom.line_items(bom_cells(spark, [("dev", devices)])).collect()) == ["K1", "K1-2", "K1:3"]
    assert bom.line_items(bom_cells(spark, [("dev", devices)], "other.xlsx")).count() == 0


def test_header_below_a_title(spark):
    table = [["Substation bill"], ["DWG NO", "DESCRIPTION"], ["E-1", "FUSE"]]
    assert [r.header_row for r in bom.header_rows(bom_cells(spark, [("s", table)])).collect()] == [2]


def test_nameplates(spark):
    table = [["ITEM", "1ST LINE", "2ND LINE", "SIZE"], ["1", "TB1", "", "S"], ["2", "NORTH X", "FUSE BOX", ""], ["3", "LONGNAME", "", ""], ["4", "CT-A", "", ""]]
    got = {r.component_id: r.component_type for r in bom.nameplates(bom_cells(spark, [("LT1 NAMEPLATE", table)])).collect()}
    assert got == {"LT1-TB1": "TB", "NORTH X": "FU", "LONGNAME": "BOM", "LT1-CT-A": "BOM"}


def test_row_values(spark):
    texts = spark.createDataFrame([("D", "s", 1, "SW-1 FU1 125V DC 480V")], "drawing_id string, sheet string, row int, text string")
    known = spark.createDataFrame([("D", "FU1", 2), ("D", "SW-1", 5)], "drawing_id string, component_id string, first_seen int")
    assert sorted((r.value, r.component_id) for r in bom.row_voltages(texts, known).collect()) == [("125V DC", "FU1"), ("480V", "FU1")]
    cells = bom_cells(spark, [("s", [["NAME", ""], ["FU1", "30A"]])])
    found = spark.createDataFrame([("D", "s", 2, "FU1")], "drawing_id string, sheet string, row int, component_id string")
    heads = cells.filter("row = 1").groupBy("drawing_id", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("header"))
    assert bom.row_attributes(cells, found, heads).first().attributes == {"col_1": "30A"}


def test_decoded_tables(spark):
    entities = spark.createDataFrame([("A", 1, "MTEXT", "*U1", "t", "a\n\n52-L1", 1.0, 2.0), ("A", 2, "TEXT", "b", "t", " ", 0.0, 0.0), ("A", 3, "DIMENSION", "b", "t", "12", 5.0, 5.0), ("A", 4, "ATTDEF", "B", "TAG", "x", 0.0, 0.0), ("A", 5, "ATTDEF", "*B", "TAG", "x", 0.0, 0.0)], "drawing_id string, seq long, etype string, block_name string, tag string, text string, x double, y double")
    assert [(r.text, r.category) for r in decoded.entity_labels(entities).orderBy("line").collect()] == [("a", "text"), ("52-L1", "component")]
    assert [(r.text, r.x) for r in decoded.dimension_labels(entities).collect()] == [("12", 0.0)]
    assert [r.note for r in decoded.attribute_notes(entities).collect()] == ["Block B: TAG = x"]
    words = spark.createDataFrame([("A", 1, 1, " 52-1 ", 0.0, 0.0), ("A", 1, 2, " ", 0.0, 0.0), ("A", 1, 3, None, 0.0, 0.0)], "drawing_id string, page int, seq long, text string, x double, y double")
    assert [(r.text, r.category) for r in decoded.word_labels(words).collect()] == [("52-1", "component")]


def test_rules_round_trip(spark, tmp_path):
    from gridweave.operators.authority import default_rules

    decoded.write_rules(default_rules(spark), f"{tmp_path}/rules")
    back = spark.read.json(f"{tmp_path}/rules")
    assert back.count() == 8
    (tmp_path / "own.json").write_text('[{"parameter": "ratio", "authority_order": ["LEGEND"]}, {"parameter": "x", "component_types": ["CT"], "authority_order": []}]')
    assert [(r.rule_pos, r.component_types) for r in decoded.read_rules(spark, f"{tmp_path}/own.json").collect()] == [(0, ["*"]), (1, ["CT"])]


def test_manifest_and_delta(spark, tmp_path):
    for name in ("a.pdf", "sub/b.DXF", "a.xlsx", ".c.pdf", "~d.pdf", "e.txt", "backup/f.pdf"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(name)
    rows = files.file_manifest(spark, str(tmp_path))
    got = {(r.drawing_id, r.path.rsplit("/", 1)[1]): r.duplicate_id for r in rows.collect()}
    assert got == {("a", "a.pdf"): True, ("a", "a.xlsx"): False, ("b", "b.DXF"): False}
    own = rows.filter("not duplicate_id")
    known = own.filter("drawing_id = 'a'").select("drawing_id", c("sha256").alias("file_hash"))
    assert {r.drawing_id: r.status for r in files.hash_delta(own, known).collect()} == {"a": "skipped", "b": "new"}
    assert {r.status: r.n for r in files.scan_results(files.hash_delta(own, known, force=True)).collect()} == {"updated": 1, "new": 1}


def test_components_in_tables(spark):
    from gridweave.functions.text import in_table

    parts = spark.createDataFrame([("A", "52-L1"), ("A", "FU7"), ("B", "52-L1")], "drawing_id string, component_id string")
    rows = spark.createDataFrame([("A", 1, 0, 0, "QTY 2 52-L1"), ("A", 1, 0, 1, "CT-9 spare"), ("B", 1, 0, 0, None)], "drawing_id string, page int, table_no int, row_no int, row_text string")
    assert {(r.drawing_id, r.component_id): r.in_table for r in in_table(parts, rows).collect()} == {("A", "52-L1"): True, ("A", "FU7"): False, ("B", "52-L1"): False}
    assert not any(r.in_table for r in in_table(parts, rows.limit(0)).collect())


def test_plain_parts_are_in_every_hit():
    import re

    from gridweave.functions import patterns as P
    from gridweave.functions.text import literal_part

    seen = "52-A 50-L1 51-A 86MP 87-B SEL-451 GE L90 GE-D60 ABB-X BECKWITH M-2001 TESLA-3 CT-A.1 FU12A DC PANEL A1 PANEL 3 BREAKER 12 DPAC1 SEL-C662 OUT101 IN101 CIRCUIT 9 DFR2 52A PS12 AC PANEL AC1 PM68 C100 TB1 TS2 CISCO IE-4010 POWER STRIP EMS-RTAC BATTERY BANK #1 UPS-1 MCC SA-3 GEN-1"
    for p in P.CATALOGUE:
        for m in re.finditer(p.regex, seen, re.ASCII):
            assert literal_part(p.regex) in m[0], p.regex


def test_nearest_by_rings_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    at = [(d, k, f"c{k}", float(rng.randrange(n)), float(rng.randrange(n))) for d, n in (("A", 60), ("B", 3000)) for k in range(30)]
    vals = [(d, 100 + k, f"v{k}", float(rng.randrange(n)), float(rng.randrange(n))) for d, n in (("A", 60), ("B", 3000), ("C", 9)) for k in range(40)]
    got = spatial.nearest_component(spark.createDataFrame(vals, "drawing_id string, seq long, value string, x double, y double"), spark.createDataFrame(at, "drawing_id string, seq long, text string, x double, y double"), spark.createDataFrame([(d, i) for d, _, i, *_ in at], "drawing_id string, component_id string"))
    want = set()
    for d, k, v, x, y in vals:
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, s, t) for e, s, t, a, b in at if e == d]
        want |= {(d, min(near)[2], v, k)} if near else set()
    assert {tuple(r) for r in got.collect()} == want and len(want) == 80


def test_nearest_label_in_dense_drawings(spark):
    """A pyramid of cells against all pairs: clusters, labels at one place, ties, values far outside."""
    rng = random.Random(3)
    place = lambda: (rng.gauss(0, 1), rng.gauss(0, 1)) if rng.random() < 0.6 else (rng.randrange(-5, 6) * 100.0, rng.randrange(4) * 50.0)
    labels = [(d, k, f"C{k % 97}", *place()) for d, n in (("A", 400), ("B", 90), ("C", 5), ("D", 70)) for k in range(n)]
    labels += [("E", k, f"C{k}", 7.0, 7.0) for k in range(80)]
    values = [(d, k, f"{k}kV", *(place() if k % 5 else (1e6, -3e5))) for d in "ABCDEF" for k in range(60)]
    parts = [(d, f"C{k}") for d in "ABCDE" for k in range(97) if k % 3]
    got = spatial.nearest_component(spark.createDataFrame(values, "drawing_id string, seq long, value string, x double, y double"), spark.createDataFrame(labels, "drawing_id string, seq long, text string, x double, y double"), spark.createDataFrame(parts, "drawing_id string, component_id string"))
    want = {}
    for d, seq, value, x, y in values:
        near = min(((math.sqrt((x - lx) ** 2 + (y - ly) ** 2), s, t) for e, s, t, lx, ly in labels if e == d), default=None)
        if near and (d, near[2]) in parts:
            want[d, near[2], value] = min(seq, want.get((d, near[2], value), seq))
    assert {(r.drawing_id, r.component_id, r.value): r.seq for r in got.collect()} == want


def test_row_voltages_by_parts_of_rows(spark):
    rows = [("A", "s", 1, "FU1 AT 125V DC"), ("A", "s", 2, "XFU12 34.5kV AND 13.8kV"), ("A", "s", 3, "nothing 5kV"), ("A", "s", 4, "FU1"), ("B", "s", 1, "FU1 5kV"), ("C", "s", 1, None)]
    parts = [("A", "FU12", 2), ("A", "FU1", 1), ("A", "U", 3), ("B", "52-L1 LONGER THAN THE ROW", 0), ("B", "", 1)]
    got = bom.row_voltages(spark.createDataFrame(rows, "drawing_id string, sheet string, row int, text string"), spark.createDataFrame(parts, "drawing_id string, component_id string, first_seen int"))
    assert sorted((r.row, r.pos, r.component_id) for r in got.collect()) == [(1, 0, "FU1"), (2, 0, "FU1"), (2, 1, "FU1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "contains(" not in plan
