"""How often a text is searched, and row voltages of drawings with few and many ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import text as X
from gridweave.operators import bom, cables, classify


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_searched_once_for_each_kind_of_value(spark):
    df = spark.createDataFrame([("3kV 125V DC 2A 5%Z 500kVA 1200:5 7 ohm",), ("none",), (None,)], "text string")
    assert plan_of(df.select(X.electrical_values(F.col("text")).alias("v"))).count("regexp_extract_all(text") == 5
    assert plan_of(df.select(X.terminal_blocks(F.col("text")).alias("v"))).count("regexp_extract_all(text") == 2
    rows = df.select(X.electrical_values(F.col("text")).alias("v")).collect()
    assert [(v.parameter, v.value, v.unit) for v in rows[0].v] == [
        ("voltage_rating", "3kV", "kV"), ("voltage_rating", "125V DC", "V"), ("voltage_rating", "500kV", "kV"), ("current_rating", "2A", "A"),
        ("impedance", "5%Z", "%Z"), ("impedance", "7 ohm", "ohm"), ("power_rating", "500kVA", "kVA"), ("ratio", "1200:5", ""),
    ]
    assert rows[1].v == [] and rows[2].v is None


def test_row_voltages_of_few_and_many_ids(spark):
    ids = [("few", "A1", 2), ("few", "B1", 1), *(("many", f"C{k}", k) for k in range(100))]
    texts = [("few", "s", 1, "A1 B1 3kV"), ("few", "s", 2, "A1 4kV"), ("few", "s", 3, "Z 5kV"), ("many", "s", 1, "C70 C8 6kV"), ("many", "s", 2, "A1 7kV")]
    out = bom.row_voltages(spark.createDataFrame(texts, "drawing_id string, sheet string, row int, text string"), spark.createDataFrame(ids, "drawing_id string, component_id string, first_seen int"))
    assert sorted((r.drawing_id, r.row, r.value, r.component_id) for r in out.collect()) == [("few", 1, "3kV", "B1"), ("few", 2, "4kV", "A1"), ("many", 1, "6kV", "C7")]


def test_counts_of_cables_need_no_copies(spark):
    df = spark.createDataFrame([("d1", "x"), ("d1", ""), ("d2", "y"), (None, "x")], "drawing_id string, cable_spec string")
    assert "Expand" not in plan_of(cables.cable_summary(df))
    assert [tuple(r) for r in cables.cable_summary(df).collect()] == [(4, 2, 2)]
    assert [tuple(r) for r in cables.cable_summary(df.limit(0)).collect()] == [(0, 0, 0)]


def test_rows_of_one_sheet_are_dealt_out(spark):
    cells = [("f", "s 30%", 0, 1, k, v) for k, v in enumerate(("DWG NO", "TYPE", "REV A"))]
    cells += [("f", "s 30%", 0, row, k, v) for row in range(2, 40) for k, v in enumerate((f"EC-{row}", "Cable", "r1"))]
    df = classify.index_entries(spark.createDataFrame(cells, "file_name string, sheet string, sheet_pos int, row int, col int, value string"))
    assert f"sequence(0, {classify.SHEET_PARTS - 1}" in df._jdf.queryExecution().analyzed().toString()
    assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 76 and df.filter("current_revision = 'r1'").count() == 76


def test_only_patterns_of_a_text_s_words_are_tried(spark):
    """Hits are those of each pattern searched by itself; one search for all says which are tried."""
    from gridweave.functions import patterns as P

    words = ["52-L1.A", "X52-L2", "52A", "86MP", "86ABCD1", "SEL-451", "SEL-C662", "SEL-C200", "BECKWITH-M2001", "BECKWITH M-12", "GE L90", "XBREAKER 12", "DC PANEL 3B", "PANEL AB12", "SM68", "LA-3", "TB3", "TB3-4", "TB4-", "C200", "UPS", "UPS-1", "CT-A.1", "FU-AB", "FU12A", "IRIG-B", "é52-L9", "52-é", "5", "2", "", "-86LOR", "LOR", "DC\nPANEL", "AC  PANEL AC1"]
    rows = [(w,) for w in words] + [(f"{a} {b}/{a}{b}",) for k, a in enumerate(words) for b in words[k % 3 :: 3]] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    for source in "pds":
        own = [(k, p) for k, p in enumerate(P.CATALOGUE, 1) if source in p.sources]
        each = F.flatten(F.array(*[F.transform(X.all_of(F.col("text"), p.regex), X._hit(k, p)) for k, p in own]))
        both = df.select("text", F.array_sort(X.found_components(F.col("text"), source)).alias("got"), F.array_sort(each).alias("want")).collect()
        assert [(r.text, r.got) for r in both] == [(r.text, r.want if r.text is not None else []) for r in both]
    assert "RLIKE" not in plan_of(df.select(X.found_components(F.col("text"))))
    assert sum(not X.headed(p.regex) for p in P.CATALOGUE) == 5 and all(X.inner_part(p.regex) for p in P.CATALOGUE if not X.headed(p.regex))
    assert [X.inner_part(r) for r in (r"\b([PS]M68)\b", r"\b((?:AB)?CD?E+F{0,2}-\d)\b", r"\b(A|B)\b", r"(AB)?C", r"\b(C[12]00)\b")] == ["M68", "C", "", "", "00"]
