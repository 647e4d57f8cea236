"""Golden rows: conflicts, references, protection logic, authority, plans, changes, cables."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridweave.operators import audit, authority, cables, changes, checks, propagation, registry, reports
from gridweave.sources.registry import Table, append, store_mismatches, upsert_decisions

VALUES = "array<struct<parameter:string,value:string,unit:string,numeric_value:double>>"
COMPONENTS = f"component_id string, drawing_id string, component_type string, values {VALUES}, attributes map<string,string>, signals array<string>"
DRAWINGS = "drawing_id string, drawing_type string, title string, revision string, cross_references array<string>, terminal_blocks map<string,array<string>>, cable_schedule array<string>, file_hash string"
CONNECTIONS = "drawing_id string, from_component string, to_component string, cable_spec string, wire_label string, signal_type string, seq long"


def value(p, v):
    return (p, v, "", None)


def comp(cid, did, kind="52", values=(), attributes=None, signals=()):
    return (cid, did, kind, list(values), attributes or {}, list(signals))


def draw(did, kind="", refs=(), blocks=None, schedule=()):
    return (did, kind, "t", "A", list(refs), {k: [str(i) for i in range(n)] for k, n in (blocks or {}).items()}, list(schedule), "h")


def conn(did, a, b, spec="", seq=0, label="", signal=""):
    return (did, a, b, spec, label, signal, seq)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rules(spark):
    return authority.default_rules(spark)


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


@pytest.fixture(scope="module")
def lockout_case(make):
    rows = [comp("86MS", d, "86", [value("voltage_rating", v)]) for d, v in (("NRE-EC-301.1", "34.5kV"), ("NRE-EC-307.0", "138kV"), ("NRE-EC-308.1", "125V DC"))]
    return make(rows, COMPONENTS), make([draw(r[1], "DC_SCHEMATIC") for r in rows], DRAWINGS)


def test_value_conflict(lockout_case, rules):
    components, drawings = lockout_case
    one = checks.value_mismatch(components, drawings, rules).first()
    two = checks.voltage_mismatch(components, drawings, rules).first()
    assert one.mismatch_id == sha("86MS", "voltage_rating", "value_mismatch") and two.mismatch_id == sha("86MS", "voltage", "voltage_mismatch")
    assert one.severity == two.severity == "CRITICAL" and one.values_found["NRE-EC-307.0"] == "138kV"
    assert [(o.drawing_id, o.is_authoritative) for o in one.resolution_options] == [("NRE-EC-301.1", True), ("NRE-EC-307.0", False), ("NRE-EC-308.1", False)]


def test_duplicate_parameters(make, rules):
    rows = [comp("52-1", "A", values=[value("current_rating", "1A"), value("current_rating", "2A")]), comp("52-1", "B", values=[value("current_rating", "2A")])]
    df, drawings = make(rows, COMPONENTS), make([draw("A", "ONE_LINE"), draw("B")], DRAWINGS)
    assert checks.value_mismatch(df, drawings, rules).count() == 0
    action = propagation.plan(df, drawings, rules).first()
    assert (action.source_drawing_id, action.target_drawing_id, action.old_value, action.new_value) == ("A", "B", "2A", "1A")
    assert action.action_id == sha("A", "B", "52-1", "current_rating")


def test_apply_and_converge(lockout_case, rules):
    components, drawings = lockout_case
    actions = propagation.plan(components, drawings, rules)
    after, marked, log, decided = propagation.apply_actions(components, actions)
    assert {r.status for r in marked.collect()} == {"APPLIED"} and log.count() == decided.count() == 2
    assert checks.value_mismatch(after, drawings, rules).count() == 0
    same, dry, none, _ = propagation.apply_actions(components, actions, dry_run=True)
    assert {r.status for r in dry.collect()} == {"DRY_RUN"} and none.count() == 0 and same is components
    manual = propagation.plan(components, drawings, rules, "86MS", "NRE-EC-308.1").collect()
    assert {r.new_value for r in manual} == {"125V DC"} and all(r.authority_basis.startswith("Manual override") for r in manual)
    ghost = actions.withColumn("parameter", F.lit("none"))
    assert {r.status for r in propagation.apply_actions(components, ghost)[1].collect()} == {"FAILED"}


def test_rules_by_type(make, rules, spark):
    keys = spark.createDataFrame([("ratio", "CT"), ("ratio", "52"), ("impedance", "52")], "parameter string, component_type string")
    got = {(r.parameter, r.component_type): r.authority_order for r in authority.rules_for(keys, rules).collect()}
    assert got == {("ratio", "CT"): ["ONE_LINE", "AC_SCHEMATIC"], ("impedance", "52"): ["ONE_LINE"]}
    rows = spark.createDataFrame([("impedance", "52", "ONE_LINE"), ("impedance", "52", "LEGEND"), ("ratio", "52", "ONE_LINE")], "parameter string, component_type string, drawing_type string")
    said = {(r.parameter, r.drawing_type): r.basis for r in authority.authority_basis(rows, rules).collect()}
    assert said["impedance", "ONE_LINE"].endswith("(priority 1 of 1)") and "not in the authority chain" in said["impedance", "LEGEND"] and said["ratio", "ONE_LINE"].startswith("No authority rule")


def test_references_and_terminals(make):
    drawings = make([draw("NRE-EC-1.0", refs=["EC-2.0", "EC-999.0", "NRE-EC-999.0"], blocks={"TB1": 2, "TB2": 2}), draw("NRE-EC-2.0", blocks={"TB1": 4, "TB2": 5})], DRAWINGS)
    assert sorted(r.mismatch_id for r in checks.broken_ref(drawings).collect()) == sorted([sha("NRE-EC-1.0", "EC-999.0", "broken_ref"), sha("NRE-EC-1.0", "NRE-EC-999.0", "broken_ref")])
    assert [r.component_id for r in checks.tb_conflict(drawings).collect()] == ["TB2"]
    graph = {r.drawing_id: r for r in reports.dependency_graph(drawings, make([comp("a", "NRE-EC-1.0"), comp("a", "NRE-EC-2.0"), comp("b", "NRE-EC-2.0")], COMPONENTS)).collect()}
    assert (graph["NRE-EC-1.0"].n_references, graph["NRE-EC-2.0"].n_referenced_by, graph["NRE-EC-2.0"].n_shared) == (3, 1, 1)


def test_orphans(make):
    drawings = make([draw("NRE-A"), draw("NRE-B", refs=["A"]), draw("NRE-C", refs=["A"])], DRAWINGS)
    row = checks.orphan(make([comp("x", "NRE-A"), comp("y", "NRE-B")], COMPONENTS), drawings).collect()
    assert [(r.component_id, r.drawings_involved) for r in row] == [("x", ["NRE-A", "NRE-B", "NRE-C"])]


@pytest.mark.parametrize(("edges", "missing"), [([], True), ([("50-L1", "52-L1")], False), ([("52-L1", "50-L1")], False), ([("50-L1", "86MP"), ("86MP", "52-L1")], False), ([("50-L1", "86MP")], True), ([("50-L1 RELAY", "52-L1")], False), ([("86X", "50-L1 RELAY")], False)])
def test_trip_path(make, edges, missing):
    rows = [comp("50-L1", "A", "50"), comp("52-L1", "A", "52"), comp("86MP", "A", "86"), comp("50-L1.X", "A", "50"), comp("51-Q", "A", "51")]
    got = checks.trip_path(make(rows, COMPONENTS), make([conn("A", a, b) for a, b in edges], CONNECTIONS)).collect()
    assert [r.mismatch_id for r in got] == ([sha("50-L1", "52-L1", "trip_path")] if missing else [])


def test_greatest_breaker_of_a_suffix(make):
    rows = [comp("50-1", "A", "50"), comp("52-1", "A", "52"), comp("BREAKER-1", "A", "52")]
    assert checks.trip_path(make(rows, COMPONENTS), make([], CONNECTIONS)).first().mismatch_id == sha("50-1", "BREAKER-1", "trip_path")


def test_lockouts(make):
    rows = make([comp(f"86{k}", "A", "86") for k in "ABCD"], COMPONENTS)
    edges = make([conn("A", "x", "86B"), conn("A", "86C", "x"), conn("A", "x", "86D"), conn("A", "86D", "x")], CONNECTIONS)
    got = {r.component_id: r for r in checks.lockout(rows, edges).collect()}
    assert {k: r.mismatch_id for k, r in got.items()} == {"86A": sha("86A", "lockout_completeness"), "86B": sha("86B", "lockout_no_output"), "86C": sha("86C", "lockout_no_input")}
    assert got["86B"].values_found == {"86B": "no output connections", "inputs": "1"}


def test_current_transformers(make):
    rows = make([comp("CT-1", "A", "CT"), comp("CT-2", "A", "CT"), comp("50-1", "A", "50")], COMPONENTS)
    edges = make([conn("A", "50-1", "CT-1"), *[conn("A", "CT-2", f"x{i}", seq=i) for i in range(7)]], CONNECTIONS)
    row = checks.ct_relay(rows, edges).first()
    assert row.component_id == "CT-2" and row.values_found["CT-2"] == "connections: x0, x1, x2, x3, x4"


@pytest.mark.parametrize(
    ("extra", "edges", "missing"),
    [
        ([], [], True),
        ([], [("DC1", "52-L1")], False),
        ([], [("52-L1", "dc1")], False),
        ([], [("DC1", "52-L10")], False),
        ([], [("DC1", "BREAKER 52-L1")], False),
        ([comp("52-L1.PWR", "A", "TB")], [], False),
        ([comp("52-L1", "B", "52", signals=["DC IN"])], [], False),
        ([], [("52-L1.X.PWR", "q")], False),
        ([], [("PWR-52-L1", "q")], True),
        ([], [("DC1", "52-L")], True),
    ],
)
def test_dc_supply(make, extra, edges, missing):
    got = checks.dc_supply(make([comp("52-L1", "A", "52"), *extra], COMPONENTS), make([conn("A", a, b) for a, b in edges], CONNECTIONS)).collect()
    assert [r.mismatch_id for r in got] == ([sha("52-L1", "dc_supply")] if missing else [])


def test_cables(make):
    edges = make([conn("A", "b", "a", "2/C#10", 1), conn("A", "a", "b", "3/C#10", 2), conn("B", "a", "b", "2/C#10", 1), conn("B", "a", "c", "", 2, "W1")], CONNECTIONS)
    row = checks.cable_mismatch(edges).first()
    assert row.mismatch_id == sha("a-b", "cable", "cable_mismatch") and row.values_found == {"A": "3/C#10", "B": "2/C#10"}
    components = make([comp("a", "B", signals=["TRIP", "X"])], COMPONENTS)
    got = {(r.drawing_id, r.seq): r for r in cables.cable_list(edges, components).collect()}
    assert got["B", 2].cable_number == "W1" and got["B", 2].signal == "TRIP, X" and got["A", 1].cable_number == "b-a" and got["A", 1].signal == ""
    schedule = {r.spec: r.n for r in cables.cable_schedule(edges, make([draw("A", schedule=["9/C#2"])], DRAWINGS)).collect()}
    assert schedule == {"2/C#10": 2, "3/C#10": 1, "(unspecified)": 1, "9/C#2": 0}


def test_changes(make):
    v = [value("p", "1"), value("q", "2")]
    old = make([comp("same", "A", values=v), comp("gone", "A"), comp("new value", "A", values=v), comp("other", "B")], COMPONENTS)
    new = make([comp("same", "A", values=v[::-1]), comp("added", "A"), comp("new value", "A", values=v[:1]), comp("first", "C")], COMPONENTS)
    got = {r.component_id: r.change_type for r in changes.detect_changes(old, new).collect()}
    assert got == {"gone": "COMPONENT_REMOVED", "added": "COMPONENT_ADDED", "new value": "VALUE_CHANGED"}
    assert sorted(r.component_id for r in changes.replaced(old, new).collect()) == ["added", "first", "new value", "other", "same"]


def test_stored_tables(spark, make, lockout_case, rules, tmp_path):
    components, drawings = lockout_case
    table = Table(spark, f"file://{tmp_path}/components", COMPONENTS)
    assert not table.exists() and table.read().count() == 0
    table.replace(components)
    table.replace(make([comp("n", "NRE-EC-301.1")], COMPONENTS))
    assert sorted(r.component_id for r in table.read().collect()) == ["86MS", "86MS", "n"]
    stored = Table(spark, f"file://{tmp_path}/mismatches", key="mismatch_id")
    store_mismatches(stored, checks.value_mismatch(components, drawings, rules))
    store_mismatches(stored, checks.voltage_mismatch(components, drawings, rules))
    assert {r.mismatch_id: r.resolved for r in stored.read().collect()} == {sha("86MS", "voltage_rating", "value_mismatch"): True, sha("86MS", "voltage", "voltage_mismatch"): False}
    assert registry.mismatch_summary(stored.read()).first() == Row(total=1, critical=1, warning=0, info=0)
    log = f"file://{tmp_path}/log"
    append(components.select("component_id"), log)
    append(components.select("component_id"), log)
    assert spark.read.parquet(log).count() == 6
    decisions = Table(spark, f"file://{tmp_path}/decisions", key="decision_id")
    upsert_decisions(decisions, spark.createDataFrame([("d", 1, "a"), ("e", 1, "x")], "decision_id string, timestamp long, outcome string"))
    upsert_decisions(decisions, spark.createDataFrame([("d", 2, "b")], "decision_id string, timestamp long, outcome string"))
    assert sorted((r.decision_id, r.outcome) for r in decisions.read().collect()) == [("d", "b"), ("e", "x")]


def test_all_checks_have_unique_ids(make, rules):
    rows = [comp("50-L1", "A", "50", [value("ratio", "1")]), comp("50-L1", "B", "51", [value("ratio", "2")]), comp("52-L1", "A")]
    got = checks.all_checks(make([draw("A"), draw("B")], DRAWINGS), make(rows, COMPONENTS), make([], CONNECTIONS), rules).collect()
    ids = [r.mismatch_id for r in got]
    assert len(ids) == len(set(ids)) and {r.check_no for r in got} == {1, 2, 9, 12}


def test_all_checks_with_names_that_make_one_id(make, rules):
    """Of two keys with one id the greater stays, once; cables of pairs and values of parameters alike."""
    rows = [comp(i, d, "50", [value(p, d)]) for i, p in (("a|b", "c"), ("a", "b|c"), ("a", "d")) for d in "AB"]
    ends = [conn(d, a, b, spec=f"{d}C") for a, b in (("x", "y-z"), ("x-y", "z"), ("x", "y")) for d in "AB"]
    got = checks.all_checks(make([draw("A"), draw("B")], DRAWINGS), make(rows, COMPONENTS), make(ends, CONNECTIONS), rules).filter("check_no in (1, 4)").collect()
    assert sorted((r.check_no, r.component_id, r.parameter) for r in got) == [(1, "a", "d"), (1, "a|b", "c"), (4, "x <-> y", "cable_specification"), (4, "x-y <-> z", "cable_specification")]


def test_gathered_rows_of_all_checks_are_not_exchanged(make, rules):
    """What a check says of a component comes from the written rows alone, with edges in buckets as without."""
    rows = [comp("50-L1", d, t, [value("voltage_rating", d)]) for d, t in (("A", "50"), ("B", "51"))] + [comp("86M", "A", "86"), comp("52-L1", "A"), comp("CT-1", "A", "CT")]
    tables = make([draw("A"), draw("B")], DRAWINGS), make(rows, COMPONENTS), make([conn("A", "50-L1", "CT-1"), conn("A", "86M", "x")], CONNECTIONS), rules
    plain, dealt = checks.all_checks(*tables), checks.all_checks(*tables, buckets=3)
    assert sorted(plain.collect()) == sorted(dealt.collect()) and {r.check_no for r in dealt.collect()} == {1, 2, 6, 9, 10, 12}
    part = dealt.filter("check_no in (1, 2, 6, 7, 10, 11, 12)")
    assert "max_by" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_transformers_of_repeated_connections_need_no_distinct_edges(make):
    rows = [comp("CT-1", "A", "CT"), comp("CT-2", "A", "CT"), comp("CT-3", "A", "CT"), comp("50-1", "A", "50")]
    ends = make([conn("A", "CT-1", "50-1"), conn("A", "CT-1", "50-1", seq=1), conn("A", "50-1", "CT-2", seq=2), conn("A", "x", "CT-3", seq=3)], CONNECTIONS)
    got = checks.ct_relay(make(rows, COMPONENTS), ends)
    assert [r.component_id for r in got.collect()] == ["CT-3"]
    distinct = re.compile(r"Aggregate \[a#\d+, b#\d+\], \[a#\d+, b#\d+\]")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert distinct.search(plan(checks.undirected(ends))) and not distinct.search(plan(got))


def test_registry_lists(spark, make):
    names = spark.createDataFrame([("50_A%x PWR 1",), ("50XA%x PWR",), ("50_a%X",)], "n string")
    assert [r.n for r in names.filter(registry.name_like(F.col("n"), "50_A%x", "pwr")).collect()] == ["50_A%x PWR 1"]
    assert spark.range(1).select(registry.truncated(F.array(*[F.lit(x) for x in "abc"]), 2).alias("t")).first().t == "a, b +1 more"
    df = make([comp("a", "A"), comp("a", "B"), comp("b", "A")], COMPONENTS)
    assert [tuple(r) for r in registry.shared_components(df).collect()] == [("a", 2, ["A", "B"])]
    assert registry.optional_filters(df, component_id="a", drawing_id=None).count() == 2
    assert reports.component_status(df, checks.last_values(df), "a").first().is_consistent


def test_decision_trees(spark, make):
    log = spark.createDataFrame([("1", "PROPAGATION", "a", "A", "o", 1.0, 1), ("2", "CLASSIFICATION", "", "A", "t", 0.5, 2), ("3", "AUTHORITY", "b", "A", "o", 1.0, 3)], "decision_id string, decision_type string, component_id string, drawing_id string, outcome string, confidence double, timestamp long")
    got = {(r.section, r.decision_id) for r in audit.decision_tree(log, make([comp("a", "A")], COMPONENTS), "a").collect()}
    assert got == {("propagation_actions", "1"), ("classifications", "2")}
    assert {r.decision_type: r.total for r in audit.statistics(log).collect()} == {None: 3, "PROPAGATION": 1, "CLASSIFICATION": 1, "AUTHORITY": 1}


def test_impact_counts_make_no_pairs(spark, make):
    rows = [comp("52-1", f"D{k}", values=[value("ratio", str(k % 3)), value("power_rating", "1")]) for k in range(30)] + [comp("52-2", "D0", values=[value("ratio", None), value("ratio", "1")]), comp("52-2", "D1", values=[value("ratio", None)])]
    df = make(rows, COMPONENTS)
    got = propagation.impact_counts(df)
    want = propagation.impact(df).groupBy("component_id", "parameter", "source_drawing_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(("52-1", "ratio", f"D{k}", 20) for k in range(30))


def test_checks_by_component_need_no_exchange(spark, make, rules):
    """On a bucketed table that says its drawings' types, checks 1, 2, 6 and 7 read buckets and move no rows."""
    from gridweave.sources.store import bucketed

    rows = [comp(f"50-L{k % 5}", f"D{k}", "RELAY" if k % 2 else "50", [value("ratio", str(k % 3)), value("voltage_rating", str(k % 2))]) for k in range(40)]
    parts = make(rows, COMPONENTS).withColumn("drawing_type", F.lit("ONE_LINE"))
    drawings = make([draw(f"D{k}") for k in range(40)], DRAWINGS)
    kept = bucketed(parts, "component_id", 4)
    for f in (lambda df: checks.value_mismatch(df, drawings, rules), checks.type_mismatch, lambda df: checks.voltage_mismatch(df, drawings, rules), checks.relay_mismatch):
        df = f(kept)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(?<!Broadcast)(?<!Reused)Exchange (?!SinglePartition)", plan), plan
        assert sorted(r.mismatch_id for r in df.collect()) == sorted(r.mismatch_id for r in f(parts).collect())


def test_emptied_drawings_and_partitions(spark, make, tmp_path):
    """A key that was scanned and has no rows any more loses its old ones, also where its partition becomes empty."""
    table = Table(spark, f"file://{tmp_path}/t", "drawing_id string, component_id string", buckets=3)
    rows = spark.createDataFrame([(f"D{k}", f"c{k}") for k in range(30)], "drawing_id string, component_id string")
    table.replace(rows)
    table.replace(rows.limit(0), rows.filter("drawing_id <> 'D7'"))
    assert [tuple(r) for r in table.read().collect()] == [("D7", "c7")] and table.of(rows).count() == 1
    old, new = make([comp("a", "A"), comp("b", "B")], COMPONENTS), make([], COMPONENTS)
    got = changes.detect_changes(old, new, spark.createDataFrame([("A",), ("C",)], "drawing_id string"))
    assert [(r.drawing_id, r.component_id, r.change_type) for r in got.collect()] == [("A", "a", "COMPONENT_REMOVED")]


def test_running_sums_of_a_key_in_many_ranges(spark):
    from gridweave.operators.order import placed, running

    rows = [(None if k % 7 == 0 else "hot", k % 50, k) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, n int").repartition(5)
    got = running(df, ["k"], ["t", "n"], {"s": F.col("n"), "place": F.lit(1)}).collect()
    for key in (None, "hot"):
        own = sorted((r.t, r.n, r.s, r.place) for r in got if r.k == key)
        assert [x[3] for x in own] == list(range(len(own))) and [x[2] for x in own] == [sum(y[1] for y in own[:i]) for i in range(len(own))]
    assert placed(df.limit(0), ["k"], ["t"]).count() == 0


def test_tables_are_made_anew_when_their_source_changes(spark, tmp_path):
    from gridweave.sources.store import stored

    path = f"file://{tmp_path}/in"
    make_ = lambda: spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    first = stored(make_, spark, [path], "x")
    assert first.count() == 3 and stored(make_, spark, [path], "x").inputFiles() == first.inputFiles()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert stored(make_, spark, [path], "x").count() == 5


def test_rows_are_exchanged_once_to_be_told_apart(spark):
    """Cables are exchanged once by their pair; ids of names without a bar are compared with nothing; names with one still are."""
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ends = spark.createDataFrame([("A", "x", "y-z", "s1", 0), ("B", "x", "y-z", "s2", 0), ("A", "x-y", "z", "s1", 1), ("B", "z", "x-y", "s3", 1), ("A", "p", "q", "s", 2)], "drawing_id string, from_component string, to_component string, cable_spec string, seq int")
    found = checks.cable_mismatch(ends, once=True)
    assert "Join" not in text(found) and {r.component_id for r in found.collect()} == {"x-y <-> z"}
    assert {r.component_id for r in checks.cable_mismatch(ends).collect()} == {"x <-> y-z", "x-y <-> z"}
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "c"), (None, "c"), ("", "c")], "component_id string, other string")
    rows = rows.withColumns({"mismatch_id": checks.stable_id(F.col("component_id"), F.col("other"), "trip_path"), "parameter": F.lit("trip_path")})
    once = checks._once(rows, F.col("component_id"), F.col("other"))
    assert sorted((r.component_id, r.other) for r in once.collect()) == [("", "c"), ("a", "c"), ("a|b", "c")]
    assert once.select("mismatch_id").distinct().count() == 3
