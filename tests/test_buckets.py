"""Tables in buckets: how often rows are exchanged."""

from __future__ import annotations

from gridweave.operators import propagation
from gridweave.operators.authority import default_rules
from gridweave.plans.corpus import Registry, with_tables
from gridweave.plans.queries import _rescanned, y6_log
from gridweave.sources.registry import Table

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_exchanged_once_and_as_numbers(spark):
    made = Registry(spark, SF)._line()
    assert plan_of(made).count("Exchange") == 1
    assert made.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_tables_of_drawings_need_no_exchange(spark):
    r = Registry(spark, SF)
    assert "Exchange" not in plan_of(r._component()) and "Exchange" not in plan_of(r._connection())
    assert "Exchange" not in plan_of(r.components.groupBy("drawing_id", "component_id").count())
    both = r.components.join(r.raw("line"), ["drawing_id", "component_id"]).hint("merge")
    assert "Exchange hash" not in plan_of(both)


def test_plan_joins_no_drawings_where_types_are_known(spark):
    r = Registry(spark, SF)
    assert r.drawings.count() > 0
    text = plan_of(propagation.plan(r.typed, r.drawings, default_rules(spark)))
    assert "cross_references" not in text and "Exchange hashpartitioning(drawing_id" not in text


def test_change_log_stores_no_drawings_and_sorts_values_once_a_parameter(spark, monkeypatch):
    r, made = Registry(spark, SF), []
    monkeypatch.setattr(Registry, "_drawings", lambda self: made.append("drawings"))
    monkeypatch.setattr("gridweave.plans.corpus.stored", lambda make, *_, **__: make())
    y6_log(r)
    assert not made
    text = plan_of(propagation.plan(Registry(spark, SF).typed, r.raw("drawing"), default_rules(spark)))
    assert text.count("ShuffledHashJoin") >= 2 and "SortMergeJoin [component_id" not in text


def test_first_values_of_one_value_and_of_several(spark):
    rows = [("c", "a", [("p", "1")]), ("c", "b", [("p", "1"), ("q", "2"), ("p", "3")]), ("c", "d", []), ("c", "e", [(None, "4")]), ("c", "f", None)]
    df = spark.createDataFrame(rows, "component_id string, drawing_id string, values array<struct<parameter:string,value:string>>")
    assert {tuple(x)[1:] for x in propagation.first_values(df).collect()} == {("a", "p", "1"), ("b", "p", "1"), ("b", "q", "2")}


def test_partitions_of_a_scanned_registry_grow_with_it(spark, monkeypatch):
    r = Registry(spark, SF)
    count = r.raw("drawing").count()
    monkeypatch.setattr(Registry, "buckets", 8)
    assert _rescanned(r)[2].buckets == 16
    r = Registry(spark, SF)
    _ = r.components  # stored in eight buckets
    monkeypatch.setattr(Registry, "buckets", 40)
    table = _rescanned(r)[2]
    assert table.buckets == 40 and table.read().select("drawing_id").distinct().count() < count


def test_replacing_moves_stored_rows_once(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", "drawing_id string, component_id string", buckets=3)
    table.write(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "drawing_id string, component_id string"))
    new = spark.createDataFrame([("a", "5"), ("d", "6")], "drawing_id string, component_id string")
    keys = spark.createDataFrame([("a",), ("b",), ("d",)], "drawing_id string")
    text = plan_of(table.merged(table.read(), new, keys, [0, 1, 2]))
    assert "Join" not in text and text.count("Exchange hashpartitioning(bucket") == 1
    table.replace(new, keys)
    assert {tuple(x) for x in table.read().collect()} == {("a", "5"), ("c", "4"), ("d", "6")}


def test_sheets_of_drawings_need_no_exchange(spark):
    """Cells of line items and of drawings lie together, so rows, headers and ids are found without an exchange; columns are looked for once a sheet."""
    from gridweave.operators import bom
    from gridweave.plans.queries import _book, _cells

    r = Registry(spark, SF)
    for cells in (_cells(r), _book(r)):
        text = plan_of(bom.line_items(cells))
        assert "Exchange hashpartitioning" not in text and "Exchange(" not in text and text.count("SortMergeJoin") == 0
    for name in ("cell", "book"):
        made = r.spark.sql(f"{with_tables(name)} SELECT count(*) AS n FROM {name} s".replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), orders=spark.read.parquet(f"{SF}/orders.parquet"), lineitem=spark.read.parquet(f"{SF}/lineitem.parquet"))
        assert made.first().n == r.raw(name).count() > 0
