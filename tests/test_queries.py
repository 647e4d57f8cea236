"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__
from gridweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(norm(r) for r in df.select(cols).collect()) == sorted(norm(r) for r in cur.fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sync_report_has_all_checks(spark):
    """Its mismatch and recommendation rows are those of the SQL of the twelve checks, one for each drawing."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    checks = [n for n in ORACLES if re.match(r"m\d+_", n) and n != "m1_resolution_options"]
    assert len(checks) == 12
    want = sorted({(d, r[0], r[1]) for n in checks for r in con.execute(f"SELECT mismatch_id, severity, drawings FROM ({ORACLES[n]})").fetchall() for d in r[2].split(",")})
    rows = QUERIES["r3_sync_report"](spark, SF).filter("section <> 'component'").collect()
    assert sorted((r.drawing_id, r.name, r.detail) for r in rows if r.section == "mismatch") == want
    tags = {"CRITICAL": "[RED FLAG]", "WARNING": "[WARNING]"}
    advice = sorted((r.drawing_id, r.name, r.detail.split("]")[0] + "]") for r in rows if r.section == "recommendation" and r.detail.startswith("["))
    assert advice == [(d, k, tags[s]) for d, k, s in want if s in tags] and any(t == "[RED FLAG]" for _, _, t in advice)
