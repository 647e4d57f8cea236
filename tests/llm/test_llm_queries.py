"""The registered queries against their SQL, and the pipeline against what its stages promise."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from gridweave.llm import mixing
from gridweave.llm.queries import ORACLES, QUERIES
from llm_brute_force import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(cols).collect()) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_learned_query_covers_the_table(spark, name):
    df = QUERIES[name](spark, SF)
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r[0] for r in df.select("doc_id").collect()) == ids


def test_pipeline(spark, tmp_path):
    """Every stage against brute force, SQL or labels, over what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test{k}")
        assert docs.columns == cols
        kept = {r.doc_id: r for r in docs.collect()}
        assert 0 < len(kept) <= len(before) and all(before[i] == r for i, r in kept.items())
        rows = [(i, r.text) for i, r in before.items()]
        if name == "quality classifier":
            right = [(i in kept) == (labels[i].quality == 1) for i in before if i in labels and labels[i].quality is not None]
            assert sum(right) >= 0.9 * len(right)
        elif name == "toxicity":
            clean = [i in kept for i in before if i in labels and labels[i].toxic == 0]
            assert sum(clean) >= 0.95 * len(clean)
        elif name == "n-gram Jaccard join":
            assert set(kept) == {i for i, _, low in brute_components(rows, 5, 80) if i == low}
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept) == {r[0] for r in brute_contamination(rows, bench, 10) if not r[4]}
        before = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    docs.write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW kept AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    cur = con.execute(f"WITH {mixing.mixing_sql('kept')} SELECT * FROM m9")
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in last.select(names).collect()) == want
    assert sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, SF).select(names).collect()) == want
