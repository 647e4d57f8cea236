"""The debounce, file events on a stream, and a registry kept up by batches of scans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridweave.operators import authority, checks
from gridweave.streaming import upkeep, watch

c = F.col


def events(spark, times):
    return spark.createDataFrame([(f"{p}.pdf", "modified", float(t)) for p, t in times], "path string, event string, s double").select("path", "event", F.timestamp_millis((c("s") * 1000).cast("long")).alias("ts"))


def test_debounce(spark):
    df = events(spark, [("a", t) for t in (0, 1, 2.5, 3, 5)] + [("b", 1)])
    got = sorted((r.path, r.ts.timestamp()) for r in watch.debounce(df).collect())
    assert got == [("a.pdf", 0.0), ("a.pdf", 2.5), ("a.pdf", 5.0), ("b.pdf", 1.0)]
    assert watch.file_events(df).count() == 6 and watch.debounce(df.limit(0)).count() == 0


def accepted(rows, gap):
    """Leading edge, row by row: (path, microseconds, id) in order."""
    out, last = [], {}
    for path, us, i in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, r[1], r[2])):
        if path not in last or us - last[path] >= gap:
            out.append((path, us, i))
            last[path] = us
    return sorted(out, key=str)


@pytest.mark.parametrize("gap", [1, 300_000, 2_000_000, 50_000_000])
def test_debounce_equals_a_walk(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["x", "x", "x", "y", None, ""]), rng.randrange(60) * 100_000 + rng.randrange(2), k) for k in range(400)]
    df = spark.createDataFrame([*rows, ("x", None, 9999)], "path string, us long, event_id long").select("path", F.timestamp_micros("us").alias("ts"), "event_id", F.lit("own").alias("k"))
    got = watch.debounce(df, seconds=gap / 1e6)
    assert got.columns == df.columns
    assert sorted(((r.path, r.us, r.event_id) for r in got.select("path", F.unix_micros("ts").alias("us"), "event_id").collect()), key=str) == accepted(rows, gap)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    """Runs over what has come in between: the last accepted times outlive them, repeated and late events count once or not at all."""
    at = lambda rows: spark.createDataFrame(rows, "path string, event_id long, s double").select("path", "event_id", F.timestamp_millis((c("s") * 1000).cast("long")).alias("ts"))
    parts = [
        [("a", 1, 100.0), ("a", 2, 101.0), ("a", 3, 101.0), ("b", 4, 100.5), (None, 5, 100.0)],
        [("a", 6, 101.9), ("a", 7, 102.0), ("a", 8, 102.0), ("b", 9, 130.0), ("a", 10, 101.5)],
        # 105 is ten seconds and more behind 130, so it isn't seen; 129 comes late but in time
        [("a", 11, 105.0), ("b", 12, 129.0), ("a", 13, 131.0), ("b", 14, 132.0)],
    ]
    for part in parts:
        at(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        watch.run_debounce(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 2.0)
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [1, 4, 5, 7, 9, 13, 14]


def scan(drawing, parts=(), ends=(), refs=(), blocks=None, kind="DC_SCHEMATIC", at=0):
    values = lambda vs: [(p, v, "", None) for p, v in vs]
    made = [(i, t, values(vs), {"associated_device": d} if d else {}, list(signals)) for i, t, vs, d, signals in parts]
    joined = [(a, b, spec, "", "", k) for k, (a, b, spec) in enumerate(ends)]
    return drawing, kind, f"{drawing}{at}", datetime(2024, 1, 1) + timedelta(seconds=at), list(refs), {b: [str(k) for k in range(n)] for b, n in (blocks or {}).items()}, made, joined


def random_scan(rng, drawing, at):
    ids = [f"{t}-{s}" for t in ("50", "51", "52", "86", "CT", "RTAC") for s in ("L1", "L2", "l2")] + ["50-L1.PWR"]
    parts = {}
    for i in rng.sample(ids, rng.randrange(0, 9)):
        kind = rng.choice(["RELAY", i.split("-")[0], i.split("-")[0]])
        parts[i] = (i, kind, [(p, rng.choice("123")) for p in rng.sample(["voltage_rating", "ratio"], rng.randrange(3))], rng.choice(["", "d1", "d2"]), rng.choice([[], ["DC POWER"], ["TRIP"], []]))
    names = [*ids, "50-L1 RELAY", "BREAKER 52-L1", "DC1", "DC1.PWR", "50-L2 PWR 1", "86 GROUP"]
    ends = [(*rng.sample(names, 2), rng.choice(["", "2/C#10", "3/C#10"])) for _ in range(rng.randrange(0, 6))]
    refs = [rng.choice([f"EC-{rng.randrange(8)}", f"NRE-EC-{rng.randrange(8)}", "EC-99"]) for _ in range(rng.randrange(3))]
    return scan(drawing, parts.values(), ends, refs, {f"TB{rng.randrange(3)}": rng.randrange(1, 7)}, rng.choice(["ONE_LINE", "DC_SCHEMATIC", ""]), at)


def open_rows(rows):
    return sorted((r.mismatch_id, r.check_no, r.component_id, sorted(r.values_found.items()), r.message, r.recommendation) for r in rows.collect())


@pytest.mark.parametrize("seed", [1])
def test_kept_up_mismatches_equal_all_checks(spark, tmp_path, seed):
    """Batches of new, changed and emptied drawings; the second is run twice."""
    rng = random.Random(seed)
    rules = authority.default_rules(spark)
    keeper, now = upkeep.Upkeep(spark, f"file://{tmp_path}/reg", rules, buckets=4), {}
    for number in range(3):
        drawings = rng.sample([f"NRE-EC-{k}" for k in range(8)], 6 if number == 0 else 3)
        rows = [random_scan(rng, d, number) for d in drawings]
        if number:
            rows[0] = scan(drawings[0], at=number)
        rows.append(scan(drawings[-1], at=-1))  # an earlier scan of the same drawing doesn't count
        now |= {r[0]: r for r in rows[:-1]}
        batch = spark.createDataFrame(rows, upkeep.SCAN)
        for _ in range(1 + (number == 1)):
            keeper.apply(batch, number)
    every = spark.createDataFrame(list(now.values()), upkeep.SCAN)
    want = checks.all_checks(every, upkeep.scan_components(every), upkeep.scan_connections(every), rules)
    stored = keeper.mismatches.read()
    assert open_rows(stored.filter("not resolved")) == open_rows(want)
    assert stored.count() == stored.select("mismatch_id").distinct().count() and stored.filter("resolved and resolved_at is null").count() == 0
    assert sorted(r.drawing_id for r in keeper.scans.read().collect()) == sorted(now)


def test_change_stream_and_emptied_drawings(spark, tmp_path):
    """An empty rescan removes a drawing's components, logs it, keeps them in a snapshot and resolves what they caused."""
    root = f"file://{tmp_path}/reg"
    one = lambda v: [("FU-1", "FU", [("voltage_rating", v)], "", [])]
    batches = [
        [scan("A", one("1"), [("FU-1", "FU-2", "2C#10")], ["NRE-X"]), scan("B", one("2"), [("FU-1", "FU-2", "4C#10")])],
        [scan("A", at=1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, upkeep.SCAN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = upkeep.change_stream(spark, f"{tmp_path}/in", root, authority.default_rules(spark), buckets=4)
        q.awaitTermination(600)
        assert q.exception() is None
    got = {(r.batch, r.drawing_id): (r.n_components, r.n_mismatches, r.n_affected) for r in spark.read.parquet(f"{root}/events").collect()}
    # values, voltages and cables differ; A also refers to an unknown drawing
    assert got == {(0, "A"): (1, 4, 1), (0, "B"): (1, 3, 1), (1, "A"): (0, 0, 0)}
    assert [(r.batch, r.drawing_id, r.component_id, r.change_type) for r in spark.read.parquet(f"{root}/change_log").collect()] == [(1, "A", "FU-1", "COMPONENT_REMOVED")]
    assert [(r.batch, r.drawing_id, sorted(r.components)) for r in spark.read.parquet(f"{root}/snapshots").collect()] == [(1, "A", ["FU-1"])]
    keeper = upkeep.Upkeep(spark, root, authority.default_rules(spark), buckets=4)
    assert {(r.drawing_id, len(r.components)) for r in keeper.scans.read().collect()} == {("A", 0), ("B", 1)}
    assert keeper.mismatches.read().filter("not resolved").count() == 0 and keeper.mismatches.read().count() == 4


def test_a_large_batch_has_all_checked_without_the_index(spark, tmp_path, monkeypatch):
    """The index isn't asked; of an id that a scan has twice the last one counts; affected drawings are counted, not paired."""
    monkeypatch.setattr(upkeep, "LARGE", 1)
    monkeypatch.setattr(upkeep.Upkeep, "affected", None)
    rng = random.Random(3)
    rules, now = authority.default_rules(spark), {}
    keeper = upkeep.Upkeep(spark, f"file://{tmp_path}/reg", rules, buckets=2)
    for number in range(2):
        rows = [random_scan(rng, f"NRE-EC-{k}", number) for k in range(number, 5 - number)]
        if number:
            fuse = lambda v: ("FU-1", "FU", [("ratio", v)], "", [])
            rows += [scan("NRE-EC-4", at=1), scan("NRE-EC-5", [fuse("1"), fuse("2")], at=1), scan("NRE-EC-6", [fuse("3")], at=1)]
        now |= {r[0]: r for r in rows}
        keeper.apply(spark.createDataFrame(rows, upkeep.SCAN), number)
    every = spark.createDataFrame(list(now.values()), upkeep.SCAN)
    parts = upkeep.scan_components(every)
    stored = keeper.mismatches.read()
    assert open_rows(stored.filter("not resolved")) == open_rows(checks.all_checks(every, parts, upkeep.scan_connections(every), rules))
    assert {r.values_found["NRE-EC-5"] for r in stored.filter("component_id = 'FU-1' and parameter = 'ratio'").collect()} == {"2"}
    assert stored.count() == stored.select("mismatch_id").distinct().count() and stored.filter("resolved and resolved_at is null").count() == 0
    counts = {r.drawing_id: r.n_affected for r in spark.read.parquet(f"{tmp_path}/reg/events").filter("batch = 1").collect()}
    pairs = upkeep.propagation.impact(parts).groupBy("source_drawing_id").count().collect()
    assert {d: n for d, n in counts.items() if n} == {r[0]: r[1] for r in pairs if r[0] in counts}


def test_an_index_that_large_batches_put_off_is_made_by_the_next_that_asks(spark, tmp_path, monkeypatch):
    """Two large batches write no index; small ones after them, one run twice, find what all checks find."""
    rng = random.Random(5)
    rules, now = authority.default_rules(spark), {}
    keeper = upkeep.Upkeep(spark, f"file://{tmp_path}/reg", rules, buckets=2)
    for number, large in enumerate((True, True, False, False)):
        monkeypatch.setattr(upkeep, "LARGE", 1 if large else 1000)
        drawings = [f"NRE-EC-{k}" for k in (range(6) if number == 0 else rng.sample(range(7), 3))]
        rows = [random_scan(rng, d, number) for d in drawings]
        now |= {r[0]: r for r in rows}
        for _ in range(1 + (number == 2)):
            keeper.apply(spark.createDataFrame([*rows, scan(drawings[0], at=-1)], upkeep.SCAN), number)
        assert keeper.entries.exists() != large
    every = spark.createDataFrame(list(now.values()), upkeep.SCAN)
    want = checks.all_checks(every, upkeep.scan_components(every), upkeep.scan_connections(every), rules)
    assert open_rows(keeper.mismatches.read().filter("not resolved")) == open_rows(want)
    index = lambda df: sorted(map(repr, df.select("key", "kind", "drawing_id").distinct().collect()))
    assert index(keeper.entries.read()) == index(upkeep.entries(keeper.scans.read()))
