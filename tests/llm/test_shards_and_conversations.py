"""Sharding by histogram sort, the prefix trie of conversations and their repair, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridweave.llm import histogram_sort, prefix_rollup, turn_repair

# Histogram sort


def digest(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def brute_shards(rows, shards, tolerance):
    """(id, size, crc, shard, slot) by sorting all rows and looking at each border's neighbours."""
    keyed = sorted((digest(t or ""), digest("" if i is None else str(i)), k, i, t or "") for k, (i, t) in enumerate(rows))
    sizes = [len(t.encode()) + 1 for *_, t in keyed]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    total, close = sum(sizes), sum(sizes) * tolerance // (1000 * shards)
    borders = []
    for j in range(1, shards if rows else 1):
        place = total * j // shards
        k = next(k for k, e in enumerate(ends) if place < e)
        for level in (1, 2, 3):
            same = [m for m, x in enumerate(keyed) if x[:level] == keyed[k][:level]]
            low, high = ends[same[0]] - sizes[same[0]], ends[same[-1]]
            if min(place - low, high - place) <= close or level == 3:
                borders.append(low if place - low <= high - place else high)
                break
    out, filled = [], {}
    for (*_, i, t), n, e in zip(keyed, sizes, ends, strict=True):
        s = sum(b <= e - n for b in borders)
        out.append((i, n, zlib.crc32(t.encode()), s, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + 1
    return sorted(out, key=str)


def shard_rows(df):
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "shards", "tolerance"), [(0, 8, 10), (1, 8, 10), (3, 8, 10), (300, 8, 10), (300, 3, 900), (300, 1, 0)])
def test_shards_equal_a_plain_sort(spark, n, shards, tolerance):
    rng = random.Random(n + shards)
    hot = "hot " * 20
    rows = [(rng.choice([None, str(k), str(k)]), rng.choice([None, "", hot, hot, "é" * rng.randrange(40), "x" * rng.randrange(2000)])) for k in range(n)]
    rows += rows[: n // 3]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = histogram_sort.histogram_sorted(df, shards=shards, texts=False, tolerance=tolerance)
    assert shard_rows(got) == brute_shards(rows, shards, tolerance)


def test_a_group_that_is_a_shard_and_more_is_cut(spark, monkeypatch):
    """Ranges within shards too: many small ones, cut through a group of copies and through repeated rows."""
    monkeypatch.setattr(histogram_sort, "PER_RANGE", 20)
    monkeypatch.setattr(histogram_sort, "CELLS", 64)
    rows = [(k, "copy " * 10) for k in range(400)] + [(7, "again")] * 300 + [(k, f"text {k} " * (k % 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("own"), "kind": F.col("doc_id") % 3})
    got = histogram_sort.histogram_sorted(df)
    assert got.columns == ["doc_id", "text", "kind", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert shard_rows(got) == brute_shards(rows, 8, histogram_sort.TOLERANCE)
    total = {}
    for _, size, _, shard, _ in shard_rows(got):
        total[shard] = total.get(shard, 0) + size
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) <= 0.05 * sum(total.values()) / 8 + 60


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    histogram_sort.write_shards(df, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((k, f"text {k}") for k in range(50))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) and back.select("shard").distinct().count() == 4
    plan = histogram_sort.histogram_sorted(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Prefix trie


def brute_rebuilt(rows):
    own = {}
    name = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], name(r[2], r[3]))):
        own.setdefault(c, []).append((role, text))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        up = min(members[node[:-1]]) if node else None
        children = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(w[: len(v)] == v and len(w) > len(v) for w in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        out.append((min(cs), len(node), up, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, n string, block string"


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], CONVERSATIONS)
    got = prefix_rollup.prefix_trie(*prefix_rollup.rebuilt(prefix_rollup.ordered_turns(df)))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_equals_plain_prefixes(spark):
    """Nulls, ties, repeated rows, long conversations over several blocks, hot first turns, absent bases."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), 1003, 1004, 999_999_999_999]:
        if c % 11 == 5:
            continue  # a base that isn't there
        deep = 30 if c % 7 == 0 else rng.randrange(1, 9)
        for t in range(deep):
            same = rng.random() < (0.97 if c % 7 == 0 else 0.6)
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", None]) if not same else "user", f"é{t}" if same else rng.choice([None, "", "x", "y" * 50])))
    rows += rows[5:9] + [(None, 1, "user", "no conversation")]
    assert trie_of(spark, rows) == brute_trie(brute_rebuilt(rows))


def test_trie_of_nothing_and_of_one_text(spark):
    assert trie_of(spark, []) == []
    rows = [(c, t, "user", "hello") for c in range(300) for t in range(9)]
    assert trie_of(spark, rows) == brute_trie(brute_rebuilt(rows))


def test_running_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_rollup, "CHUNK", 2)
    test_trie_equals_plain_prefixes(spark)


def test_node_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, place long, role string, text string")
    given = turns.select("conv_id", "place", prefix_rollup.turn_digest(F.col("role"), F.col("text")).alias("turn"), F.octet_length("text").cast("long").alias("bytes"))
    nodes = prefix_rollup.prefix_trie(given, given.groupBy("conv_id").agg(F.count("*").alias("length")))
    assert sorted((r.depth, r.role, r.text) for r in prefix_rollup.node_texts(nodes, turns).filter("depth > 0").collect()) == [(1, "user", "a"), (2, "assistant", "b")]


# Repair


def brute_repair(turns):
    """(cost, audit, repaired) by whole strings: the least (cost, audit) of each state after each turn."""
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                t = follows[s]
                new = (cost + 3, audit + "I", (*out, f"{names[t]}:"))
                if t not in best or new < best[t]:
                    best[t] = new
        return best

    best, seen = inserted({0: (0, "", ())}), set()
    counts = [0, 0, 0, 0]
    before = None
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = not blank and (role, text) in seen
        cut = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        seen.add((role, text))
        counts = [a + b for a, b in zip(counts, (blank, again, cut, before is not None and before[:1] + role[:1] not in ("su", "ua", "au")), strict=True)]
        before = role
        found = {}

        def take(state, new, found=found):
            if state not in found or new < found[state]:
                found[state] = new

        for s, (cost, audit, out) in best.items():
            take(s, (cost + 4, audit + "D", out))
            if not (blank or again):
                t, more = follows[s], 3 * cut
                take(t, (cost + 3 + more, audit + "R", (*out, f"{names[t]}:{text}")))
                if role[:1] == names[t][0]:
                    take(t, (cost + more, audit + "K", (*out, f"{role}:{text}")))
                if s == 0 and role[:1] == "s":
                    take(1, (cost + more, audit + "K", (*out, f"{role}:{text}")))
        best = inserted(found)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


ROLES = ["user", "assistant", "system", "tool", " ", "", "usher"]


def random_turns(rng, n):
    return [(rng.choice(ROLES[: rng.choice([2, 3, 7])]), rng.choice(["Yes.", "No!", "cut", " ", "", "Who? \n", f"Turn {k}.", f"turn {k}"])) for k in range(n)]


def repair_of(turns):
    report, seen = turn_repair.Report(1), set()
    for k, (role, text) in enumerate(turns):
        report.add(k, role, text, (role, text) in seen)
        seen.add((role, text))
    return report.row()[2:]


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 1])
def test_repair_equals_whole_strings(prime, monkeypatch):
    """Also where all hashes collide."""
    monkeypatch.setattr(turn_repair, "PRIME", prime)
    rng = random.Random(7)
    for n in [*range(0, 12)] * 40 + [60, 120]:
        turns = random_turns(rng, n)
        assert repair_of(turns) == brute_repair(turns), turns


def test_long_conversations_are_given_out_as_they_come():
    rng = random.Random(9)
    held, report = [], turn_repair.Report(1)
    for k in range(20_000):
        role, text = rng.choice(["user", "assistant", "system"]), f"Turn {k}" + rng.choice(["", "."])
        report.add(k, role, text, False)
        report.ready.clear()
        held.append(len(report.repair.turns) - report.repair.read)
    assert max(held) < 2000
    assert re.fullmatch("[KRDI]+", report.row()[7])
    # turns that must all go, and turns that fit nowhere
    for turns in ([("user", "")] * 3000, [("tool", f"Text {k}.") for k in range(300)]):
        assert repair_of(turns) == brute_repair(turns)


def test_damage_and_repair(spark):
    """Nulls anywhere, ties, repeated rows, a null conversation, and one that is dropped whole."""
    rng = random.Random(11)
    rows = [(c, rng.choice([t, t, None, 2]), rng.choice([*ROLES, None]), rng.choice(["Yes.", "no", None, "", "A. b! c?"])) for c in [*range(80), None] for t in range(rng.randrange(1, 7))]
    dropped = next(c for c in range(1000, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [*rows[:5], (dropped, 0, "user", "Gone.")]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "conv_id long, turn long, role string, text string, repeated string, _copy string")
    by = {}
    for c, t, role, text in rows:
        own = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        own += [] if fault == 0 else [(t, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    want = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        times = [t for t, *_ in turns if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        want.append((c, gaps, *brute_repair([r[1:] for r in turns])))
    got = turn_repair.reports(turn_repair.damaged(df))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
    turns = turn_repair.repaired(turn_repair.damaged(df)).collect()
    texts = {}
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in texts.items()} == {w[0]: w[-1] for w in want if w[-1] != hashlib.sha256(b"").hexdigest()}
    assert turn_repair.reports(turn_repair.damaged(df.limit(0))).count() == 0
