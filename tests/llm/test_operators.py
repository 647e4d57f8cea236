"""Small cases of the ten operators: brute force, nulls, empty and repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import textwrap
import zlib
from collections import Counter
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.llm import bloom, context_tree, decontaminate, licences, merkle, mixing, prefix_tree_join, quality, textbytes, toxicity, url_filter, warc
from gridweave.llm.shared import components
from llm_brute_force import brute_components, brute_contamination, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows():
    """Copies, near copies, nulls, empty and short texts, repeated rows, a long text."""
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randrange(1, 90))) for k in range(40)]
    base = sentence(rng, 120)
    for k in range(40, 70):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
        rows.append((k, " ".join(w)))
    rows += [(70, None), (71, ""), (72, "   "), (73, "ONE two"), (74, "one TWO"), (75, base), (75, base), (None, base), (76, sentence(rng, 6000, 100000)), (77, "é ü 漢字 " + base)]
    return rows


# byte helpers


def test_words_and_digests():
    texts = pa.array(["Ab  cd\té漢", None, "", "ab", "cd é漢 " * 3])
    w = textbytes.Words(texts)
    assert w.counts().tolist() == [3, 0, 0, 1, 6]
    assert w.digest[0] == w.digest[3] and w.digest[1] == w.digest[4] and w.digest[2] == w.digest[5]
    part = textbytes.Words(texts.slice(3, 2))
    assert part.digest.tolist() == w.digest[3:].tolist()
    long = pa.array(["x" * 3_000_000 + " y", "y"])
    assert textbytes.Words(long).digest[1] == textbytes.Words(long).digest[2]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 150))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: licences


def test_licence_scan(spark):
    apache = "\n".join(licences.SENTENCES[k] for k in ("APACHE2_HEADER", "APACHE2_OBTAIN", "APACHE2_AS_IS", "APACHE2_SEE"))
    rows = [
        (1, "Text.\nReleased under the MIT License."),
        (2, apache),
        (3, "ALL RIGHTS RESERVED! released under the mit license. Licensed under CC BY-NC 4.0."),
        (4, None),
        (5, ""),
        (6, "the MIT License is fine"),
        (6, "the MIT License is fine"),
    ]
    df = docs_of(spark, rows).withColumn("licences", F.lit("mine"))
    got = {r.doc_id: r for r in licences.licence_scan(df).collect()}
    assert got[1].licences == ["MIT"] and [tuple(x) for x in got[1].found] == [(1, "MIT_RELEASED")]
    assert got[2].licences == ["Apache-2.0"] and len(got[2].sentence_ids) == 4
    assert got[3].licences == ["MIT", "CC-BY-NC-4.0", "All-Rights-Reserved"]
    assert got[4].licences == got[5].licences == got[6].licences == []
    assert licences.licence_scan(df).count() == 7 and licences.licence_scan(df.limit(0)).count() == 0


def wrapped(keys, width, mark):
    lines = []
    for k in keys:
        lines += [""] if lines else []
        lines += textwrap.wrap(licences.SENTENCES[k], width, break_long_words=False, break_on_hyphens=False)
    return "\n".join(mark + line for line in lines)


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_licences(spark, mark):
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "", "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an \"AS IS\" BASIS,", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and", "limitations under the License."]
    rules = [("MIT", ("MIT_TITLE_SHORT", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS")), ("BSD-3-Clause", ("BSD_REDISTRIBUTION", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME")), ("BSD-2-Clause", ("BSD_REDISTRIBUTION", "BSD_SOURCE", "BSD_BINARY")), ("GPL-3.0-or-later", ("GPL_FREE", "GPL_HOPE", "GPL_SEE"))]
    rows, want = [(0, "\r\n".join(mark + x for x in apache))], {0: (["Apache-2.0"], ["APACHE2_HEADER", "APACHE2_OBTAIN", "APACHE2_AS_IS", "APACHE2_SEE"])}
    for name, keys in rules:
        for width in (38, 60, 76):
            want[len(rows)] = ([name], list(keys))
            rows.append((len(rows), wrapped(keys, width, mark)))
    got = {r.doc_id: r for r in licences.licence_scan(docs_of(spark, rows)).collect()}
    for k, (names, ids) in want.items():
        assert [x for x in got[k].licences if names != ["MIT"] or x == "MIT"] == names and got[k].sentence_ids == ids, (k, got[k].sentence_ids)


@pytest.mark.parametrize("mark", ["# ", " * ", ""])
def test_whole_licence_texts(spark, mark):
    """Texts of more than 20 licences, wrapped at 72 columns with a copyright line before: each is found, and nothing else."""
    rows = []
    for k, text in enumerate(licences.TEXTS.values()):
        lines = ["Copyright (c) 2020 A. Holder", ""]
        for part in text.split("\n"):
            lines += [*textwrap.wrap(part, 72 - len(mark), break_long_words=False, break_on_hyphens=False), ""]
        rows.append((k, "\n".join((mark + line).rstrip() for line in lines)))
    got = {r.doc_id: r.licences for r in licences.licence_scan(docs_of(spark, rows)).collect()}
    assert len(rows) > 20 and {n: got[k] for k, n in enumerate(licences.TEXTS)} == {n: [n] for n in licences.TEXTS}


def test_licences_from_a_table(spark):
    table = spark.createDataFrame([("Own-1.0", "You may do with this text as you like. It comes to you without any promise at all."), (None, "x"), ("Y", None)], "licence string, text string")
    known, rules = licences.from_texts(licences.texts_of(table), {}, ())
    df = docs_of(spark, [(1, "# You may do with this text\n# as you like. It comes to you\n# without any promise at all."), (2, "You may do with this text as you like.")])
    assert {r.doc_id: (r.licences, len(r.found)) for r in licences.licence_scan(df, known=known, rules=rules).collect()} == {1: (["Own-1.0"], 2), 2: ([], 1)}
    with pytest.raises(ValueError, match="more than 0"):
        licences.texts_of(table, most=0)


def test_wrapped_sentences_keep_to_their_bounds(spark):
    texts = ["one\ntwo. MIT\nLicense\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n* Redistributions of source code must retain the above copyright notice,\n  this list of conditions and the following disclaimer.\nx", "Under MIT. License.", "MIT\n\nLicense", "the MIT\nLicense", "MIT\nLicense too"]
    got = {r.doc_id: [tuple(x) for x in r.found] for r in licences.licence_scan(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [(2, "MIT_TITLE_SHORT"), (4, "BSD_REDISTRIBUTION"), (7, "BSD_SOURCE")], 1: [], 2: [], 3: [], 4: []}


# 2: toxicity


def test_nnpu_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        toxic = rng.random() < 0.15
        text = sentence(rng, 40) + (" badword Awfulness awfully." if toxic else "")
        rows.append((k, text))
        if rng.random() < 0.6:
            labels.append((k, 1, int(toxic)))
    rows += [(9000, None), (9001, "")]
    truth = {k: "badword" in (t or "") for k, t in rows}
    df, lab = docs_of(spark, rows), spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k] >= 0.3) == truth[k] for k in held) / len(held)
    assert right > 0.97 and got[9000] == got[9001] < 0.3
    assert toxicity.keep_clean(df, lab).columns == df.columns


def test_toxicity_without_labels_or_rows(spark):
    df, lab = docs_of(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(df, lab).count() == 2
    assert toxicity.keep_clean(df.limit(0), lab).count() == 0


def test_risk_and_gradient_equal_finite_differences():
    """Both signs of the estimated risk on negatives, against the risk written out by document."""
    rng = np.random.default_rng(3)
    f = [np.sort(rng.choice(6, rng.integers(0, 5), replace=False)).astype(np.int32) for _ in range(40)]
    n_p, n_u = np.array([len(c) ** 2 for c in f]), rng.integers(1, 4, 40)
    all_p, all_u = int(n_p.sum()), int(n_u.sum())

    def risk(w, prior):
        z = np.array([w[c].sum() + w[-1] for c in f])
        pos = sum(n * math.log1p(math.exp(-x)) for n, x in zip(n_p, z, strict=True)) / all_p
        neg = sum(n * math.log1p(math.exp(x)) for n, x in zip(n_u, z, strict=True)) / all_u - prior * sum(n * math.log1p(math.exp(x)) for n, x in zip(n_p, z, strict=True)) / all_p
        return prior * pos, neg

    signs = set()
    for prior, shift in ((0.1, 0.0), (0.5, 0.0), (0.45, -3.0), (0.95, 2.0)):
        w = rng.normal(0, 1, 7) + shift
        value, g = toxicity.nnpu(*toxicity.sums(f, n_p, n_u, w), all_p, all_u, prior)
        a, b = risk(w, prior)
        signs.add(b >= 0)
        assert value == pytest.approx(a + max(0.0, b))
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            up, down = risk(w + e, prior), risk(w - e, prior)
            # below zero the step goes up the risk on negatives
            want = (sum(up) - sum(down)) / 2e-6 if b >= 0 else -(up[1] - down[1]) / 2e-6
            assert g[k] == pytest.approx(want, abs=1e-6)
    assert signs == {True, False}


def test_patterns_and_counts_cover_all_rows(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, rng.randrange(0, 30), 20)) for k in range(60)] + [(60, None), (61, ""), (5, "w1 w1")]
    df = docs_of(spark, rows).select("text", (F.col("doc_id") % 3 == 0).alias("positive"))
    own = toxicity.buckets(pa.array([t for _, t in rows]))
    want = Counter(x for r in own for x in r.tolist())
    got = {r.feature: r.n for r in toxicity._counted(df, None).collect()}
    assert got.pop(-1) == len(rows) and got == want
    chosen = np.sort(np.array([k for k, n in want.items() if n % 2], np.int64))
    seen = {tuple(np.frombuffer(bytes(r.f), np.int32).tolist()): (r.n_p, r.n_u) for r in toxicity.patterns(df, chosen).collect()}
    brute: dict = {}
    for (i, _), r in zip(rows, own, strict=True):
        key = tuple(np.flatnonzero(np.isin(chosen, r)).tolist())
        p, u = brute.get(key, (0, 0))
        brute[key] = (p + (i % 3 == 0), u + 1)
    assert seen == brute


def test_null_ids_and_repeated_rows_in_classifiers(spark):
    rng = random.Random(12)
    rows = [(k, sentence(rng, 30) + (" vile" * 3 if k % 5 == 0 else ""), "en", "src1", 100) for k in range(120)]
    rows += [(5, rows[5][1], "en", "src1", 100)] * 2 + [(None, "null id", None, None, None), (None, "vile vile", "en", "x", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("quality_score", F.lit("mine")).withColumn("score", F.lit("mine"))
    lab = spark.createDataFrame([(k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(120)] + [(None, 1, 1), (5, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab, rounds=5))
    assert got.count() == len(rows) and got.filter("score is null").count() == 0
    got = quality.score(df, quality.fit(df, lab, rounds=1, most_exchanged=5))
    assert got.count() == len(rows) and got.filter("quality_score is null").count() == 0 and dict(got.dtypes)["quality_score"] == "double"


# 3: quality


def test_cotraining(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        text = ". ".join(sentence(rng, 12) for _ in range(5)) if good else " | ".join(["NAV!!"] * rng.randrange(20, 60))
        rows.append((k, text, "en" if rng.random() < 0.9 else None, "src1" if good else None, len(text)))
        labels.append((k, int(good), 0))
    rows += [(9000, None, None, None, None), (9001, "", "en", "src1", 0)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, most_labelled=300)
    got = {r.doc_id: r.quality_score for r in quality.score(df, model).collect()}
    held = [(k, y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= 0.5) == bool(y) for k, y in held) / len(held) > 0.97
    assert len(got) == len(rows) and quality.keep_good(df, lab).columns == df.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df, none).count() == len(rows) and quality.keep_good(df.limit(0), none).count() == 0


def test_exchange_equals_brute_force(spark):
    """The documents of which a view is sure, the first by hash for each view and label, and none on which both differ."""
    rng = random.Random(13)
    rows = []
    for k in range(200):
        good = rng.random() < 0.5
        rows.append((k, (". ".join(sentence(rng, 9) for _ in range(4))) if good else "!! @@ | # " * rng.randrange(3, 20), "en", f"src{int(rng.random() < (0.9 if good else 0.2))}", rng.randrange(1, 999)))
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(r[0], int("w" in r[1]), 0) for r in rows[:100]], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, rounds=0, held_mod=1000)
    least, most = 0.7, 4
    cols = [pa.array([r[k] for r in rows]) for k in range(1, 5)]
    p = model.scores(*cols)[:2]
    sure = [(r[0], *(1 if q[k] >= least else 0 if 1 - q[k] >= least else -1 for q in p)) for k, r in enumerate(rows)]
    sure = [x for x in sure if not (x[1] >= 0 and x[2] >= 0 and x[1] != x[2])]
    order = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(7))).collect()}
    want: dict = {}
    for at, to in ((1, 1), (2, 0)):
        for label in (0, 1):
            # what the text view (1) is sure of goes to the metadata view
            for x in sorted((x for x in sure if x[at] == label), key=lambda x: (order[x[0]], x[0]))[:most]:
                want.setdefault(x[0], [-1, -1])[to] = label
    got = {r.doc_id: [r.y_text, r.y_meta] for r in quality.exchanged(df, model, least=least, most=most, seed=7).collect()}
    assert got == want and got


def test_metadata_view_reads_no_text():
    view = quality.metadata_view(pa.array(["en", None]), pa.array([None, "src1"]), pa.array([None, 12], pa.int64()))
    assert view.sum() == 6 and (view.sum(0) <= 1).all()


# 4: WARC


def test_records_round_trip_and_verify():
    data = warc.response_record("urn:page:1", "http://a/\r\nX: y", b"<p>\xc3\xa9</p>", warc.sha1_base32(b"<p>\xc3\xa9</p>")) + warc.response_record("urn:page:2", None, b"", warc.sha1_base32(b""))
    got = list(warc.read_records(io.BytesIO(data)))
    assert [p for _, _, p in got] == [b"<p>\xc3\xa9</p>", b""] and got[0][0]["warc-target-uri"] == "http://a/ X: y"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    bad = warc.response_record("urn:page:1", None, b"abc", warc.sha1_base32(b"abd"))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 700_000
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/", None), (4, "u", ""), (5, "u", big), (6, "u", "é"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(warc.planned(pages), f"file://{tmp_path}/warc", archive_bytes=500)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    html = {k: (h or "").encode() for k, _, h in rows}
    for k, url, _ in rows:
        assert (got[k].payload_bytes, got[k].url) == (len(html[k]), url)
        assert got[k].payload_digest == base64.b32encode(hashlib.sha1(html[k]).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert bytes(got[5].payload) == html[5] and got[1].payload is None
    assert warc.read_archives(warc.write_archives(warc.planned(pages.limit(0)), f"file://{tmp_path}/none")).count() == 0


def test_each_attempt_has_its_own_archives(spark, tmp_path):
    """A second run into the same folder touches no file of the first, and stray files are not read."""
    pages = spark.createDataFrame([(k, "u", f"text {k % 4}") for k in range(20)], "page_id long, url string, html string").repartition(2)
    folder = tmp_path / "w"
    first = warc.write_archives(warc.planned(pages), f"file://{folder}", archive_bytes=400)
    names = sorted(r.archive for r in first.collect())
    (folder / "part-000000-00000-999.warc.gz").write_bytes(b"half a record")
    second = warc.write_archives(warc.planned(pages), f"file://{folder}", archive_bytes=400)
    assert not set(names) & {r.archive for r in second.collect()}
    for table in (first, second):
        assert sorted((r.page_id, r.refers_to) for r in warc.read_archives(table).collect()) == sorted((k, None if k >= 16 else 16 + k % 4) for k in range(20))


def test_popular_payloads_and_repeated_ids(spark, tmp_path):
    rows = [(k, "u", "same") for k in range(30)] + [(29, "v", "same"), (29, "v", "other"), (7, "u", "other"), (None, "u", "other"), (50, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for popular in (2, 1000):
        got = warc.read_archives(warc.write_archives(warc.planned(pages, popular=popular), f"file://{tmp_path}/{popular}")).collect()
        want = [(i, None if (t, i) in (("same", 29), ("other", 29)) or t == "" else 29) for i, _, t in rows]
        assert sorted(((r.page_id, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.refers_to is None for r in warc.planned(pages, least_bytes=10).collect())


# 5: Jaccard join


@pytest.mark.parametrize(("n", "percent", "block", "common"), [(4, 85, 2048, 0.002), (5, 80, 4, 0.002), (4, 85, 3, 0.2)])
def test_near_duplicates_equal_brute_force(spark, mixed_rows, n, percent, block, common):
    got = prefix_tree_join.near_duplicates(docs_of(spark, mixed_rows), n=n, percent=percent, block=block, common=common)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(mixed_rows, n, percent)


def test_near_duplicates_of_nothing(spark):
    assert prefix_tree_join.near_duplicates(docs_of(spark, [])).count() == 0
    same = "a b c d e f"
    kept = prefix_tree_join.one_of_each(docs_of(spark, [(3, same), (1, "A b c d e f"), (1, "A b c d e f"), (3, "quite another text of seven words"), (None, same), (None, "null one two three"), (None, "null one two three"), (2, None), (4, ""), (4, "")]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "A b c d e f"), (3, "quite another text of seven words"), (None, "null one two three"), (2, None), (4, ""), (4, "")], key=str)


def test_prefix_tree_finds_what_sets_say():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, len(base)), replace=False), rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    for percent in (60, 85):
        tree, union, links = prefix_tree_join.PrefixTree(percent), prefix_tree_join.Union(), []
        for k, s in enumerate(sets):
            tree.search(k, s, union, lambda a, b: union.join(a, b) and links.append((a, b)))
            tree.add(k, s)
        want = prefix_tree_join.Union()
        for a, b in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                want.join(a, b)
        assert [union.find(k) for k in range(60)] == [want.find(k) for k in range(60)]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64))
        x, y = prefix_tree_join.bitmap(a), prefix_tree_join.bitmap(b)
        low = prefix_tree_join.difference_at_least(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y))
        assert low <= len(np.setxor1d(a, b))


# 6: URLs


def test_urls(spark):
    rows = [(1, "https://WWW.Spam.example.net/a/1.html?utm_source=x#y"), (2, "http://spam.example.net/a/1/"), (3, "http://a.example.org/es/x"), (4, "http://b.example.org/en/17"), (5, "http://c.org"), (6, "http://xexample.org/es/"), (7, None), (8, "nothing"), (9, "ftp://ok.example.net?://u"), (9, "ftp://ok.example.net?://u"), (10, "x://d.com/de/1"), (11, "http://spam.example.net/a/1?id=1"), (12, "http://m.spam.example.net/a?utm_a=1&id=2&utm_b=3")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old"))
    listed = spark.createDataFrame([("spam.example.net/a/1",), (None,), ("spam.example.net/a/1",), ("spam.example.net/a?id=2",)], "u string")
    got = {r.page_id: r for r in url_filter.judged(pages, listed).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.spam.example.net", "/a/1.html", None, "block")
    assert got[11].verdict == "allow" and got[12].verdict == "block"
    assert got[2].verdict == "block" and (got[3].rule, got[3].verdict) == ("example.org/es/", "block")
    assert (got[4].rule, got[4].verdict) == ("example.org/en/1", "block")
    assert (got[5].rule, got[5].host, got[5].path) == (None, "c.org", "") and got[6].rule == "org/"
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in (7, 8)] == [("", "", None, "allow")] * 2
    assert got[9].host == "ok.example.net" and got[10].rule == "com/de/"
    assert url_filter.judged(pages, listed).count() == len(rows) and url_filter.judged(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = [f"k{i}" for i in range(5000)]
    f = bloom.BlockedBloom.of(spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    assert f.flags(pa.array(keys)).all()
    assert f.flags(pa.array([f"other{i}" for i in range(20000)])).mean() < 0.02
    small = bloom.BlockedBloom.of(spark.createDataFrame([(k,) for k in keys], "k string"), "k", most_bits=512)
    assert small.flags(pa.array(keys)).all()


# 7: benchmark


@pytest.mark.parametrize("block_chars", [10**9, 60])
def test_contamination_equals_brute_force(spark, block_chars):
    rng = random.Random(8)
    bench = [(k, sentence(rng, rng.choice([1, 2, 3, 7, 10, 11, 25]), 30)) for k in range(8)] + [(9, None), (10, "--"), (None, "w1 w2"), (3, "w1 w1 w1"), (11, "w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5")]
    rows = [(k, sentence(rng, rng.randrange(0, 80), 30)) for k in range(30)]
    for k, t in bench[:8]:
        rows.append((100 + k, sentence(rng, 9) + " " + t.upper().replace(" ", ", ") + " " + sentence(rng, 5)))
    rows += [(200, None), (201, ""), (202, " ".join(["w5"] * 40)), (203, rows[30][1]), (203, rows[30][1]), (None, rows[31][1]), (204, "w5é w5")]
    df = docs_of(spark, rows).withColumn("items", F.lit("mine"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(df, b, block_chars=block_chars)
    have = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()), key=str)
    assert have == brute_contamination(rows, bench, 10)
    assert decontaminate.drop_contaminated(df, b).columns == df.columns
    assert decontaminate.contamination(df.limit(0), b).count() == 0
    assert decontaminate.contamination(df, b.limit(0)).filter("contaminated").count() == 0


def test_a_text_of_more_words_than_a_rank_has_room_for():
    n = (1 << 21) + 50
    text = " ".join(map(str, range(n)))
    probe = decontaminate.Probe([("a", " ".join(map(str, range(n - 20, n - 5)))), ("b", "5 6 8"), ("c", "7 8 9")], 10)
    counts, doc, start, size, item = decontaminate._search(pa.array(["x", text, None]), probe)
    assert counts.tolist() == [1, n, 0] and set(doc.tolist()) == {1}
    assert sorted(zip(start.tolist(), size.tolist(), item.tolist(), strict=True)) == [(7, 3, 2), *((n - 20 + k, 10, 0) for k in range(6))]


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    for depth in (3, 12, 40):
        rank = rng.integers(1, 4, 300)
        rank[[0, 77, 78, 200, 299]] = 0
        order, _ = decontaminate.suffix_array(rank, depth)
        two, _ = decontaminate.suffix_array(rank, depth, 2, 31)
        ends = [int(np.flatnonzero(rank[p:] == 0)[0]) for p in range(len(rank))]
        view = [tuple(rank[p : p + min(depth, e)]) for p, e in enumerate(ends)]
        got = [view[p] for p in order]
        assert [view[p] for p in two] == got
        assert sorted(order.tolist()) == list(range(300)) and got == sorted(got)


def test_longest_matches(spark):
    b = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(30)))], "item_id long, text string")
    df = docs_of(spark, [(5, "x y " + " ".join(f"T{i}" for i in range(4, 22)) + " z"), (6, "t1 t2 t3"), (7, None)])
    assert [tuple(r) for r in decontaminate.longest_matches(df, b).collect()] == [(5, 2, 18, "1", 4)]


# 8: mixing


def test_budgets_flow_to_siblings_first(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    weights = {"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}, "source": {}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r.source: r.alloc for r in mixing.leaf_budgets(df, 1600, weights, 1).collect()}
    assert got == {"a": 100, "b": 300, "c": 400, "d": 800}
    got = {r.source: r.alloc for r in mixing.leaf_budgets(df, 2600, weights, 1).collect()}
    assert got == {"a": 100, "b": 700, "c": 800, "d": 1000}
    assert sum(r.alloc for r in mixing.leaf_budgets(df, 3100, weights, 1).collect()) == 3100


def test_mixing_takes_prefixes(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, rng.randrange(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2", None, "odd"]), 0) for k in range(300)]
    rows += [(None, "a b", "en", "src0", 0), (500, None, "en", "src0", 0), (500, None, "en", "src0", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df).collect()
    total = sum(len(words(t)) for _, t, *_ in rows)
    taken = sum(r.n_tokens * r.copies for r in got)
    assert 0.5 * total < taken <= 0.6 * total and {r.doc_id for r in got} <= {r[0] for r in rows}
    assert mixing.mixed(df.limit(0)).count() == 0
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert max(r.copies for r in mixing.mixed(df, share=(30, 10), epochs=2).collect()) == 2


# 9: Merkle trees


def test_edits_and_next_documents(spark):
    rng = random.Random(10)
    rows = [(k * 3, "\n".join(sentence(rng, rng.randrange(0, 40)) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é漢字"), (1003, rows[4][1])]
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs_of(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - k] + u[:k]
    assert got[1003].tree.root == got[12].tree.root and got[1000].tree.root == got[1001].tree.root
    assert got[1000].near_edited == 1.0
    long = [r for r in got.values() if r.n_chars > 2000]
    assert all(0.4 < r.near_edited < 1 and r.near_next < 0.1 for r in long)
    assert all(min(r.differing) > 0 for r in long if len(r.tree.paragraphs) > 4)


def test_merkle_of_few_and_repeated_rows(spark):
    assert merkle.edited_fingerprints(docs_of(spark, [])).count() == 0
    one = merkle.edited_fingerprints(docs_of(spark, [(5, "abcdef")])).first()
    assert one.edited == "abcdab" and one.near_next == 1.0
    three = merkle.edited_fingerprints(docs_of(spark, [(5, "a b c"), (5, "a b c"), (None, "x")]))
    assert three.count() == 3


@pytest.mark.parametrize("kind", ["wide", "string", "decimal", "clustered"])
def test_next_documents_of_any_ids(spark, kind):
    """The next one in descending order, over many ranges, for ids of any type and spread."""
    rng = random.Random(14)
    ids = {"wide": [-(2**63), 2**63 - 1, *(rng.randrange(-(2**62), 2**62) for _ in range(80))], "string": [f"d{k}" for k in range(90)] + ["", "é"], "decimal": [10**25 + k * 7 for k in range(60)], "clustered": [*range(100), 2**60, -(2**60)]}[kind]
    ids = [None, *ids]
    texts = {i: f"text of {i} " + "x" * rng.randrange(9) for i in ids}
    schema = {"string": "doc_id string, text string", "decimal": "doc_id decimal(38,0), text string"}.get(kind, "doc_id long, text string")
    made = [(Decimal(i) if kind == "decimal" and i is not None else i, t) for i, t in texts.items()]
    df = merkle.with_next(spark.createDataFrame(made, schema).repartition(5), "doc_id", "text", per_range=7)
    assert df.select("_b").distinct().count() > 3
    over = Window.partitionBy("_b").orderBy("_g", F.col("_k").desc(), "text")
    got = {r.text: r.n for r in df.withColumn("n", F.lead("text").over(over)).filter("not _g").select("text", "n").collect()}
    ordered = [texts[i] for i in sorted((i for i in ids if i is not None), key=lambda i: i.encode() if kind == "string" else i, reverse=True)] + [texts[None]]
    assert got == dict(zip(ordered, [*ordered[1:], ordered[0]], strict=True))


def test_pieces_are_cut_by_content(spark):
    """One line without spaces, and one inserted word: most leaves stay; equal roots for equal texts alone."""
    rng = random.Random(15)
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20000))
    line = " ".join(f"w{rng.randrange(9999)}." if rng.random() < 0.1 else f"w{rng.randrange(9999)}" for _ in range(5000))
    same = "ab" * 3000
    rows = [(1, wide), (2, wide[:50] + "\u4e01\u9000" + wide[50:]), (3, line), (4, "start " + line), (5, same), (6, same + "b"), (7, "a\x01b"), (8, "ab")]
    df = merkle.merkle_tree(docs_of(spark, rows), F.col("text"), "tree").select("doc_id", "tree")
    a, b = df.withColumnRenamed("tree", "a"), df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tree").alias("b"))
    got = {r.doc_id: r.near for r in merkle.likeness(a.join(b, "doc_id"), "a", "b", "near").collect()}
    assert got[1] > 0.9 and got[3] > 0.98 and got[5] < 1 and got[7] < 1
    assert df.select("tree.root").distinct().count() == len(rows)
    edited = merkle.edited_fingerprints(docs_of(spark, rows[:1] + [(0, "z" * 9000)]))
    assert 0.6 < {r.doc_id: r.near_edited for r in edited.collect()}[1] < 0.7


def test_likeness_by_descent_equals_sets_of_leaves(spark):
    rng = random.Random(16)
    lines = [sentence(rng, 20) + "." for _ in range(80)]
    rows = []
    for k in range(30):
        mine = [rng.choice(lines) for _ in range(rng.randrange(1, 60))] if k % 3 else lines[: rng.randrange(1, 80)]
        rows.append((k, "\n".join(mine)))
    df = merkle.merkle_tree(docs_of(spark, rows), F.col("text"), "tree").select("doc_id", "tree")
    pairs = df.select(F.lit(0).alias("z"), "doc_id", F.col("tree").alias("a")).join(df.select(F.lit(0).alias("z"), F.col("doc_id").alias("o"), F.col("tree").alias("b")), "z")
    for r in merkle.likeness(pairs, "a", "b", "near").collect():
        x, y = set(r.a.leaves), set(r.b.leaves)
        assert r.near == pytest.approx(1.0 if r.a.root == r.b.root else len(x & y) / max(len(x), len(y)))


# Very long texts


def test_very_long_texts(spark, tmp_path):
    """A text of 1.5 million characters passes through every operator, whole."""
    rng = random.Random(17)
    long = sentence(rng, 250_000, 50_000)
    rows = [(1, long), (2, long[:-20] + " and another end"), (3, "short\nReleased under the MIT License."), (4, long + "\nReleased under the MIT License.")]
    df = docs_of(spark, rows)
    lab = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.licences for r in licences.licence_scan(df).collect()} == {1: [], 2: [], 3: ["MIT"], 4: ["MIT"]}
    assert toxicity.score(df, toxicity.fit(df, lab, rounds=2)).count() == 4 and quality.score(df, quality.fit(df, lab, rounds=0)).count() == 4
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"), F.col("text").alias("html"))
    back = {r.page_id: (r.payload_bytes, r.url) for r in warc.read_archives(warc.write_archives(warc.planned(pages), f"file://{tmp_path}/w")).collect()}
    assert back == {k: (len(t), "http://a.org/" + t.replace("\n", " ")) for k, t in rows}
    got = {r.page_id: r for r in url_filter.judged(pages, spark.createDataFrame([], "u string")).collect()}
    assert got[1].path == "/" + long and got[1].rule == "org/"
    assert {r.doc_id: r.component_id for r in prefix_tree_join.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    bench = spark.createDataFrame([(9, " ".join(long.split()[-30:]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(df, bench).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r.doc_id for r in mixing.mixed(df, share=(30, 10)).collect()} == {1, 2, 3, 4}
    near = {r.doc_id: r for r in merkle.edited_fingerprints(df).collect()}
    assert near[2].n_chars == len(rows[1][1]) and near[2].near_next > 0.99
    scored = {r.doc_id: r for r in context_tree.scores(df, bucket_bytes=1 << 19).collect()}
    assert scored[1].n_tokens == 250_001 and scored[4].score < scored[1].score < scored[3].score < 0


# 10: context trees


def brute_ctw(train, texts, depth):
    """Log10 probability of each text under frozen counts, node by node."""

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    counts: dict[tuple[bytes, int], list[int]] = {}

    def paths(text):
        data = bytes(depth) + text.encode() + b"\xff"
        for i in range(depth, len(data)):
            ctx = data[i - depth : i]
            for j in range(8):
                yield ctx, (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1

    for t in train:
        for ctx, node, bit in paths(t):
            for d in range(depth + 1):
                counts.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
    children: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))
    memo: dict[tuple[bytes, int], float] = {}

    def pw(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(key[0]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(pw(x) for x in children[key]))
        return memo[key]

    def one(ctx, node):
        def at(d):
            key = (ctx[depth - d :], node)
            if key not in counts:
                return 0.5
            a, b = counts[key]
            p = (b + 0.5) / (a + b + 1)
            if d == depth:
                return p
            q = math.exp(math.log(0.5) + kt(a, b) - pw(key))
            return q * p + (1 - q) * at(d + 1)

        return at(0)

    return [sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in paths(t)) for t in texts]


@pytest.mark.parametrize(("depth", "bucket"), [(3, 1 << 20), (5, 900)])
def test_context_tree_equals_brute_force(spark, depth, bucket):
    rng = random.Random(11)
    rows = [(k, sentence(rng, rng.randrange(0, 25), 12) + rng.choice(["", " é漢.", "\n"])) for k in range(60)] + [(60, None), (61, ""), (62, "zz Zz"), (62, "zz Zz"), (None, "null id")]
    df = docs_of(spark, rows).withColumn("score", F.lit("x"))
    got = sorted(((r.doc_id, r) for r in context_tree.scores(df, depth=depth, bucket_bytes=bucket).collect()), key=lambda x: str(x[0]))
    train = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    ordered = sorted(rows, key=lambda r: str(r[0]))
    count = Counter(w for t in train for w in [*words(t), "\0end"])
    n, v = sum(count.values()), len(count)
    want = brute_ctw(train, [t or "" for _, t in ordered], depth)
    assert len(got) == len(rows)
    for (i, r), (j, t), score in zip(got, ordered, want, strict=True):
        tokens = [*words(t), "\0end"]
        assert i == j and r.n_tokens == len(tokens) and r.n_known == sum(count[w] > 0 for w in tokens) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(score, rel=1e-5)
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 10 == 0)
    assert context_tree.scores(df.limit(0)).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.0, 1e6, 3e9])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_short_frequent_items_are_searched_once():
    """Very many items of one word, a document of that word alone, and items that repeat a text: no list of all pairs is made."""
    none = np.zeros(0, np.int64)
    probe = decontaminate.Probe([(str(k), "yes") for k in range(20_000)] + [("long", "a b c d e f g h i j k"), ("again", "A b c d e f g h i j k")], 10)
    counts, (doc, start, end), found = decontaminate._search(pa.array(["yes " * 200_000, "no yes", None, "x a b c d e f g h i j k y"]), probe, (none, none, none))
    assert counts.tolist() == [200_000, 2, 0, 13]
    assert (doc.tolist(), start.tolist(), end.tolist()) == ([0, 1, 3], [0, 1, 1], [200_000, 2, 12])
    assert [(d, len(ks)) for d, ks in found] == [(0, 20_000), (1, 20_000), (3, 2)]


def test_very_many_licence_sentences(spark):
    """The numbers of sentences are found in one pass: wrapped ones count their inner line ends too."""
    text = "Released under the MIT License.\nother\nReleased under the\nMIT License.\n" * 3000
    found = licences.licence_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert [x.at for x in found] == [x for k in range(3000) for x in (4 * k, 4 * k + 2)]
