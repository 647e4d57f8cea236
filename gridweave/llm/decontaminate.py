"""Benchmark decontamination with suffix arrays over the training words.

Every task cuts its documents into shards, builds a suffix array over a shard's words and
binary-searches every test suffix in it.  The range of equal prefixes gives all verbatim
occurrences of a window and the longest verbatim match of the suffix with its places.  No
row leaves its task, so nothing is shuffled and a document with thousands of copies costs
what any other document costs.

The test set is the only thing sent to all tasks.  Its size is checked: beyond
``block_chars`` it is cut into blocks by a hash of the item.  One block at a time is
collected and sent; the documents with what it added to their columns are written before
the next, so that neither the driver nor a task holds more than one block.

Words are compared by 64-bit digests.  A wrong hit needs ten equal digests in a row of words
that aren't all equal: with d different words in a shard and the block, the chance that any
two of them share a digest is at most d * d / 2**65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textbytes import ALNUM, Words, release, slices, tidied

#: Bytes of text in a shard; its arrays take about 60 bytes a word.
SHARD_BYTES = 2 << 20
BLOCK_CHARS = 64_000_000
#: Bits of a rank where three words make a sort key, and where a very rich text leaves room for two.
THREE, TWO = 21, 31

MATCHES = "doc_id bigint, word_at bigint, n_words bigint, item_id string, item_word_at bigint"


def packing(most: int) -> tuple[int, int]:
    """(words in a sort key, bits of a word) for ranks up to ``most``."""
    return (3, THREE) if most < 1 << THREE else (2, TWO)


def suffix_array(rank: np.ndarray, depth: int, take: int = 3, bits: int = THREE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next ``depth`` words, and the sorted keys of the first ``take`` words.

    ``rank`` has a dense rank from 1 for each word, below 2**bits, and 0 between documents.
    The first sort takes ``take`` words at once; later ones double the depth, and only for
    stretches that are still equal.
    """
    n = len(rank)
    wide = np.concatenate([rank, np.zeros(take - 1, np.int64)])
    key = word = wide[:n]
    for k in range(1, take):
        # a document's end hides what follows it
        word = np.where(word > 0, wide[k : n + k], 0)
        key = (key << bits) | word
    order = np.argsort(key)
    keys = key[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    place = np.empty(n, np.int64)
    place[order] = np.repeat(first, np.diff(first, append=n))
    stops = np.flatnonzero(rank == 0)
    h = take
    while h < depth:
        size = np.diff(first, append=n)
        open_ = (size > 1) & (keys[first] & ((1 << bits) - 1) > 0) if h == take else size > 1
        if not open_.any():
            break
        at = np.repeat(first[open_], size[open_]) + _within(size[open_])
        pos = order[at]
        ahead = pos + h
        # positions beyond a document's end are equal there: copies end together
        end = np.append(stops, n)[np.searchsorted(stops, pos)]
        nxt = np.where(ahead < end, place[np.minimum(ahead, n - 1)], -1)
        group = place[pos]
        by = np.lexsort((nxt, group))
        order[at] = pos[by]
        g, x = group[by], nxt[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        starts = at[new]
        place[order[at]] = np.repeat(starts, np.diff(np.flatnonzero(new), append=len(by)))
        first = np.flatnonzero(place[order] == np.arange(n))
        h *= 2
    return order, keys


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)


class Probe:
    """Test items as words: every suffix, and how many words of it make a window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = [(k, t) for k, t in items if k is not None and t is not None]
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.ids = [k for k, _ in items]
        self.digest = words.digest
        counts = words.counts()
        self.item = np.repeat(np.arange(len(items)), counts)
        self.begin = words.at[:-1]
        ends = np.repeat(words.at[1:], counts)
        self.room = ends - np.arange(len(self.digest))
        #: words of the window that begins here; 0 if none does
        whole = np.repeat(counts, counts)
        self.need = np.where(self.room >= window, window, np.where((whole < window) & (self.room == whole), whole, 0))
        self.depth = int(counts.max(initial=0))


def _find(probe: Probe, rank: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each test suffix: the range of its window in the suffix array, the longest match and that range."""
    take, bits = packing(len(names))
    order, keys = suffix_array(rank, max(take, probe.depth), take, bits)
    q = len(probe.digest)
    at = np.searchsorted(names, probe.digest)
    at[at == len(names)] = 0
    test = np.where(names[at] == probe.digest, at + 1, 0) if len(names) else np.zeros(q, np.int64)
    test = np.append(test, np.zeros(3, np.int64))
    low, high, length = np.zeros(q, np.int64), np.full(q, len(order), np.int64), np.zeros(q, np.int64)
    win_low, win_high = np.zeros(q, np.int64), np.zeros(q, np.int64)
    live = np.arange(q)
    d = 0
    prefix = np.zeros(q, np.int64)
    while len(live):
        live = live[(probe.room[live] > d) & (test[live + np.minimum(d, probe.room[live])] > 0)]
        if not len(live):
            break
        if d < take:
            prefix[live] |= test[live + d] << ((take - 1 - d) * bits)
            lo = np.searchsorted(keys, prefix[live], "left")
            hi = np.searchsorted(keys, prefix[live] + (1 << ((take - 1 - d) * bits)), "left")
        else:
            lo, hi = _narrow(order, rank, low[live], high[live], d, test[live + d])
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        low[live], high[live] = lo, hi
        d += 1
        length[live] = d
        full = live[probe.need[live] == d]
        win_low[full], win_high[full] = low[full], high[full]
    return order, win_low, win_high, length, low, high


def _narrow(order, rank, low, high, d, word):
    """The part of each range whose suffixes have ``word`` at offset d."""

    def bound(strict: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            at = order[mid] + d
            have = np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)], 0)
            right = have <= word[open_] if strict else have < word[open_]
            a[open_[right]] = mid[right] + 1
            b[open_[~right]] = mid[~right]
        return a

    return bound(False), bound(True)


def _shard(texts) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, dense ranks with a 0 after each document, the ranks' digests, and each document's first place."""
    words = Words(texts, ALNUM)
    names, inverse = np.unique(words.digest, return_inverse=True)
    counts = words.counts()
    begin = words.at[:-1] + np.arange(len(counts))
    rank = np.zeros(len(words.digest) + len(counts), np.int64)
    rank[np.arange(len(words.digest)) + np.repeat(np.arange(len(counts)), counts)] = inverse + 1
    return words, rank, names, begin


def _search(texts, probe: Probe, marked: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """Of one shard: ``_hits`` with marked stretches; without, n_words by document and every occurrence of a window: document, place, size and item, one for each item."""
    if marked is not None:
        return _hits(texts, probe, marked)
    words, rank, names, begin = _shard(texts)
    order, low, high, *_ = _find(probe, rank, names)
    hit = np.flatnonzero(high > low)
    n = high[hit] - low[hit]
    place, suffix = order[np.repeat(low[hit], n) + _within(n)], np.repeat(hit, n)
    doc = np.searchsorted(begin, place, "right") - 1
    return words.counts(), doc, place - begin[doc], probe.need[suffix], probe.item[suffix]


def _hits(texts, probe: Probe, marked: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Of one shard: n_words by document, (document, begin, end) of hit stretches, and (document, items) of documents with hits.

    Suffixes with equal windows have one range in the suffix array, so each window's places
    are listed once, however many items have it: no more than there are words for each length
    of a window.  Words inside windows are counted by steps up and down, with ``marked``
    stretches (of earlier blocks) among them.  Items come from sets: windows with the same
    items are one set, and a document gathers each set once.
    """
    words, rank, names, begin = _shard(texts)
    counts = words.counts()
    order, low, high, *_ = _find(probe, rank, names)
    hit = np.flatnonzero(high > low)
    hit = hit[np.lexsort((probe.item[hit], probe.need[hit], low[hit]))]
    first = np.ones(len(hit), bool)
    first[1:] = (low[hit[1:]] != low[hit[:-1]]) | (probe.need[hit[1:]] != probe.need[hit[:-1]])
    window, one = np.cumsum(first) - 1, hit[first]
    n = high[one] - low[one]
    place = order[np.repeat(low[one], n) + _within(n)]
    doc_old, old_begin, old_end = marked
    steps = np.bincount(np.concatenate([place, begin[doc_old] + old_begin]), minlength=len(rank) + 1) - np.bincount(np.concatenate([place + np.repeat(probe.need[one], n), begin[doc_old] + old_end]), minlength=len(rank) + 1)
    inside = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]])
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)
    span_doc = np.searchsorted(begin, starts, "right") - 1

    # distinct items of each window, and windows with equal ones as one set
    new = np.ones(len(hit), bool)
    new[1:] = first[1:] | (probe.item[hit[1:]] != probe.item[hit[:-1]])
    item, of = probe.item[hit[new]], window[new]
    cuts = np.searchsorted(of, np.arange(len(one) + 1))
    sets: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    set_of = np.zeros(len(one), np.int64)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        mine = item[a:b]
        set_of[k] = sets.setdefault(hashlib.blake2b(mine.tobytes(), digest_size=16).digest(), len(held))
        if set_of[k] == len(held):
            held.append(mine)
    pairs = np.unique((np.searchsorted(begin, place, "right") - 1) * max(len(held), 1) + np.repeat(set_of, n))
    doc, which = np.divmod(pairs, max(len(held), 1))
    cuts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc)).tolist()
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a == 1:
            found.append((int(doc[a]), held[which[a]]))
        else:
            seen = np.zeros(len(probe.ids), bool)
            for w in which[a:b].tolist():
                seen[held[w]] = True
            found.append((int(doc[a]), np.flatnonzero(seen)))
    return counts, (span_doc, starts - begin[span_doc], ends - begin[span_doc]), found


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The test items, at least one block of them, each of about ``block_chars`` at most; collected when asked for."""
    items = bench.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).filter("k is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 if chars <= block_chars else 2 * math.ceil(chars / block_chars)
    for b in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)).collect()]


def contamination(docs: DataFrame, bench: DataFrame, *, window: int = 10, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, hit_spans, n_hit, items, n_items and contaminated added.

    Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
    lower-cased.  A window is ``window`` consecutive words of a test item; an item of fewer
    words, but not none, is one window.  hit_spans has the stretches of words inside any
    occurrence, as [start, end) pairs flattened; items the ids, sorted as strings.

    Null or empty text: no words, nothing hit.  Test items without id or text are left out;
    rows that repeat an item's id count as one item.  Repeated documents are each judged.
    Empty test set: nothing hit.  Columns of ``docs`` with the names of added ones are
    replaced; all others pass through, whatever their names.  Very long texts make a shard
    of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_words", "hit_spans", "n_hit", "items", "n_items", "contaminated")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    sent = None
    for items in _blocks(bench, bench_id, bench_text, block_chars):
        if sent is not None:
            # what the last block added is written before this one is sent
            out = written(out, "marked")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(items)

        def search(batches, sent=sent):
            probe = Probe(sent.value, window)
            for batch in batches:
                release()
                for begin, end in slices(batch.column(text_col), SHARD_BYTES):
                    part = batch.slice(begin, end - begin)
                    old = part.column("hit_spans")
                    flat = old.flatten().to_numpy(zero_copy_only=False)
                    sizes = np.diff(old.offsets.to_numpy()) // 2
                    counts, (doc, start, end_), found = _hits(part.column(text_col), probe, (np.repeat(np.arange(len(sizes)), sizes), flat[0::2], flat[1::2]))
                    offsets = 2 * np.searchsorted(doc, np.arange(len(counts) + 1))
                    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.column_stack([start, end_]).ravel(), pa.int64()))
                    names = part.column("items").to_pylist()
                    for i, ks in found:
                        names[i] = sorted({*names[i], *(probe.ids[k] for k in ks.tolist())})
                    cols = {"n_words": pa.array(counts, pa.int64()), "hit_spans": spans, "items": pa.array(names, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_arrays([cols.get(f.name, part.column(k)) for k, f in enumerate(part.schema)], names=part.schema.names)

        out = out.mapInArrow(tidied(search), out.schema)
    pairs = F.expr("aggregate(sequence(0, size(hit_spans) - 1, 2), 0L, (s, i) -> s + hit_spans[i + 1] - hit_spans[i])")
    out = out.withColumn("n_hit", F.when(F.size("hit_spans") > 0, pairs).otherwise(F.lit(0).cast("long")))
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def longest_matches(docs: DataFrame, bench: DataFrame, *, least: int = 10, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each shard and test suffix, the places of its longest verbatim match of at least ``least`` words.

    Suffixes that only continue a match one word later are left out.  Nulls, empty texts
    and empty tables: no rows, as in ``contamination``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = sent = None
    for items in _blocks(bench, bench_id, bench_text, block_chars):
        if sent is not None:
            found = written(found, "matches")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(items)

        def search(batches, sent=sent):
            probe = Probe(sent.value, least)
            for batch in batches:
                release()
                for begin, end in slices(batch.column(1), SHARD_BYTES):
                    part = batch.slice(begin, end - begin)
                    _, rank, names, first = _shard(part.column(1))
                    order, _, _, length, low, high = _find(probe, rank, names)
                    hit = np.flatnonzero(length >= least)
                    n = high[hit] - low[hit]
                    place, suffix = order[np.repeat(low[hit], n) + _within(n)], np.repeat(hit, n)
                    # not what begins one word earlier in both
                    at0 = suffix - probe.begin[probe.item[suffix]]
                    seen = set(zip(place.tolist(), suffix.tolist(), strict=True))
                    keep = np.array([(p - 1, s - 1) not in seen or z == 0 for p, s, z in zip(place.tolist(), suffix.tolist(), at0.tolist(), strict=True)], bool)
                    place, suffix, at0 = place[keep], suffix[keep], at0[keep]
                    doc = np.searchsorted(first, place, "right") - 1
                    ids = part.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(place - first[doc]), pa.array(length[suffix]), pa.array([probe.ids[k] for k in probe.item[suffix]], pa.string()), pa.array(at0)], names=["doc_id", "word_at", "n_words", "item_id", "item_word_at"])

        part = docs.mapInArrow(tidied(search), MATCHES)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the test set, with their own columns."""
    return contamination(docs, bench, **options).filter(~F.col("contaminated")).select(*docs.columns)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, bench)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []::VARCHAR[]) AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT r, grams.i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
spots AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (r) LEFT JOIN found USING (r)
"""
