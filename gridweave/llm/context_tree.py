"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions.  For each decision and each context of 0 to ``depth``
preceding bytes there is a node with a Krichevsky-Trofimov estimate; the probability of a
node's data is half its own estimate's and half the product of its children's, which mixes
all depths by how well they have predicted.  After training, counts are frozen and each bit's
probability is that mixture along its path; a text ends with a byte that UTF-8 never has.

The work is two groupings.  Documents are cut into buckets of about ``bucket_bytes``; a
bucket lists its distinct byte strings of depth + 1 bytes, and its distinct words for the
unigram base, with their counts in training documents.  Shards of equal recent context
gather the lists of all buckets, add up the counts, build the tree below that context and
answer each bucket with the values it asked for; buckets then score their documents.  The
model thus lives in the shards and grows with the corpus; only the nodes of the two
shortest depths, at most 256 * 255 of them, are sent to all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, small_batches, written
from .textbytes import NOT_SPACE, Words, as_array, mix, slices

SLICE_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
#: Lists are merged when they hold about as many keys more than the first.
JOINED = 1_000_000
END = np.uint64(1)
HALF = math.log(0.5)
LISTS = "kind int, shard bigint, bucket bigint, keys binary, counts binary"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series of x + 12."""
    down = np.zeros_like(x)
    for k in range(12):
        down += np.log(x + k)
    y = x + 12
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a zeros and b ones, as a natural logarithm."""
    out = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)
    return np.where(a + b == 0, 0.0, out)


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit integers by byte planes, so that the shuffle's compression finds the empty ones."""
    x = x.astype(np.uint64)
    if ascending and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data, ascending: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


class Lookup:
    """Places of keys in a sorted array, by a table of slots; keys that lost their slot are searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[(keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        at = self.slot[(q * np.uint64(0x9E3779B97F4A7C15)) >> self.shift]
        lost = np.flatnonzero(self.keys[at] != q)
        if len(lost):
            at[lost] = np.searchsorted(self.keys, q[lost])
        return at


def byte_strings(texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The depth + 1 bytes that end at each byte of each text and at its end, as numbers, and their offsets by text."""
    texts = pc.fill_null(as_array(texts), "").cast(pa.large_binary())
    tail = pa.scalar(b"\xff" + bytes(depth), pa.large_binary())
    ended = pc.binary_join_element_wise(texts, tail, pa.scalar(b"", pa.large_binary()))
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64, len(ended) + 1, ended.offset * 8)
    raw = np.concatenate([np.zeros(depth, np.uint8), np.frombuffer(data, np.uint8)[at[0] : at[-1]]])
    n = len(raw) - depth
    keys = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        keys = (keys << np.uint64(8)) | raw[k : k + n]
    sizes = np.diff(at)
    inside = np.ones(n, bool)
    stops = at[1:] - at[0]
    for k in range(1, depth + 1):
        inside[stops - k] = False
    return keys[inside], np.concatenate([[0], np.cumsum(sizes - depth)])


def _parts(table: pa.Table, depth: int):
    """Slices of a bucket: byte strings and words with their offsets, and which rows train."""
    texts, train = as_array(table.column("text")), as_array(table.column("train")).to_numpy(zero_copy_only=False)
    for begin, end in slices(texts, SLICE_BYTES):
        part = texts.slice(begin, end - begin)
        keys, at = byte_strings(part, depth)
        words = Words(part, NOT_SPACE)
        yield train[begin:end], keys, at, words.digest, words.at, begin, end


def _count(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each is learnt."""
    all_, total = np.unique(keys, return_counts=True)
    if learnt.all():
        return all_, total
    some, n = np.unique(keys[learnt], return_counts=True)
    out = np.zeros(len(all_), np.int64)
    out[np.searchsorted(all_, some)] = n
    return all_, out


def _merge(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(pairs) == 1:
        return pairs[0]
    keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in pairs]) if pairs else np.zeros(0, np.int64)
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _joined(held: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists with another one, made one list when they are more than twice the first and some."""
    held = [*held, (keys, counts)]
    return [_merge(held)] if sum(len(k) for k, _ in held) > JOINED + 2 * len(held[0][0]) else held


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Byte strings go by the two bytes before the last one, words by their digest."""
    name = (keys >> np.uint64(8)) & np.uint64(0xFFFF) if kind == 0 else keys
    return (mix(name + np.uint64(kind)) % np.uint64(shards)).astype(np.int64)


def bucket_lists(table: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of one bucket, the distinct byte strings and words with their training counts; END counts texts."""
    strings, words = [], []
    for train, keys, at, digest, word_at, _, _ in _parts(table, depth):
        strings = _joined(strings, *_count(keys, np.repeat(train, np.diff(at))))
        words = _joined(words, *_count(digest, np.repeat(train, np.diff(word_at))))
        words = _joined(words, np.array([END]), np.array([int(train.sum())]))
    return [_merge(strings), _merge(words)]


def _by_shard(kind: int, keys: np.ndarray, shards: int):
    shard = shard_of(kind, keys, shards)
    by = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[by], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=False):
        yield int(shard[by[a]]), by[a:b]


class Tree:
    """Nodes at depths ``top`` to ``depth`` of the contexts in a shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        keys, counts = keys[counts > 0], counts[counts > 0].astype(float)
        ctx, byte = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
        names, zeros, ones = [], [], []
        for j in range(8):
            node = (1 << j) | (byte >> (8 - j))
            bit = (byte >> (7 - j)) & 1
            names.append((ctx << np.uint64(8)) | node.astype(np.uint64))
            zeros.append(counts * (1 - bit))
            ones.append(counts * bit)
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        name, a, b, below = np.concatenate(names), np.concatenate(zeros), np.concatenate(ones), None
        for d in range(depth, top - 1, -1):
            name, inverse = np.unique(name & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
            n = len(name)
            a, b = np.bincount(inverse, a, n), np.bincount(inverse, b, n)
            own = log_kt(a, b)
            if below is None:
                total, stop = own, np.ones(n)
            else:
                total = np.logaddexp(HALF + own, HALF + np.bincount(inverse, below, n))
                stop = np.exp(HALF + own - total)
            self.levels[d] = (name, stop, (b + 0.5) / (a + b + 1), a, b, total)
            below = total

    def log10(self, keys: np.ndarray, mass: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Of each byte string's last byte given the ones before. mass and rest: what shorter contexts say, by last context byte and node."""
        ctx, byte = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(keys))
        last = (ctx & np.uint64(255)).astype(np.int64)
        for j in range(8):
            node = (1 << j) | (byte >> (8 - j))
            p, r = mass[last, node].copy(), rest[last, node].copy()
            live = np.arange(len(keys))
            for d in range(self.top, self.depth + 1):
                name, stop, one = self.levels[d][:3]
                want = ((ctx[live] & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | node[live].astype(np.uint64)
                at = np.searchsorted(name, want)
                at[at == len(name)] = 0
                seen = name[at] == want if len(name) else np.zeros(len(want), bool)
                live, at = live[seen], at[seen]
                p[live] += r[live] * stop[at] * one[at]
                r[live] *= 1 - stop[at]
            p += 0.5 * r  # a node without data
            out += np.log10(np.where((byte >> (7 - j)) & 1, p, 1 - p))
        return out


def top_tables(rows) -> tuple[np.ndarray, np.ndarray]:
    """From (last byte, node, zeros, ones, log probability of the children) to what depths 0 and 1 say of each."""
    a, b, below = (np.zeros((256, 256)) for _ in range(3))
    for c, node, zeros, ones, total in rows:
        a[c, node], b[c, node], below[c, node] = zeros, ones, total
    seen = a + b > 0
    own = log_kt(a, b)
    total = np.where(seen, np.logaddexp(HALF + own, HALF + below), 0.0)
    stop1 = np.where(seen, np.exp(HALF + own - total), 0.0)
    a0, b0, below0 = a.sum(0), b.sum(0), total.sum(0)
    own0 = log_kt(a0, b0)
    stop0 = np.where(a0 + b0 > 0, np.exp(HALF + own0 - np.logaddexp(HALF + own0, HALF + below0)), 0.0)
    mass = np.broadcast_to(stop0 * (b0 + 0.5) / (a0 + b0 + 1), (256, 256)).copy()
    rest = np.broadcast_to(1 - stop0, (256, 256)).copy()
    mass += rest * stop1 * (b + 0.5) / (a + b + 1)
    return mass, rest * (1 - stop1)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of a shard's lists, a few lists at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for k, c in zip(as_array(table.column("keys")), as_array(table.column("counts")), strict=True):
        held = _joined(held, unpack(k.as_buffer(), True), unpack(c.as_buffer()).astype(np.int64))
    return _merge(held)


def scores(docs: DataFrame, *, depth: int = 5, held_mod: int = 10, held_rest: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each document.

    Learns from documents whose crc32(id as text) mod ``held_mod`` isn't ``held_rest``.
    score: log10 probability of the text's bytes and its end.  base_score: of its words
    (runs of anything but ASCII white space, A-Z lower-cased) and an end token under
    add-0.1 unigram counts.  Null or empty text: the end alone.  Null ids: held out.
    Repeated rows count, and come out, as often as they are there.  Empty table: no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(crc_mod(id_col, held_mod) == held_rest, F.lit(True))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~held).alias("train"))
    n_bytes = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    shards = max(1, math.ceil(buckets * 0.6))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long"))

    def lists(key, table):
        rows = [(kind, shard, key[0].as_py(), pack(keys[at], True), pack(counts[at])) for kind, (keys, counts) in enumerate(bucket_lists(table, depth)) for shard, at in _by_shard(kind, keys, shards)]
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:3]), *(pa.array(c, pa.binary()) for c in cols[3:])], names=["kind", "shard", "bucket", "keys", "counts"])

    listed = written(docs.groupBy("bucket").applyInArrow(lists, LISTS), "lists")

    def summary(key, table):
        keys, counts = _gathered(table)
        if key[0].as_py() == 1:
            return pa.table({"c": pa.array([-1], pa.int32()), "node": pa.array([-1], pa.int32()), "a": [float(counts.sum())], "b": [float((counts > 0).sum())], "t": [0.0]})
        name, _, _, a, b, total = Tree(keys, counts, depth, 2).levels[2]
        at, inverse = np.unique(name & np.uint64(0xFFFF), return_inverse=True)
        n = len(at)
        return pa.table({"c": (at >> np.uint64(8)).astype(np.int32), "node": (at & np.uint64(255)).astype(np.int32), "a": np.bincount(inverse, a, n), "b": np.bincount(inverse, b, n), "t": np.bincount(inverse, total, n)})

    # at most 256 * 255 rows, and one
    tops = listed.groupBy("kind", "shard").applyInArrow(summary, "c int, node int, a double, b double, t double").groupBy("c", "node").agg(F.sum("a"), F.sum("b"), F.sum("t")).collect()
    n_train, distinct = next(((int(r[2]), int(r[3])) for r in tops if r[0] == -1), (0, 0))
    sent = spark.sparkContext.broadcast(top_tables([r for r in tops if r[0] >= 0]))

    def answer(key, table):
        keys, counts = _gathered(table)
        kind = key[0].as_py()
        values = counts.astype(float) if kind == 1 else Tree(keys, counts, depth, 2).log10(keys, *sent.value)
        out = [values[np.searchsorted(keys, unpack(k.as_buffer(), True))].astype("<f8" if kind == 1 else "<f4").tobytes() for k in as_array(table.column("keys"))]
        return pa.table([table.column("kind"), table.column("shard"), table.column("bucket"), pa.array(out, pa.binary())], names=["kind", "shard", "bucket", "vals"])

    answered = listed.groupBy("kind", "shard").applyInArrow(answer, "kind int, shard bigint, bucket bigint, vals binary")

    def score(key, left, right):
        given = {(k, s): v for k, s, v in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), as_array(right.column("vals")), strict=True)} if right.num_rows else {}
        find, value = [], []
        for kind, (keys, _) in enumerate(bucket_lists(left, depth)):
            v = np.zeros(len(keys))
            for shard, at in _by_shard(kind, keys, shards):
                v[at] = np.frombuffer(given[kind, shard].as_buffer(), "<f8" if kind == 1 else "<f4")
            find.append(Lookup(keys))
            value.append(v)
        end = float(value[1][find[1](np.array([END]))[0]])
        below = n_train + 0.1 * (distinct + 1)
        base = np.log10((value[1] + 0.1) / below)
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, keys, at, digest, word_at, begin, stop in _parts(left, depth):
            doc = np.repeat(np.arange(stop - begin), np.diff(at))
            cols[3].append(np.bincount(doc, value[0][find[0](keys)], stop - begin))
            cols[4].append(np.diff(at))
            place = find[1](digest)
            doc = np.repeat(np.arange(stop - begin), np.diff(word_at))
            cols[0].append(np.diff(word_at) + 1)
            cols[1].append(np.bincount(doc, value[1][place] > 0, stop - begin).astype(np.int64) + int(end > 0))
            cols[2].append(np.bincount(doc, base[place], stop - begin) + math.log10((end + 0.1) / below))
        n, known, b, s, size = (np.concatenate(c) for c in cols)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": pc.invert(as_array(left.column("train"))), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), n_train), "base_score": b, "score": s, "bits_per_byte": -s / size * math.log2(10)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return docs.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(score, out)


def op10_context_tree(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
