"""N-gram Jaccard self-join: ordered n-gram sets in prefix trees.

1. Each document becomes the set of its distinct word n-grams, as 64-bit keys in one global
   order: rare n-grams first (by digest), frequent ones last (by frequency).  Tasks count in
   chunks of at least 10 / ``common`` documents (or ``CHUNK_BYTES`` of text) and report
   n-grams in more than half that share of a chunk: one that is above the share ``common``
   overall can't have more than half of it outside such chunks, so it is found; and at most
   2 * average set size / ``common`` n-grams can be above half, which bounds what is
   broadcast.  (Where chunks end by bytes, the share that is found is 2 documents of a chunk.)
2. Documents with equal sets are one class; only classes go on.
3. Two sets at the threshold share a key among the first n - ceil(t * n) + 1 of each.  Classes
   are grouped by such keys; keys with the same classes are one group.
4. Within a group, a parity bitmap of each set (about one bit for each member) bounds the
   size of the difference from below, exactly: pairs beyond the bound can't be links.  What
   remains makes small candidate clusters; no pair list is emitted, only spanning links.
5. Full sets go once to their cluster.  There they are stored in a prefix tree; a search
   shares the overlaps of common prefixes, and drops a subtree as soon as the overlap so
   far and the lengths that remain can't reach the threshold.  Sets already in one
   component are not compared again.
6. Links of classes give components; every document takes its class's.

A group or cluster above ``block`` classes first meets one of them, its hub: a row's work
each, in any number of tasks.  Those that link with the hub are one component by that, so
only the others are compared with all, in tasks of two blocks each.  A family of near copies
costs what its members cost; what no hub ties together is the only part that grows with the
product of the two.

Keys and class names are 64-bit digests.  A wrong overlap needs a collision within the two
sets that are compared (about n * m / 2**63 for sets of n and m); a wrong merge of classes a
collision of names (about classes**2 / 2**65).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .shared import components, small, small_batches, written
from .textbytes import NOT_SPACE, Words, group_rows, release, runs, slices, tidied

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 32 << 20
#: Hubs of large groups go to all tasks up to this size.
HUB_BYTES = 8 << 20
TOP = np.uint64(1 << 63)


def ngram_sets(texts, n: int):
    """The distinct n-grams of each text, as ascending digests; fewer words: the whole sequence as one."""
    for begin, end in slices(texts, SLICE_BYTES):
        words = Words(texts.slice(begin, end - begin), NOT_SPACE)
        grams = runs(words.digest, n)
        for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield runs(words.digest[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def frequent_ngrams(docs: DataFrame, text_col: str, n: int, common: float) -> np.ndarray:
    """Digests of the frequent n-grams, from the least to the most frequent."""
    least = int(10 / common)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = size = 0

        def report():
            grams, times = _added(held)
            many = times > max(1 if rows * common < 4 else 0, common * rows / 2)
            return pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(times[many])], names=["gram", "n"])

        for batch in batches:
            for begin, end in slices(batch.column(0), SLICE_BYTES):
                part = batch.column(0).slice(begin, end - begin)
                held.append(np.unique(np.concatenate(list(ngram_sets(part, n))), return_counts=True))
                if len(held) >= 8:
                    held = [_added(held)]
                rows, size = rows + end - begin, size + part.nbytes
                if rows >= least or size >= CHUNK_BYTES:
                    yield report()
                    held, rows, size = [], 0, 0
        if rows:
            yield report()

    total = docs.count()
    # chunks end with their task: few enough tasks, so that they are large enough
    tasks = max(1, total // least)
    seen = docs.select(text_col).coalesce(tasks).mapInArrow(tidied(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = seen.filter(F.col("n") > max(3, int(common * total / 2))).orderBy("n", "gram").select("gram").toArrow()
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64)


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*pairs, strict=True))
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, counts, len(names)).astype(np.int64)


class Order:
    """Global order of n-grams: rare ones by digest, then frequent ones by frequency."""

    def __init__(self, frequent: np.ndarray):
        by = np.argsort(frequent)
        self.names, self.place = frequent[by], by.astype(np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        out = grams >> np.uint64(1)
        if len(self.names) and len(grams):
            at = np.searchsorted(self.names, grams)
            at[at == len(self.names)] = 0
            hit = self.names[at] == grams
            out[hit] = TOP | self.place[at[hit]]
            if hit.any():
                out.sort()
        return out


def prefix_size(n: int, percent: int) -> int:
    """Keys of which a set of size n must share one with every similar set."""
    return n - (percent * n + 99) // 100 + 1


def required(n: int, m: int, percent: int) -> int:
    """The least overlap of similar sets of n and m members."""
    return -((-percent * (n + m)) // (100 + percent))


def bitmap(keys: np.ndarray) -> bytes:
    """Bit i: the parity of the number of keys that fall on i. 64 bits at least, n at least."""
    size = max(64, 1 << int(len(keys) - 1).bit_length())
    odd = np.bincount((keys.view(np.int64) & (size - 1)), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def difference_at_least(a: int, bits_a: int, b: int, bits_b: int) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their bitmaps."""
    while bits_a > bits_b:
        bits_a >>= 1
        a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
    while bits_b > bits_a:
        bits_b >>= 1
        b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
    return (a ^ b).bit_count()


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Node:
    __slots__ = ("children", "depth", "high", "low", "seg", "sets")

    def __init__(self, seg: np.ndarray, depth: int):
        self.seg, self.depth = seg, depth
        self.children: dict[int, Node] = {}
        self.sets: list[tuple[int, int]] = []
        self.low, self.high = 1 << 62, 0


class PrefixTree:
    """Ordered sets with shared prefixes; runs of keys without a branch are one node."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = Node(np.zeros(0, np.uint64), 0)

    def add(self, name: int, keys: np.ndarray) -> None:
        node, at, n = self.root, 0, len(keys)
        node.low, node.high = min(node.low, n), max(node.high, n)
        while at < n:
            child = node.children.get(first := int(keys[at]))
            if child is None:
                child = node.children[first] = Node(keys[at:], n)
                child.low = child.high = n
                child.sets.append((name, n))
                return
            rest = keys[at:]
            m = min(len(rest), len(child.seg))
            differ = np.flatnonzero(rest[:m] != child.seg[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.seg):
                top = Node(child.seg[:same], at + same)
                top.low, top.high = child.low, child.high
                child.seg = child.seg[same:]
                top.children[int(child.seg[0])] = child
                node.children[first] = child = top
            child.low, child.high = min(child.low, n), max(child.high, n)
            node, at = child, at + same
        node.sets.append((name, n))

    def search(self, name: int, keys: np.ndarray, union: Union, found) -> None:
        """Calls ``found(name, other)`` for one similar set at least of every component that has one."""
        n, percent = len(keys), self.percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if not node.children and all(union.find(k) == union.find(name) for k, _ in node.sets):
                continue
            if len(seg := node.seg):
                i = np.searchsorted(keys, seg)
                inside = i < n
                overlap += int(np.count_nonzero(keys[i[inside]] == seg[inside]))
                at = int(np.searchsorted(keys, seg[-1], "right"))
            # the least size in the subtree asks for the least overlap
            if 100 * node.low < percent * n and 100 * node.high < percent * n or 100 * n < percent * node.low:
                continue
            if overlap + min(n - at, node.high - node.depth) < required(n, max(node.low, -(-percent * n // 100)), percent):
                continue
            for other, m in node.sets:
                if 100 * overlap >= percent * (n + m - overlap) and union.find(other) != union.find(name):
                    found(name, other)
            stack.extend((child, overlap, at) for child in node.children.values())


def _tasks(rows: DataFrame, block: int, similar) -> tuple[DataFrame, DataFrame]:
    """Tasks (g, i, j) of rows (g, size, cls, n, data), and the links that hubs of large groups make.

    A small group is one task.  Of a large one, all rows meet the hub; then blocks of those
    that it doesn't tie (side 0) meet blocks of all rows (side 1).
    """
    few = rows.filter(F.col("size") <= block).select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.lit(False).alias("tied"), "cls", "n", "data")
    large = rows.filter(F.col("size") > block)
    hubs = large.groupBy("g").agg(F.min(F.struct("cls", "n", "data")).alias("h")).select("g", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.data").alias("hub_data"))

    def star(batches):
        for batch in batches:
            of = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            tied = [a == h or similar(n, d.as_buffer(), m, e.as_buffer()) for a, n, d, h, m, e in zip(of["cls"].to_pylist(), of["n"].to_pylist(), of["data"], of["hub"].to_pylist(), of["hub_n"].to_pylist(), of["hub_data"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(of[c] for c in ("g", "size", "cls", "n", "data", "hub")), pa.array(tied, pa.bool_())], names=["g", "size", "cls", "n", "data", "hub", "tied"])

    hubs = written(hubs, "hubs")
    size = hubs.agg(F.sum(F.octet_length("hub_data"))).first()[0] or 0
    met = large.join(F.broadcast(hubs) if size <= HUB_BYTES else hubs, "g").select("g", "size", "cls", "n", "data", "hub", "hub_n", "hub_data")
    met = written(met.mapInArrow(tidied(star), "g bigint, size bigint, cls bigint, n int, data binary, hub bigint, tied boolean"), "met")
    links = met.filter("tied and cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    loose = met.filter("not tied").groupBy("g").agg(F.count("*").alias("u"))
    open_ = met.join(small(loose), "g").withColumn("k", F.ceil(F.col("size") / block).cast("int")).withColumn("o", F.ceil(F.col("u") / block).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = open_.withColumn("i", upto("o")).withColumn("j", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).withColumn("side", F.lit(1))
    others = open_.filter("not tied").withColumn("j", upto("k")).withColumn("i", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("o")).cast("int")).withColumn("side", F.lit(0))
    out = few
    for part in (every, others):
        out = out.unionByName(part.select("g", "i", "j", "side", "tied", "cls", "n", "data"))
    return out.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j"), links


class Group:
    """The rows of one task in the order of their sizes, and what is known to be one component."""

    def __init__(self, table: pa.Table, make):
        cols = (table.column(c).to_pylist() for c in ("n", "cls", "side", "tied"))
        self.rows = sorted(((n, a, side, tied, make(d.as_buffer())) for n, a, side, tied, d in zip(*cols, table.column("data"), strict=True)), key=lambda r: r[:3])
        self.union = Union()
        self.paired = any(r[2] for r in self.rows)
        tied = [r[1] for r in self.rows if r[3]]
        for name in tied[1:]:
            self.union.join(tied[0], name)
        self.a: list[int] = []
        self.b: list[int] = []

    def found(self, a: int, b: int) -> None:
        if self.union.join(a, b):
            self.a.append(a)
            self.b.append(b)

    def links(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.a, pa.int64()), pa.array(self.b, pa.int64())], names=["a", "b"])


def _close(n: int, m: int, percent: int) -> bool:
    return 100 * min(n, m) >= percent * max(n, m)


def maps_allow(percent: int):
    """Whether bitmaps leave two sets a chance to be similar."""

    def similar(n: int, data, m: int, other) -> bool:
        return _close(n, m, percent) and difference_at_least(int.from_bytes(data, "little"), 8 * len(data), int.from_bytes(other, "little"), 8 * len(other)) <= n + m - 2 * required(n, m, percent)

    return similar


def sets_similar(percent: int):
    def similar(n: int, data, m: int, other) -> bool:
        if not _close(n, m, percent):
            return False
        both = len(np.intersect1d(np.frombuffer(data, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True))
        return 100 * both >= percent * (n + m - both)

    return similar


def _candidate_links(batches, percent: int):
    """Spanning links of the pairs of each group that their bitmaps don't rule out."""
    for table in group_rows(batches, ["g", "i", "j"]):
        group = Group(table, lambda d: (int.from_bytes(d, "little"), 8 * len(d)))
        left = [r for r in group.rows if not r[2]]
        right = [r for r in group.rows if r[2]] if group.paired else left
        sizes = [r[0] for r in right]
        for x, (n_x, name_x, _, _, (map_x, size_x)) in enumerate(left):
            most = n_x * 100 // percent
            begin = bisect_left(sizes, -(-percent * n_x // 100)) if group.paired else x + 1
            for n_y, name_y, _, _, (map_y, size_y) in right[begin:]:
                if n_y > most:
                    break
                if group.union.find(name_x) != group.union.find(name_y) and difference_at_least(map_x, size_x, map_y, size_y) <= n_x + n_y - 2 * required(n_x, n_y, percent):
                    group.found(name_x, name_y)
        yield group.links()


def _tree_links(batches, percent: int):
    """Spanning links of the similar pairs of each cluster."""
    for table in group_rows(batches, ["g", "i", "j"]):
        group = Group(table, lambda d: np.frombuffer(d, np.uint64))
        tree = PrefixTree(percent)
        if group.paired:
            for _, name, side, _, keys in group.rows:
                if side:
                    tree.add(name, keys)
        for _, name, side, _, keys in group.rows:
            if not side:
                tree.search(name, keys, group.union, group.found)
                if not group.paired:
                    tree.add(name, keys)
        yield group.links()


def near_duplicates(docs: DataFrame, *, n: int = 4, percent: int = 85, common: float = 0.002, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ngrams, component_id for each document.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  Two documents
    link when 100 * intersection >= ``percent`` * union of their sets of distinct n-grams;
    with fewer than n words, the whole sequence is the one member.  component_id is the
    smallest id that links reach, the own one included.

    Null or empty text, or text without words: an empty set, linked with nothing, not even
    with another empty one.  A null id links as others do and is never the smallest; if a
    component has no other, its component_id is null.  Repeated rows come out as often as
    they go in.  Empty table: no rows.  Other columns are not read.
    """
    rows = _linked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, percent, common, block)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_ngrams"), F.when(F.col("keeper").isNotNull(), F.col("keeper.id")).otherwise(F.col("doc_id")).alias("component_id"))


def _linked(docs: DataFrame, n: int, percent: int, common: float, block: int) -> DataFrame:
    """doc_id, h (a hash of the text), n, and keeper: the first (none, id, h) of the component; null for empty sets."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.withColumn("h", F.xxhash64("text"))
    frequent = spark.sparkContext.broadcast(frequent_ngrams(docs, "text", n, common))

    def sets(batches, full: bool = False):
        order = Order(frequent.value)
        for batch in batches:
            release()
            size, name, prefix, bits = [], [], [], []
            for grams in ngram_sets(batch.column(1), n):
                keys = order.keys(grams)
                size.append(len(keys))
                name.append(int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True))
                if full:
                    prefix.append(keys.tobytes())
                else:
                    prefix.append(keys[: prefix_size(len(keys), percent)].view(np.int64) if len(keys) else None)
                    bits.append(bitmap(keys) if len(keys) else None)
            cols = [batch.column(0), batch.column(2), pa.array(size, pa.int32()), pa.array(name, pa.int64())]
            if full:
                yield pa.RecordBatch.from_arrays([cols[3], pa.array(prefix, pa.large_binary()).cast(pa.binary())], names=["cls", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "h", "n", "cls", "prefix", "bits"])

    made = written(docs.select("doc_id", "text", "h").mapInArrow(tidied(sets), "doc_id bigint, h bigint, n int, cls bigint, prefix array<bigint>, bits binary"), "sets")
    members = made.select("doc_id", "h", "n", "cls")
    # the class's row: its first document, ids before nulls
    low = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    first = made.filter("n > 0").groupBy("cls").agg(F.min(low).alias("low"), F.count("*").alias("docs"), F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = written(first, "classes")

    # one window finds keys of two classes or more, and names a key by the classes that have it
    posted = classes.select("cls", "n", F.explode("prefix").alias("key"))
    by_key = W.partitionBy("key")
    shared = posted.withColumn("many", F.count("*").over(by_key)).filter("many > 1").withColumn("g", F.bit_xor(F.xxhash64("cls")).over(by_key))
    groups = shared.groupBy("g", "many", "cls").agg(F.min("n").alias("n"))
    groups = written(groups, "groups").join(classes.select("cls", F.col("bits").alias("data")), "cls").withColumnRenamed("many", "size")
    tasks, near = _tasks(groups, block, maps_allow(percent))
    near = near.union(tasks.mapInArrow(tidied(lambda b: _candidate_links(b, percent)), "a bigint, b bigint"))
    cluster = components(near)

    ids = cluster.join(classes.select(F.col("cls").alias("node"), "low"), "node")
    key = lambda c: F.coalesce(c, F.lit(-1)).cast("string")
    bloom = BlockedBloom.of(ids.select(key(F.col("low.id")).alias("k")), "k")
    # one Python worker a task: it looks keys up and makes the sets of what it keeps
    keep = bloom.keeper("k")
    asked = docs.filter("text is not null").select("doc_id", "text", "h", key(F.col("doc_id")).alias("k"))
    full = asked.mapInArrow(tidied(lambda b: sets(keep(b), True)), "cls bigint, keys binary").groupBy("cls").agg(F.first("keys").alias("data"))
    size = cluster.groupBy("root").agg(F.count("*").alias("size"))
    held = cluster.join(size, "root").select(F.col("node").alias("cls"), F.col("root").alias("g"), "size").join(full, "cls").withColumn("n", (F.octet_length("data") / 8).cast("int"))
    tasks, links = _tasks(held, block, sets_similar(percent))
    links = links.union(tasks.mapInArrow(tidied(lambda b: _tree_links(b, percent)), "a bigint, b bigint"))
    joined = components(links)
    first = joined.join(classes.select(F.col("cls").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("first"))
    reach = joined.join(first, "root").select(F.col("node").alias("cls"), "first")
    known = written(classes.select("cls", "low", "docs").join(reach, "cls", "left").select("cls", "docs", F.coalesce("first", "low").alias("keeper")), "known")
    return _told(members, known, made.count())


def _told(members: DataFrame, known: DataFrame, total: int, hot: int = 1000) -> DataFrame:
    """``members`` with their class's keeper.

    Classes that hold more than a ``hot``-th of all documents, fewer than ``hot`` of them, go
    to all tasks; the others' documents are dealt out by class, and rows that need no class by themselves.
    """
    much = total // hot
    top = known.filter(F.col("docs") > much).select(F.col("cls").alias("_c"), F.col("keeper").alias("_top"))
    rest = known.filter(F.col("docs") <= much).select(F.col("cls").alias("_d"), F.col("keeper").alias("_rest"), F.lit(False).alias("_alone"))
    rows = members.join(F.broadcast(top), (F.col("cls") == F.col("_c")) & (F.col("n") > 0), "left")
    alone = F.col("_top").isNotNull() | (F.col("n") == 0)
    rows = rows.withColumn("_alone", alone).withColumn("_d", F.when(alone, F.xxhash64("doc_id", "h")).otherwise(F.col("cls")))
    return rows.join(rest, ["_d", "_alone"], "left").select("doc_id", "h", "n", F.coalesce("_top", "_rest").alias("keeper"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80, common: float = 0.002, block: int = 2048) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, and all other rows, with their own columns.

    Rows are told apart by id and text: of rows that repeat both one stays, a text that only
    shares its id with a dropped one stays, and a group of null ids leaves one of them.
    Documents without words stay.  Only rows that may be among the dropped or the repeated
    ones are joined with those; the others don't move.
    """
    rows = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, percent, common, block).filter("keeper is not null")
    same = F.col("doc_id").eqNullSafe(F.col("keeper.id")) & (F.col("h") == F.col("keeper.h"))
    # distinct ids and texts of dropped rows, and of kept ones that come more than once
    marks = rows.groupBy("doc_id", "h").agg(F.max(~same).alias("gone"), F.count("*").alias("times")).filter("gone or times > 1")
    key = lambda: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_h").cast("string"))
    marks = written(marks.withColumnRenamed("h", "_h").select(key().alias("_k"), "gone"), "marks")
    marked = docs.withColumn("_h", F.xxhash64("text")).withColumn("_key", key())
    marked = BlockedBloom.of(marks, "_k").flagged(marked, "_key", "_maybe")
    apart = marked.filter("not _maybe").select(*docs.columns)
    some = marked.filter("_maybe").join(marks, F.col("_key") == F.col("_k"), "left")
    clear = some.filter("gone is null").select(*docs.columns)
    again = some.filter("not gone").dropDuplicates(["_key"]).select(*docs.columns)
    return apart.unionByName(clear).unionByName(again)


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n=4, percent=85).withColumnRenamed("n_ngrams", "n_shingles")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
