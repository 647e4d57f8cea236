"""The prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is cut into blocks of ``WIDTH`` turns, one row a block with a column for each
place.  One ``GROUP BY block, prior, ROLLUP (t1, ..., t8)`` aggregates the prefixes of all
lengths in all blocks together; ``grouping_id()`` tells a prefix's length.  ``prior`` is the
node at which the block before ended, named by what leads there (an XOR of 120-bit digests
of each place and turn, so its parts are summed in any order), so that long conversations
need no rounds.  A second ROLLUP sums over subtrees: every node counts at its smallest
member, which lies below all of the node's ancestors.

Turns, nodes and texts are equal when their digests (120 or 128 bits) are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .histogram_sort import CRC, CRC_TABLE
from .shared import placed, written

#: Turns of a block, members whose ids are joined in one row before and after, and places summed in one group.
WIDTH, FEW, MANY, CHUNK = 8, 64, 4096, 1024
EMPTY = hashlib.sha256().hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """The name of a turn: half of the SHA-256 digest of role and text. Null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 32))


def _share(half: int) -> Column:
    """What a turn at its place adds to the names of the prefixes that hold it: 60 bits of a digest."""
    digest = F.sha2(F.concat("turn", F.col("place").cast("string").cast("binary")), 256)
    return F.conv(F.substring(digest, 1 + 15 * half, 15), 16, 10).cast("long")


def _running(rows: DataFrame, key: str, place: str, made: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """Adds to each row the aggregates ``made`` of its key's rows at smaller places, and folds in those of earlier chunks.

    Places are whole numbers; a key of any size is cut into chunks of ``CHUNK`` places.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    sums = rows.groupBy(key, "_chunk").agg(*(x.alias(f"_{n}") for n, x in total.items()))
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    fold = {n: (F.bit_xor if n.startswith("p") else F.sum)(f"_{n}") for n in made}
    sums = sums.select(F.col(key), "_chunk", *(fold[n].over(earlier).alias(f"_{n}") for n in made)).filter("_chunk > 0")
    within = W.partitionBy(key, "_chunk").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(x.over(within), F.lit(0)).alias(n) for n, x in made.items()))
    both = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(0)).bitwiseXOR(F.col(n)) if n.startswith("p") else F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.col(n)
    return rows.join(sums, [key, "_chunk"], "left").withColumns({n: both(n).cast("long") for n in made}).drop("_chunk", *(f"_{n}" for n in made))


def blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, block, p1, p2, t1.., n, names, bytes, last): a row for each block, one at least for each conversation.

    p1, p2 name the node at which the block begins, ``names`` those of it and of the block's ``n`` turns.
    """
    at = lambda name, i: F.max(F.when(F.col("place") % WIDTH == i, F.col(name)))
    turns = turns.withColumns({"x1": _share(0), "x2": _share(1), "block": F.floor(F.col("place") / WIDTH)})
    rows = turns.groupBy("conv_id", "block").agg(F.count("*").cast("int").alias("n"), *(at(c, i).alias(f"{a}{i + 1}") for c, a in (("turn", "t"), ("bytes", "b"), ("x1", "x1_"), ("x2", "x2_")) for i in range(WIDTH)))
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / WIDTH)
    rows = members.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), last.alias("_last")).join(rows, ["conv_id", "block"], "left")
    share = {h: [F.coalesce(F.col(f"x{h}_{i + 1}"), F.lit(0)) for i in range(WIDTH)] for h in (1, 2)}
    rows = rows.withColumns({f"_x{h}": reduce(Column.bitwiseXOR, share[h]) for h in (1, 2)})
    totals = {f"p{h}": F.bit_xor(f"_x{h}") for h in (1, 2)}
    rows = _running(rows, "conv_id", "block", totals, totals)
    names = [F.struct(*(reduce(Column.bitwiseXOR, share[h][:j], F.col(f"p{h}")).alias(f"k{h}") for h in (1, 2))) for j in range(WIDTH + 1)]
    lengths = F.array(F.lit(0).cast("long"), *(F.coalesce(f"b{i + 1}", F.lit(0)) for i in range(WIDTH)))
    return rows.select("conv_id", "block", "p1", "p2", *(f"t{i + 1}" for i in range(WIDTH)), F.coalesce("n", F.lit(0)).alias("n"), F.array(*names).alias("names"), lengths.alias("bytes"), (F.col("block") == F.col("_last")).alias("last"))


_TURNS = ", ".join(f"t{i + 1}" for i in range(WIDTH))
#: The first ROLLUP finds the nodes, the second sums over their subtrees.
NODES_SQL = f"SELECT block, min(conv_id) AS conv_id, grouping_id() AS gid, count(*) AS n_convs FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP ({_TURNS})"
SUMS_SQL = f"SELECT block, min(conv_id) AS conv_id, grouping_id() AS gid, min(n) AS n, sum(leaf) AS n_leaves, sum(owned) AS owned FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP ({_TURNS})"


def _level(rolled: DataFrame) -> DataFrame:
    """With the number of a prefix's turns in its block; the empty prefix of a later block is a node of the block before it."""
    return rolled.withColumn("level", (F.lit(WIDTH) - F.bit_count("gid")).cast("int")).filter("level > 0 OR block = 0").withColumn("depth", F.col("block") * WIDTH + F.col("level")).drop("gid")


def found_nodes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, u1, u2, n_convs, bytes): the nodes, their names and their parents', and their last turn's bytes.

    Grouping columns that reach beyond the smallest member's end are no prefix.
    """
    nodes = _level(rows.sparkSession.sql(NODES_SQL, blocks=rows)).join(rows.select("conv_id", "block", "n", "names", "bytes"), ["conv_id", "block"]).filter("level <= n")
    here, up = F.element_at("names", F.col("level") + 1), F.when(F.col("level") > 0, F.element_at("names", F.greatest("level", F.lit(1))))
    return nodes.select("conv_id", "depth", here["k1"].alias("k1"), here["k2"].alias("k2"), up["k1"].alias("u1"), up["k2"].alias("u2"), "n_convs", F.element_at("bytes", F.col("level") + 1).alias("bytes"))


def ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the ids of the conversations that end at a node.

    Ids are joined in two steps by ranges of ids, so that a node at which very many end is
    spread; its digest, which is sequential, is then fed with its few joined rows, one at a time.
    """
    rows = rows.filter("last").select(F.element_at("names", F.col("n") + 1).alias("_node"), "conv_id").select("_node.*", "conv_id")
    few = rows.groupBy("k1", "k2", F.floor(F.col("conv_id") / FEW).alias("c")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    many = few.groupBy("k1", "k2", F.floor(F.col("c") * FEW / MANY).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"]), ",").alias("ids"))

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
                if (k1, k2) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    many = many.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c").drop("c")
    return many.mapInPandas(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations; see ``op12_prefix_rollup`` for its columns.

    turns: conv_id (long), place (from 0, gapless), turn (``turn_digest``), bytes.  members:
    conv_id, length; a turnless one ends at the root.  No members: no nodes, not even a root.
    """
    spark = turns.sparkSession
    rows = written(blocks(turns, members), "blocks")
    nodes = written(found_nodes(rows).withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    owners = nodes.groupBy("conv_id").agg(F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.sum("weight").alias("owned"))
    sums = _level(spark.sql(SUMS_SQL, blocks=rows.join(owners, "conv_id", "left"))).filter("level <= n").select("conv_id", "depth", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("owned", F.lit(0)).alias("owned"))
    nodes = _running(nodes, "conv_id", "depth", {"above": F.sum("weight")}, {"above": F.sum("weight")})
    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends(rows), ["k1", "k2"], "left").join(parents, ["u1", "u2"], "left")
    saved = (F.col("owned") - F.col("above")).alias("saved_tokens")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def ordered_turns(conversations: DataFrame, *columns: str) -> DataFrame:
    """(conv_id, place, turn, bytes): rows in the order of turn (null first), then role and the turn's digest; rows without conv_id belong to none."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select("conv_id", "_turn", "role", F.octet_length("text").cast("long").alias("bytes"), turn_digest(F.col("role"), F.col("text")).alias("turn"), *columns)
    return placed(rows, ["conv_id"], ["_turn", "role", "turn"]).select("conv_id", "place", "turn", "bytes", *columns)


def rebuilt(turns: DataFrame, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of every ``span``-th one: (turns, members) for ``prefix_trie``."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % span, "head": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("lent")), "base", "left").withColumn("lent", F.least("head", F.coalesce("lent", F.lit(0))))
    convs = written(convs, "conversations")
    lent = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base").filter("place < head")
    own = turns.join(convs.select("conv_id", "head", "lent"), "conv_id").filter("place >= head").withColumn("place", F.col("place") - F.col("head") + F.col("lent"))
    columns = ["conv_id", "place", "turn", "bytes"]
    return lent.select(columns).union(own.select(columns)), convs.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))


def node_texts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn; texts: conv_id, place, role, text of the rebuilt conversations. The root has none."""
    last = texts.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def op12_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens (bytes that the subtree's nodes share), ends_sha256.
    """
    return prefix_trie(*rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = f"""
WITH crc AS ({CRC_TABLE}),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format("conv_id::VARCHAR")} % 9 AS head FROM (SELECT DISTINCT conv_id FROM o), crc),
t AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN o ON o.conv_id = c.base WHERE place < head
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE place >= head),
l AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (role IS NOT NULL), []) AS turns FROM c LEFT JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM l)),
n AS (SELECT prefix, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
  CASE WHEN min(d) > 0 THEN prefix[1:len(prefix) - 1] END AS up, CASE WHEN min(d) > 0 THEN strlen(prefix[len(prefix)].text) ELSE 0 END AS bytes FROM p GROUP BY prefix),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.prefix = k.up),
s AS (SELECT above, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM (SELECT *, unnest(list_transform(range(depth + 1), lambda d: prefix[1:d])) AS above FROM a) GROUP BY above)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s ON s.above = a.prefix LEFT JOIN n u ON u.prefix = a.up
"""
