"""Mixing of sources to target weights by hierarchical budgets.

A tree of domain, language and source has a weight on every node.  The token budget flows
from the root: siblings share their parent's budget by weight; a node that holds fewer
tokens than its share (times the epochs allowed) passes the shortage to its siblings, and
only what a whole family can't take is shared out one level up.  Each leaf then takes whole
epochs, and of one more epoch, in seeded order, the longest prefix of documents that fits.

The order of a leaf is never held in one task: documents fall into 256 slots by the beginning
of their seeded hash, and slots are summed; the slot in which the budget ends is cut into 256
again, and only the one of those in which it ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import small, written

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a slot, and how often the slot with the end is cut.
SLOT_DIGITS, CUTS = 2, 2
WORD = r"[^\x20\x09-\x0D]+"

#: Weights by level and name; a node without one has weight 1.
WEIGHTS = {
    "domain": {"web": 40, "books": 30, "code": 20, "reference": 10},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {},
}
#: Domain of a source by the remainder of its number by four; sources without a number are reference.
DOMAINS = ("web", "books", "code", "reference")


def domain_of(source: Column) -> Column:
    n = F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")).cast("int") % 4
    return F.coalesce(F.when(n == 0, DOMAINS[0]).when(n == 1, DOMAINS[1]).when(n == 2, DOMAINS[2]), F.lit(DOMAINS[3]))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """``nodes`` (parents, node, weight, cap, budget of the parent) with alloc: the node's part.

    By weight, none above cap; what a node can't take goes to its siblings.  In the order of
    cap / weight, a node is full while its cap is within its share of what the earlier ones
    left; behind the first that isn't, all share by weight.  Whole tokens, rounded down.
    """
    keys = [F.col(p) for p in parents] or [F.lit(0)]
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    order = W.partitionBy(*keys).orderBy((F.col("cap").cast("double") / F.col("weight")), F.col(node))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = nodes.withColumn("cap0", F.coalesce(F.sum("cap").over(before), zero)).withColumn("w0", F.coalesce(F.sum("weight").over(before), zero))
    out = out.withColumn("wsum", F.sum("weight").over(W.partitionBy(*keys)))
    full = wide("cap") * (wide("wsum") - wide("w0")) <= (wide("budget") - wide("cap0")) * wide("weight")
    out = out.withColumn("full", full).withColumn("open", F.min(F.when(~F.col("full"), F.struct("cap0", "w0"))).over(W.partitionBy(*keys)))
    rest = F.expr("cast((cast(budget - open.cap0 as decimal(20,0)) * cast(weight as decimal(18,0))) div cast(wsum - open.w0 as decimal(20,0)) as bigint)")
    return out.withColumn("alloc", F.when(F.col("open").isNull() | (F.col("w0") < F.col("open.w0")), F.col("cap")).otherwise(F.least("cap", rest))).drop("cap0", "w0", "wsum", "full", "open")


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with alloc. One small row for each leaf; windows over siblings only."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    above = None
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, weights))
        nodes = nodes.join(above, parents) if above is not None else nodes.withColumn("budget", F.lit(budget).cast("long"))
        above = shared_out(nodes, parents, level).select(*parents, level, F.col("alloc").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "alloc"), list(LEVELS))


def mixed(docs: DataFrame, *, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = (6, 10), epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_domain=domain_of) -> DataFrame:
    """One row for each document that is taken: doc_id, domain, lang, source, n_tokens, copies, in_prefix.

    The budget is ``share`` (a fraction) of all tokens; tokens are runs of anything but
    ASCII white space.  copies counts the epochs that have the document; in_prefix says
    whether the last, partial one has.

    Null lang or source: a group named (none).  Null or empty text: no tokens; such a
    document is in every whole epoch, and in the prefix if it comes before its end.  The
    order is by a hash of seed, epoch, id and text, so that rows without an id, or with one
    that others have, lie apart by their texts; null ids hash as (none).  Repeated rows each
    count and each come out.  Empty table: no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), source_domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5"))
    rows = written(rows, "tokens")  # the words are counted once
    # leaves are few and small: written, so that each step's plan stays small on the driver
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0)
    leaves = leaf_budgets(leaves, total * min(share[0], epochs * share[1]) // share[1], weights, epochs)
    leaves = leaves.withColumn("epoch", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0)).cast("int"))
    leaves = leaves.withColumn("rest", F.col("alloc") - F.col("epoch") * F.col("tokens")).select(*LEVELS, "epoch", "rest", F.lit(0).cast("long").alias("from"))
    leaves = written(leaves, "budgets")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("(none)")), "text_md5"))
    open_ = rows.join(small(leaves), list(LEVELS)).withColumn("key", key)
    parts = []
    for k in range(CUTS):
        slot = F.substring("key", 1 + k * SLOT_DIGITS, SLOT_DIGITS)
        open_ = open_.withColumn("slot", slot)
        ends = _ends(open_)
        # before the slot with the end, or with none: in the prefix; behind it: not
        cut = open_.drop("from").join(small(ends), list(LEVELS), "left")
        parts.append(cut.filter("end is null or slot <> end").withColumn("in_prefix", F.coalesce(F.col("slot") < F.col("end"), F.lit(True))))
        open_ = cut.filter("slot = end").drop("end")
    inside = W.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    parts.append(open_.withColumn("in_prefix", F.col("from") + F.sum("n_tokens").over(inside) <= F.col("rest")))
    out = None
    for p in parts:
        # nothing is left behind whole epochs: no partial one, not even for documents without tokens
        p = p.withColumn("in_prefix", F.col("in_prefix") & ((F.col("epoch") == 0) | (F.col("rest") > 0))).withColumn("copies", F.col("epoch") + F.col("in_prefix").cast("int")).select("doc_id", *LEVELS, "n_tokens", "copies", "in_prefix")
        out = p if out is None else out.unionByName(p)
    return out.filter("copies > 0")


def _ends(rows: DataFrame) -> DataFrame:
    """By leaf, the first slot that the rest of its budget doesn't cover, and the tokens before it; leaves without one are left out."""
    slots = rows.groupBy(*LEVELS, "rest", "from", "slot").agg(F.sum("n_tokens").alias("n"))
    # at most 256 rows a leaf
    slots = slots.withColumn("until", F.col("from") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("slot")))
    ends = slots.filter("until > rest").groupBy(*LEVELS).agg(F.min(F.struct("slot", (F.col("until") - F.col("n")).alias("from"))).alias("e"))
    return written(ends.select(*LEVELS, F.col("e.slot").alias("end"), F.col("e.from").alias("from")), "ends")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def mixing_sql(table: str, seed: int = 7, share: tuple[int, int] = (6, 10), epochs: int = 3, weights=WEIGHTS) -> str:
    """Common table expressions m0 to m9 over ``table``; m9 has the rows."""
    w = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights[level].items()) + " ELSE 1 END" if weights[level] else "1"
    ctes = [
        f"""m0 AS (SELECT doc_id, coalesce(CASE TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' END, 'reference') AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM {table})""",
        f"mleaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {epochs} AS cap FROM m0 GROUP BY ALL)",
        f"mb0 AS (SELECT least(sum(cap), floor(sum(tokens) * {share[0]} / {share[1]}))::HUGEINT AS budget FROM mleaf)",
    ]
    for depth, level in enumerate(LEVELS):
        parents = ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN mb{depth} USING ({parents})" if parents else f", mb{depth}"
        cols = f"{parents}, {level}" if parents else level
        ctes += [
            f"mn{depth} AS (SELECT *, {w(level)} AS weight FROM (SELECT {cols}, sum(cap) AS cap FROM mleaf GROUP BY ALL) {join})",
            f"mo{depth} AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c0, coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS w0, (sum(weight) OVER ({by}))::HUGEINT AS ws, row_number() OVER q AS rn FROM mn{depth} WINDOW q AS ({by} ORDER BY cap::DOUBLE / weight, {level}))",
            f"mp{depth} AS (SELECT *, min(CASE WHEN cap * (ws - w0) > (budget - c0) * weight THEN rn END) OVER ({by}) AS o FROM mo{depth})",
            f"mq{depth} AS (SELECT *, max(CASE WHEN rn = o THEN c0 END) OVER ({by}) AS oc, max(CASE WHEN rn = o THEN w0 END) OVER ({by}) AS ow FROM mp{depth})",
            f"mb{depth + 1} AS (SELECT {cols}, CASE WHEN o IS NULL OR rn < o THEN cap ELSE least(cap, (budget - oc) * weight // (ws - ow)) END AS budget FROM mq{depth})",
        ]
    ctes += [
        "m5 AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN (budget // tokens)::INTEGER ELSE 0 END AS epoch, budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END) * tokens AS rest FROM mleaf JOIN mb3 USING (domain, lang, source))",
        f"m6 AS (SELECT *, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '(none)') || ':' || text_md5) AS k FROM m0 JOIN m5 USING (domain, lang, source))",
        "m7 AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest AND (epoch = 0 OR rest > 0) AS in_prefix FROM m6)",
        "m9 AS (SELECT doc_id, domain, lang, source, n_tokens, epoch + in_prefix::INTEGER AS copies, in_prefix FROM m7 WHERE epoch + in_prefix::INTEGER > 0)",
    ]
    return ",\n".join(ctes)


OP8_SQL = f"WITH {mixing_sql('documents')}\nSELECT * FROM m9"
