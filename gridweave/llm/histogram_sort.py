"""Sharding by histogram sort, in DataFrame functions alone: shards of nearly equal bytes, rows in one global order.

The order is (digest of the text, digest of the id, number of the row), so equal texts lie
side by side.  Splitters are found by counting: a round counts the exact bytes of the rows
in cells of the key space, cells that hold an unsettled splitter are cut again in the next
round, and a cell that holds one text (id) alone is cut by the next part of the key.  A
splitter settles at the border of a group of equal texts if that lies within the
tolerance, else at the border of an id, else between two rows.  Then rows move once, each
to its range; a shard is a run of ranges, so neither a shard nor a group of copies meets in
one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Parts of the key and their bits, cells counted in a round (at least 16 for each open one), and ranges of a shard.
KEYS, BITS, CELLS, MOST_RANGES = ("_h", "_g", "_s"), (60, 60, 63), 1 << 16, 512
#: Rows of a range while a shard has fewer than MOST_RANGES, and bits of the digest by which a row finds its range.
PER_RANGE, FIND_BITS = 1000, 12
#: A shard's border may lie so many thousandths of a shard from its ideal place to leave a group of equal texts whole.
TOLERANCE = 10
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _digest(text: Column) -> Column:
    """The first 60 bits of the SHA-256 digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows (cells, ranges) from the driver, for all tasks."""
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*"))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """The rows' keys, sizes and what is kept, written once: the numbers of repeated rows must not change between rounds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *keep,
        _digest(text).alias("_h"),
        _digest(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_g"),
        F.monotonically_increasing_id().alias("_s"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    return written(rows, "keyed")


def _counted(rows: DataFrame, level: int, shift: int, bits: int, opened: dict[tuple, dict]) -> dict[tuple, dict[int, list[tuple[int, int, int, int]]]]:
    """(outer key parts) -> open cell -> (sub-cell, bytes, least and greatest value), in order."""
    key, outer = F.col(KEYS[level]), KEYS[:level]
    if level or shift < BITS[level]:
        cells = _table(rows.sparkSession, [dict(zip(outer, o, strict=True)) | {"_cell": c} for o, cs in opened.items() for c in cs], ", ".join(f"{n} long" for n in (*outer, "_cell")))
        rows = rows.withColumn("_cell", F.shiftright(key, shift) if shift < 63 else F.lit(0).cast("long")).join(cells, [*outer, "_cell"])
    found = rows.groupBy(*outer, F.shiftright(key, shift - bits).alias("_sub")).agg(F.sum("_size").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    out: dict[tuple, dict[int, list]] = {}
    for r in found:
        out.setdefault(tuple(r[:level]), {}).setdefault(r["_sub"] >> bits, []).append((r["_sub"], r["n"], r["low"], r["high"]))
    for cells in out.values():
        for subs in cells.values():
            subs.sort()
    return out


def splitters(rows: DataFrame, total: int, shards: int, ranges: int, tolerance: int) -> list[tuple[tuple[int, int, int], int]]:
    """Least keys of all ranges but the first, in order, and how many shards begin there (in a tiny table several may).

    Every round is one aggregation; at most ``CELLS`` sums, or 16 for each range, reach the
    driver.  Borders of shards are followed to the group of equal texts that holds their
    place; those of ranges within a shard may lie half a range off.
    """
    parts = shards * ranges
    opened = {(): {0: (0, [(total * j // parts, j % ranges == 0) for j in range(1, parts)])}}
    settled: dict[tuple[int, int, int], int] = {}
    for level in range(3):
        shift, deeper = BITS[level], {}
        while opened:
            bits = min(shift, max(4, (CELLS // sum(map(len, opened.values()))).bit_length() - 1))
            counts, further = _counted(rows, level, shift, bits, opened), {}
            for outer, cells in opened.items():
                for cell, (below, targets) in cells.items():
                    subs, at, k = counts[outer][cell], below, 0
                    for place, main in sorted(targets):
                        while at + subs[k][1] <= place:
                            at, k = at + subs[k][1], k + 1
                        sub, n, low, high = subs[k]
                        near, up = min((place - at, 0), (at + n - place, 1))
                        close = total * tolerance // (1000 * shards) if main else total // (2 * parts)
                        if low == high and (near <= close or level == 2):
                            split = (*outer, low + up, *(0,) * (2 - level))
                        elif low < high and not main and near <= close:
                            split = (*outer, (sub + up) << (shift - bits), *(0,) * (2 - level))
                        else:
                            where, name = (deeper.setdefault((*outer, low), {}), 0) if low == high else (further.setdefault(outer, {}), sub)
                            where.setdefault(name, (at, []))[1].append((place, main))
                            continue
                        settled[split] = settled.get(split, 0) + main
            opened, shift = further, shift - bits
        opened = deeper
    return sorted(settled.items())


def _ranged(rows: DataFrame, borders: list[tuple[tuple[int, int, int], int]]) -> DataFrame:
    """Rows with ``_range``: looked up by the first bits of the digest, then by the borders within."""
    begins: list[list[tuple[int, int, int]]] = [[] for _ in range(1 << FIND_BITS)]
    for key, _ in borders:
        begins[min(key[0] >> (60 - FIND_BITS), len(begins) - 1)].append(key)
    cells, before = [], 0
    for k, keys in enumerate(begins):
        cells.append({"_find": k, "_before": before, "_borders": [dict(zip(KEYS, x, strict=True)) for x in keys]})
        before += len(keys)
    found = _table(rows.sparkSession, cells, "_find long, _before int, _borders array<struct<_h long, _g long, _s long>>")
    return rows.withColumn("_find", F.shiftright("_h", 60 - FIND_BITS)).join(found, "_find").withColumn("_range", F.col("_before") + F.size(F.filter("_borders", lambda x: x <= F.struct(*KEYS)))).drop("_find", "_before", "_borders")


def histogram_sorted(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, tolerance: int = TOLERANCE) -> DataFrame:
    """Documents with their shard and their slot in it; shards hold nearly equal bytes and slots follow the global order.

    Adds size (bytes of the text and 1), text_crc32, law ('bytes'), shard, slot and
    grown_shard (null); input columns of these names give way.  ``texts=False``: the id
    alone beside them.  A null text is empty; rows that repeat id and text are told apart by
    their number.  Ids of any type.  An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in MADE] if texts else [id_col]
    rows = keyed(docs, id_col, text_col, [F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_doc")])
    n, total = rows.agg(F.count("*"), F.sum("_size")).first()
    ranges = max(1, min(MOST_RANGES, n // (shards * PER_RANGE)))
    borders = splitters(rows, total, shards, ranges, tolerance) if n else []
    first, shard = {0: 0}, 0  # range -> its shard; several borders may have met in one
    for k, (_, main) in enumerate(borders, 1):
        shard += main
        first[k] = shard
    rows = _ranged(rows, borders)
    counts = dict(rows.groupBy("_range").count().collect())  # a row for each range
    places, filled = [], {}
    for k, s in first.items():
        places.append({"_range": k, "_shard": s, "_offset": filled.get(s, 0)})
        filled[s] = filled.get(s, 0) + counts.get(k, 0)
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy(*KEYS)))
    rows = rows.join(_table(rows.sparkSession, places, "_range int, _shard int, _offset long"), "_range")
    return rows.select(
        "_doc.*",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_offset") + F.col("_rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """A folder ``shard=k`` for each shard, its files in the order of slots; a range is never cut into two files by the sort."""
    histogram_sorted(docs, **options).write.partitionBy("shard").parquet(folder)


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents."""
    return histogram_sorted(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


#: crc32 of a text in SQL: its table by the rule, then byte by byte.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS steps"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({0}), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256)))"

_NEAREST = "CASE WHEN place - {0}_low <= {0}_high - place THEN {0}_low ELSE {0}_high END"
OP11_SQL = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, strlen(text) + 1 AS size, {CRC.format("text")} AS text_crc32, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS h,
  ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS g FROM d, crc),
o AS (SELECT *, row_number() OVER (ORDER BY h, g) AS row FROM k),
c AS (SELECT *, sum(size) OVER (ORDER BY row)::BIGINT AS row_high, (sum(size) OVER (ORDER BY row) - size)::BIGINT AS row_low, (sum(size) OVER ())::BIGINT AS total FROM o),
b AS (SELECT *, min(row_low) OVER (PARTITION BY h) AS text_low, max(row_high) OVER (PARTITION BY h) AS text_high,
  min(row_low) OVER (PARTITION BY h, g) AS id_low, max(row_high) OVER (PARTITION BY h, g) AS id_high, total * {TOLERANCE} // 8000 AS close FROM c),
s AS (SELECT CASE WHEN least(place - text_low, text_high - place) <= close THEN {_NEAREST.format("text")}
  WHEN least(place - id_low, id_high - place) <= close THEN {_NEAREST.format("id")} ELSE {_NEAREST.format("row")} END AS border
  FROM (SELECT *, total * j // 8 AS place FROM b, range(1, 8) AS r(j)) WHERE row_low <= place AND place < row_high),
p AS (SELECT *, (SELECT count(*) FROM s WHERE border <= row_low) AS shard FROM b)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY row) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
