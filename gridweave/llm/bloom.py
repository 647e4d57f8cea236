"""Blocked Bloom filter: every key sets bits within one 512-bit block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import as_array, digests, joined, mix, tidied

BITS = 512
WORDS = BITS // 64
PROBES = 6
#: Bits at most, 32 MB: what is sent to all tasks doesn't grow further. With more keys the filter
#: lets more through; the exact join that follows stays right.
MOST_BITS = 1 << 28


def _spots(keys, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and its bits in it."""
    data, at = joined(keys)
    h = digests(data, at[:-1], at[1:])
    block = (h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    again = mix(h + np.uint64(0x51ED270B35AD))
    bits = np.stack([(again >> np.uint64(9 * i)) & np.uint64(BITS - 1) for i in range(PROBES)])
    return block.astype(np.int64), bits.astype(np.int64)


class BlockedBloom:
    """A filter in the driver's memory, of at most ``MOST_BITS``; sent to tasks as a broadcast."""

    def __init__(self, spark, words: np.ndarray):
        self.blocks = len(words) // WORDS
        self.sent = spark.sparkContext.broadcast(words.tobytes())

    @classmethod
    def of(cls, keys: DataFrame, column: str, bits_per_key: int = 12, most_bits: int = MOST_BITS) -> BlockedBloom:
        """The filter of a table's keys. Nulls are left out.

        The keys are written first, so that they are computed once.  Tasks make the blocks
        of their own keys; equal blocks are or-ed by Spark, before and after the shuffle.
        """
        keys = written(keys.select(F.col(column).alias("k")).filter("k is not null"), "keys")
        blocks = int(min(most_bits, max(BITS, keys.count() * bits_per_key)) // BITS) + 1

        def part(batches):
            for batch in batches:
                block, bits = _spots(batch.column(0), blocks)
                names, at = np.unique(block, return_inverse=True)
                set_ = np.zeros((len(names), WORDS), np.uint64)
                for b in bits:
                    np.bitwise_or.at(set_, (at, b >> 6), np.uint64(1) << (b & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(set_[:, i].view(np.int64)) for i in range(WORDS))], names=["block", *columns])

        columns = [f"w{i}" for i in range(WORDS)]
        made = keys.mapInArrow(tidied(part), "block bigint, " + ", ".join(f"{c} bigint" for c in columns))
        rows = made.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in columns]).toArrow()
        words = np.zeros((blocks, WORDS), np.uint64)
        at = rows.column("block").to_numpy()
        for i, c in enumerate(columns):
            words[at, i] = rows.column(c).to_numpy().view(np.uint64)
        return cls(keys.sparkSession, words.ravel())

    def flags(self, keys) -> np.ndarray:
        """Which keys may be in; null: not."""
        words = np.frombuffer(self.sent.value, np.uint64)
        keys = as_array(keys)
        block, bits = _spots(keys, self.blocks)
        out = keys.is_valid().to_numpy(zero_copy_only=False).copy()
        for b in bits:
            out &= (words[block * WORDS + (b >> 6)] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out

    def flagged(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """The rows with a boolean column that says whether the key may be in."""
        sent, blocks = self.sent, self.blocks

        def add(batches):
            mine = object.__new__(BlockedBloom)
            mine.sent, mine.blocks = sent, blocks
            for batch in batches:
                flags = pa.array(mine.flags(batch.column(batch.schema.names.index(column))))
                yield pa.RecordBatch.from_arrays([*batch.columns, flags], names=[*batch.schema.names, name])

        return df.mapInArrow(tidied(add), T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))

    def keeper(self, column: str):
        """A function of batches that keeps the rows whose key may be in, for a task that goes on with them."""
        sent, blocks = self.sent, self.blocks

        def keep(batches):
            mine = object.__new__(BlockedBloom)
            mine.sent, mine.blocks = sent, blocks
            for batch in batches:
                yield batch.filter(pa.array(mine.flags(batch.column(batch.schema.names.index(column)))))

        return keep

    def possible(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be in: all that are, and a small share of the others."""
        return df.mapInArrow(tidied(self.keeper(column)), df.schema)
