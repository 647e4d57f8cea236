"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

They run inside Spark's Python workers on one Arrow batch at a time.  Words are found
with a byte-class table (every byte from 0x80 up belongs to a word, so multi-byte
characters stay whole) and named by a 64-bit digest.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPAN = 1 << 17

#: Bytes of words split at ASCII white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of alphanumeric words: 0-9, A-Z, a-z and all of non-ASCII text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SPAN + 1)
_POW_INV = _powers(_BASE_INV, _SPAN + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The C library of a worker; elsewhere than on Linux it has no malloc_trim.
_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system: workers live through many stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(run):
    """A function of batches that gives its memory back at its end, when its own variables are gone."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def joined(texts, end: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by ``end``, and the offsets of the texts. Null: empty."""
    texts = pc.fill_null(as_array(texts), "").cast(pa.large_string())
    ended = pc.binary_join_element_wise(texts, pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(ended) + 1, offset=ended.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(texts, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most_bytes`` of text and ``most_rows`` rows at most, and at least one row each."""
    sizes = pc.fill_null(pc.binary_length(as_array(texts)), 0).to_numpy(zero_copy_only=False)
    at, begin, total = np.cumsum(sizes), 0, 0
    while begin < len(sizes):
        end = max(begin + 1, min(begin + most_rows, int(np.searchsorted(at, total + most_bytes, "right"))))
        yield begin, end
        begin, total = end, int(at[end - 1])


class Words:
    """The words of some texts: ``digest`` by word; text i has words ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, texts, kind: np.ndarray = NOT_SPACE, lower: bool = True):
        data, offsets = joined(texts)
        if lower:
            data = LOWER[data]
        inside = kind[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.data, self.starts, self.ends = data, edges[::2], edges[1::2]
        self.at = np.searchsorted(self.starts, offsets)
        self.digest = digests(data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch ``data[start:end]``; stretches ascend and don't overlap."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        low, span = starts[i], ends[j - 1] - starts[i]
        pw, inv = (_POW, _POW_INV) if span <= _SPAN else (_powers(_BASE, span + 1), _powers(_BASE_INV, span + 1))
        sums = np.empty(span + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((data[low : low + span].astype(U64) + U64(1)) * pw[:span], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * inv[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def runs(digest: np.ndarray, n: int) -> np.ndarray:
    """A digest of every run of ``n`` consecutive words; run i starts at word i."""
    m = max(0, len(digest) - n + 1)
    out = np.full(m, n, dtype=U64)
    for k in range(n):
        out = mix(out * _BASE + digest[k : k + m])
    return out


def group_rows(batches, key_columns: list[str]) -> Iterator[pa.Table]:
    """Rows of Arrow batches sorted by the key, one table for each key."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [as_array(batch.column(k)) for k in key_columns]
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[begin].as_py() for k in keys)
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(begin, end - begin))
            last = now
    if kept:
        yield pa.Table.from_batches(kept)
