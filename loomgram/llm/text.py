"""Vectorised views of Arrow text batches: bytes, words, hashes. Helpers for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time in a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def unused(docs: DataFrame, name: str) -> str:
    """name, or name with as many _in as make it no column of docs, whatever the case."""
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name += "_in"
    return name


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """(docs, {old: new}): columns that have one of the names get `_in` after theirs, with their values as they are.

    An operator's own columns thus always have the names that it documents, and no column of its input is lost.
    """
    taken = {n.lower() for n in names}
    moved = {}
    for c in docs.columns:
        if c.lower() in taken:
            new = c + "_in"
            while new.lower() in taken | {x.lower() for x in docs.columns}:
                new += "_in"
            docs, moved[c] = docs.withColumnRenamed(c, new), new
    return docs, moved


def as_before(docs: DataFrame, *names: str) -> list[Column]:
    """The columns of docs under their first names, from a result for which aside(docs, *names) was called."""
    _, moved = aside(docs, *names)
    return [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary array; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of equal kind > 0 that doesn't cross a row's end."""
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = off[1:-1]
    new[inner[inner < n]] = True
    at = np.flatnonzero(new)
    to = np.r_[at[1:], n]
    ok = kind[at] > 0
    at, to = at[ok], to[ok]
    return at, to, np.searchsorted(off, at, "right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``."""
    return runs((~SPACE[data]).view(np.uint8), off)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 3))
        both = []
        for x in (_BASE, _INVERSE):
            p = np.full(size, x)
            p[0] = 1
            both.append(np.cumprod(p))
        if n > size // 2 and n > 4 * SLICE_BYTES:
            return both[0], both[1]  # a very long text: don't hold on to them
        _powers[:] = both
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the polynomial hash of any span of data."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: equal bytes, equal hash."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of values (1 or 2 dimensions) by row; row ascends."""
    out = np.zeros((n, *values.shape[1:]), dtype=values.dtype)
    if len(values):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] = np.add.reduceat(values, at, axis=0)
    return out
