"""The bitmap in runs: (gid, chr, start, length, mask) of neighbouring positions with equal masks.

Genomes share long stretches, so that a run stands for many positions. Runs are made within batches of rows, without a shuffle;
where two runs with one mask touch, both stay, as no operator here needs the longest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.functions.columns import WORD, pan_count, words


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where neighbours of the column are equal."""
    if pa.types.is_list(column.type):
        width = pc.list_value_length(column).to_numpy()
        flat = column.flatten().to_numpy().reshape(len(column), width[0])
        return np.cumsum(np.r_[0, (flat[1:] != flat[:-1]).any(axis=1)])
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.dictionary_encode().indices.fill_null(-1).to_numpy()


def encode(rows: DataFrame, value: str = "mask", block: int | None = None) -> DataFrame:
    """gid, chr, start, length, value of runs of rows (gid, chr, pos, value) with equal values; none crosses a multiple of block.

    Rows in the order of the stored bitmap give long runs; in any other order they are right as well, and shorter. A position
    that is there twice stays two rows of length 1 at least.
    """
    schema = T.StructType([rows.schema["gid"], rows.schema["chr"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), rows.schema[value]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pos = b.column("pos").to_numpy().astype(np.int64)
            new = np.r_[True, pos[1:] != pos[:-1] + 1]
            for c in ("gid", "chr", value):
                x = _numbers(b.column(c))
                new[1:] |= x[1:] != x[:-1]
            if block:
                new |= pos % block == 0
            at = np.flatnonzero(new)
            of = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("gid").take(of), b.column("chr").take(of), pa.array(pos[at]), pa.array(np.diff(np.r_[at, len(pos)])), b.column(value).take(of)], schema.names)

    return rows.select("gid", "chr", "pos", value).mapInArrow(task, schema)


def joined(rows: DataFrame, n: int = WORD) -> DataFrame:
    """encode() of rows of buckets.anchored_runs(), of n genomes, without a row for each position on the way: what touches in the
    order of the rows and has one mask is one run."""
    w = words(n)
    kind = T.LongType() if w == 1 else T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["gid"], rows.schema["chr"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("mask", kind)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, start = b.column("masks"), b.column("start").to_numpy().astype(np.int64)
            count = pc.list_value_length(masks).to_numpy().astype(np.int64) // w
            flat = masks.flatten().to_numpy().reshape(-1, w)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(count)), count)
            pos = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(flat))
            new = np.r_[True, (flat[1:] != flat[:-1]).any(axis=1) | (pos[1:] != pos[:-1] + 1)]
            for c in ("gid", "chr"):
                x = _numbers(b.column(c))
                new[1:] |= x[row[1:]] != x[row[:-1]]
            at = np.flatnonzero(new)
            of, mask = pa.array(row[at]), flat[at]
            value = pa.array(mask[:, 0]) if w == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w), pa.array(mask.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("gid").take(of), b.column("chr").take(of), pa.array(pos[at]), pa.array(np.diff(np.r_[at, len(pos)])), value], schema.names)

    return rows.select("gid", "chr", "start", "masks").mapInArrow(task, schema)


def size(rows: DataFrame) -> Column:
    """How many positions rows of a group stand for, be they positions or runs."""
    return F.sum("length") if "length" in rows.columns else F.count(F.lit(1))


def binned(rows: DataFrame, bin_size: int | Column) -> DataFrame:
    """gid, chr, start (of the bin), mask and, for runs, length of positions or runs."""
    if "length" in rows.columns:
        return by_bin(rows, bin_size).select("gid", "chr", F.col("bin").alias("start"), "mask", "length")
    return rows.select("gid", "chr", (F.floor(F.col("pos") / bin_size) * bin_size).alias("start"), "mask")


def decode(runs: DataFrame) -> DataFrame:
    """gid, chr, pos, mask of every position."""
    return runs.select("gid", "chr", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"), "mask")


def query(runs: DataFrame, gid: int, chr_: object, start: int, end: int, step: int = 1) -> DataFrame:
    """The positions start, start + step, .. before end: runs are clipped to the range before they are spread out.

    The filter on start + length reaches no statistics, so that runs are also asked to begin before the range's end.
    """
    near = runs.where((F.col("gid") == gid) & (F.col("chr") == F.lit(chr_)) & (F.col("start") < end) & (F.col("start") + F.col("length") > start))
    low = F.greatest(F.col("start"), F.lit(start))
    first = low + F.pmod(F.lit(start) - low, F.lit(step))
    last = F.least(F.col("start") + F.col("length"), F.lit(end)) - 1
    return near.where(first <= last).select("gid", "chr", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("pos"), "mask")


def by_bin(runs: DataFrame, bin_size: int | Column) -> DataFrame:
    """runs cut at the bins' ends, plus bin (its start); a column tells each row's own bin length."""
    last = F.col("start") + F.col("length") - 1
    cut = runs.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(last / bin_size))))
    low, high = F.greatest("start", F.col("b") * bin_size), F.least(last + 1, (F.col("b") + 1) * bin_size)
    return cut.select("gid", "chr", low.alias("start"), (high - low).alias("length"), "mask", (F.col("b") * bin_size).alias("bin"))


def mask_counts(runs: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, mask, n: positions with each mask; see summary.mask_counts()."""
    return runs.groupBy(*keys, "mask").agg(F.sum("length").alias("n"))


def pan_totals(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, pan_count, n: positions in so many genomes."""
    return runs.groupBy(*keys, pan_count(runs).alias("pan_count")).agg(F.sum("length").alias("n"))
