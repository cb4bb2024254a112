"""k-mers of sequences, and the set of genomes that holds each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.functions.columns import WORD, is_wide, no_genome, one_bit, pan_count, words

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


#: Positions looked at together: their arrays stay in a core's cache.
NEAR = 1 << 14


def in_parts(f: Callable[[np.ndarray], np.ndarray], data: np.ndarray, k: int) -> np.ndarray:
    """f(data), which has a value for each window of k, made of NEAR windows at a time."""
    n = len(data) - k + 1
    if n <= NEAR:
        return f(data)
    return np.concatenate([f(data[i : min(i + NEAR, n) + k - 1]) for i in range(0, n, NEAR)])


def codes(data: np.ndarray, k: int) -> np.ndarray:
    """Canonical 2-bit codes of the k-mers at data's positions; -1 where a base isn't A, C, G or T."""
    return in_parts(lambda x: _codes(x, k), data, k)


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    if len(data) < k:
        return np.zeros(0, np.int64)
    base = _CODE[data]
    good = (base < 4).astype(np.int32)
    base = (base & 3).astype(np.int64)
    # codes of 1, 2, 4, .. bases: each width is two neighbours of the one before, and k the sum of some widths
    width, ahead, behind = 1, base, 3 - base
    have, forward, back = 0, np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
    while True:
        if k & width:
            m = len(data) - have - width + 1
            forward, back = forward[:m] << 2 * width | ahead[have : have + m], behind[have : have + m] << 2 * have | back[:m]
            have += width
        if have == k:
            break
        ahead, behind = ahead[:-width] << 2 * width | ahead[width:], behind[width:] << 2 * width | behind[:-width]
        width *= 2
    whole = np.concatenate([[0], np.cumsum(good)])
    return np.where(whole[k:] - whole[:-k] == k, np.minimum(forward, back), -1)


def tiles(sequences: DataFrame, overlap: int = 0, size: int = 1 << 16) -> DataFrame:
    """gid, chr, at, tile: sequences (gid, chr, seq) cut into `size` bases, each with `overlap` more from the next tile.

    A sequence's bytes are sliced where they lie, so that the time is linear in its length. A tile that would hold no more than the
    overlap is left out; null sequences have no tiles.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("seq").cast(pa.large_binary())
            for row in range(b.num_rows):
                data = whole[row].as_buffer() if whole[row].is_valid else None
                n = data.size if data else 0
                starts = range(0, max(0, n - overlap), size)
                for part in range(0, len(starts), 64):  # some megabytes a batch
                    own = list(starts[part : part + 64])
                    text = pa.array([data[x : x + size + overlap].to_pybytes() for x in own], pa.binary()).cast(pa.string())
                    same = [b.column(c).take(pa.array([row] * len(own))) for c in ("gid", "chr")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own, pa.int64()), text], ["gid", "chr", "at", "tile"])

    return sequences.select("gid", "chr", "seq").mapInArrow(task, T.StructType([
        T.StructField("gid", T.IntegerType()), T.StructField("chr", sequences.schema["chr"].dataType), T.StructField("at", T.LongType()), T.StructField("tile", T.StringType()),
    ]))


def _check(k: int) -> None:
    if not 0 < k <= 31:
        raise ValueError("k must be 1 to 31")


def positions(sequences: DataFrame, k: int = 21) -> DataFrame:
    """gid, chr, pos, kmer (canonical code; null at invalid bases) of every window of sequences (gid, chr, seq), k <= 31.

    Sequences are cut into tiles with k - 1 bases of overlap first, so that a long one is many rows.
    """
    _check(k)
    return tile_positions(tiles(sequences, k - 1), k)


def tile_positions(cut: DataFrame, k: int = 21) -> DataFrame:
    """positions() of tiles (gid, chr, at, tile) with k - 1 bases of overlap."""
    _check(k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(0, b.num_rows, 64):
                part = b.slice(row, 64)
                each = [codes(np.frombuffer(t.encode(), np.uint8), k) for t in part.column("tile").to_pylist()]
                size = np.array([len(x) for x in each])
                kmer = np.concatenate(each)
                at = np.repeat(part.column("at").to_numpy().astype(np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                of = pa.array(np.repeat(np.arange(len(size)), size))
                cols = [part.column("gid").take(of), part.column("chr").take(of), pa.array(at), pa.array(kmer, mask=kmer < 0)]
                yield pa.RecordBatch.from_arrays(cols, ["gid", "chr", "pos", "kmer"])

    return cut.select("gid", "chr", "at", "tile").mapInArrow(task, T.StructType([
        T.StructField("gid", T.IntegerType()), T.StructField("chr", cut.schema["chr"].dataType), T.StructField("pos", T.LongType()), T.StructField("kmer", T.LongType()),
    ]))


def genome_sets(pos: DataFrame, min_count: int = 1) -> DataFrame:
    """gid, kmer, n of the k-mers that a genome has min_count times at least (1 for assemblies, 2 for reads)."""
    return pos.where("kmer is not null").groupBy("gid", "kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def kmer_sets(pos: DataFrame, min_count: int = 1, n: int = WORD) -> DataFrame:
    """kmer, mask: bit i is 1 if genome i of n has the k-mer. One shuffle, combined before it.

    For over WORD genomes the mask is an array of words. A genome id of n or more is an error.
    """
    rows = pos.where("kmer is not null") if min_count <= 1 else genome_sets(pos, min_count)
    if n <= WORD:
        return rows.groupBy("kmer").agg(F.bit_or(one_bit(F.col("gid"))).alias("mask"))
    gid = F.when((F.col("gid") >= 0) & (F.col("gid") < n), F.col("gid")).otherwise(F.raise_error(F.lit(f"a genome id is not within 0 to {n - 1}")).cast("int"))
    own = one_bit(gid % WORD)
    parts = [F.coalesce(F.bit_or(F.when(F.floor(gid / WORD) == w, own)), F.lit(0).cast("long")) for w in range(words(n))]
    return rows.groupBy("kmer").agg(F.array(*parts).alias("mask"))


def kmer_words(pos: DataFrame, word: int = WORD) -> DataFrame:
    """kmer, word, mask for any number of genomes: word w holds genomes w * word and on."""
    rows = pos.where("kmer is not null").withColumn("word", F.floor(F.col("gid") / word).cast("int"))
    return rows.groupBy("kmer", "word").agg(F.bit_or(one_bit(F.col("gid") % word)).alias("mask"))


def anchor(pos: DataFrame, sets: DataFrame, n: int = WORD) -> DataFrame:
    """gid, chr, pos, mask of every position: its k-mer's genomes of n, none at invalid bases.

    Null k-mers would be one hot key of the join; they go by negative numbers, which no k-mer has, to all tasks.
    """
    if is_wide(sets) != (n > WORD):
        raise ValueError("the sets are not of n genomes")
    spread = -1 - F.pmod(F.xxhash64("gid", "chr", "pos"), F.lit(1 << 20))
    met = pos.withColumn("kmer", F.coalesce("kmer", spread)).join(sets, "kmer", "left")
    return met.select("gid", "chr", "pos", F.coalesce("mask", no_genome(n)).alias("mask"))


def conserved(sets: DataFrame, n: int) -> DataFrame:
    """kmer, mask, kind: private (one genome), core (all n) or accessory."""
    size = pan_count(sets)
    return sets.withColumn("kind", F.when(size == 1, "private").when(size == n, "core").otherwise("accessory"))
