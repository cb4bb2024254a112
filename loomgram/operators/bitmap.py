"""Selections from the position-by-genome bitmap: rows (gid, chr, pos, mask)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import bit, is_wide, mask_of, pan_count
from loomgram.operators.smallest import LEADING, leading, smallest


def query(bits: DataFrame, gid: int, chr_: object, start: int, end: int, step: int = 1, stored: dict[int, DataFrame] | None = None) -> DataFrame:
    """Positions start, start + step, .. before end of one chromosome; the filter reaches the scan.

    stored: bitmaps of low_resolution() by their step. The coarsest one that holds all positions asked for is read.
    """
    bits = at_step(bits, step, stored or {}, start)
    near = (F.col("gid") == gid) & (F.col("chr") == F.lit(chr_)) & (F.col("pos") >= start) & (F.col("pos") < end)
    return bits.where(near).where((F.col("pos") - start) % step == 0)


def at_step(bits: DataFrame, step: int, stored: dict[int, DataFrame], start: int = 0) -> DataFrame:
    """The coarsest of the stored bitmaps, by step, that has the positions start, start + step, ..; else bits itself."""
    fit = [s for s in stored if step % s == 0 and start % s == 0]
    return stored[max(fit)] if fit else bits


def unpack(bits: DataFrame, n: int) -> DataFrame:
    """One row for each position and genome: other, bit."""
    return bits.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bit", bit(F.col("mask"), F.col("other"), n)).drop("mask")


def wide(bits: DataFrame, names: list[str]) -> DataFrame:
    """One 0/1 column for each genome, for presentation."""
    n = 1 << 30 if is_wide(bits) else len(names)
    return bits.select("gid", "chr", "pos", *(bit(F.col("mask"), F.lit(i), n).alias(x) for i, x in enumerate(names)))


def pattern(bits: DataFrame, present: list[int], absent: list[int]) -> DataFrame:
    """Positions in all genomes of present and in none of absent, whatever the others."""
    if is_wide(bits):
        n = max([*present, *absent], default=0) + 64
        return bits.where(reduce(and_, (bit(F.col("mask"), F.lit(i), n) == int(i in present) for i in (*present, *absent)), F.lit(True)))
    must, never = mask_of(present), mask_of(absent)
    return bits.where((F.col("mask").bitwiseAND(must) == must) & (F.col("mask").bitwiseAND(never) == 0))


def low_resolution(bits: DataFrame, step: int = 100) -> DataFrame:
    return bits.where(F.col("pos") % step == 0)


def omit_fixed(bits: DataFrame, n: int) -> DataFrame:
    """Without positions that all n genomes have."""
    return bits.where(pan_count(bits) < n)


def neutralise_unique(bits: DataFrame, kept: Column) -> DataFrame:
    """Positions that no genome of kept (a mask) has count as present in all of kept."""
    if is_wide(bits):
        hit = F.exists(F.zip_with("mask", kept, lambda a, b: a.bitwiseAND(b)), lambda x: x != 0)
        return bits.withColumn("mask", F.when(hit, F.col("mask")).otherwise(F.zip_with("mask", kept, lambda a, b: a.bitwiseOR(b))))
    return bits.withColumn("mask", F.when(F.col("mask").bitwiseAND(kept) == 0, F.col("mask").bitwiseOR(kept)).otherwise(F.col("mask")))


def sample(bits: DataFrame, most: int = 50_000) -> DataFrame:
    """At most `most` positions of each chromosome, the ones of smallest hash (MD5): the same ones on each run."""
    h = F.md5(F.concat_ws(":", "gid", "chr", "pos"))
    unit = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    if most <= LEADING:  # a batch leaves few rows
        near = leading(bits.withColumn("unit", unit), ["gid", "chr"], "unit", most).drop("unit")
        first = near.withColumn("r", F.row_number().over(Window.partitionBy("gid", "chr").orderBy(h, "pos")))
        return first.where(F.col("r") <= most).drop("r")
    return smallest(bits, ["gid", "chr"], [h, F.col("pos")], unit, most)


def resolution(regions: DataFrame, step: int = 100, max_bins: int = 350) -> DataFrame:
    """regions (start, end) plus step (1 for a short region) and bin_size."""
    size = F.col("end") - F.col("start")
    return regions.withColumn("step", F.when(size < step * max_bins * 8, 1).otherwise(step)).withColumn("bin_size", F.floor(size / max_bins) + 1)


def clamp(regions: DataFrame, chrs: DataFrame, before: tuple[int, int] = (0, 100)) -> DataFrame:
    """regions (chr, start, end) made valid: an unknown chromosome is the first, wrong limits are the ones before."""
    first = chrs.agg(F.min_by(F.struct("chr", "size"), "id").alias("first"))
    met = regions.join(chrs.select("chr", F.col("size").alias("own")), "chr", "left").crossJoin(F.broadcast(first))
    chr_ = F.when(F.col("own").isNull(), F.col("first.chr")).otherwise(F.col("chr"))
    size = F.coalesce("own", F.col("first.size"))
    wrong = (F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > size)
    a, b = (F.when(wrong, F.lit(x)).otherwise(F.col(c)).cast("long") for x, c in zip(before, ("start", "end")))
    return met.select(F.col("chr").alias("asked"), chr_.alias("chr"), a.alias("start"), b.alias("end"))

