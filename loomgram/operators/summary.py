"""Histograms, similarities and totals of the bitmap.

Positions are first counted by bin and mask, which leaves few distinct masks a bin, and only those are unpacked. Where bits are
named, rows may also be runs (gid, chr, start, length, mask), whose positions are counted without being made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import WORD, bit, is_wide, members, pan_count
from loomgram.operators.runs import binned, size


def chromosomes(sequences: DataFrame, k: int) -> DataFrame:
    """gid, chr, id (order in the genome), size (number of k-mers) of sequences (gid, chr, seq), or their length in place of seq."""
    length = F.col("length") if "length" in sequences.columns else F.length("seq")
    rows = sequences.select("gid", "chr", (length - (k - 1)).cast("long").alias("size")).where("size > 0")
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("gid").orderBy("chr")) - 1)


def adaptive_bin(size: Column, bin_size: int = 200_000, least: int = 100) -> Column:
    """Bin length: bin_size, or so that there are `least` bins; never under 1."""
    return F.when(F.floor(size / bin_size) < least, F.greatest(F.lit(1), F.floor(size / least))).otherwise(F.lit(bin_size)).cast("long")


def _dense(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A row for each bin present and each pan-count 0..n."""
    all_ = counts.select(*keys).distinct().withColumn("pan_count", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return all_.join(counts, [*keys, "pan_count"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def pan_bins(bits: DataFrame, n: int, bin_size: int) -> DataFrame:
    """gid, chr, start, pan_count, n: histogram of pan-counts in each bin, zeros included."""
    rows = binned(bits, bin_size).withColumn("pan_count", pan_count(bits))
    return _dense(rows.groupBy("gid", "chr", "start", "pan_count").agg(size(rows).alias("n")), ["gid", "chr", "start"], n)


def adaptive_pan_bins(bits: DataFrame, chrs: DataFrame, n: int, bin_size: int = 200_000, least: int = 100, zeros: bool = True) -> DataFrame:
    """pan_bins() with each chromosome's own bin length; without zeros only the rows whose n isn't 0 are made."""
    own = chrs.select("gid", "chr", adaptive_bin(F.col("size"), bin_size, least).alias("bin_size"))
    rows = binned(bits.join(own, ["gid", "chr"]), F.col("bin_size")).withColumn("pan_count", pan_count(bits))
    counts = rows.groupBy("gid", "chr", "start", "pan_count").agg(size(rows).alias("n"))
    return _dense(counts, ["gid", "chr", "start"], n) if zeros else counts


def mask_counts(bits: DataFrame, *keys: str | Column) -> DataFrame:
    return bits.groupBy(*keys, "mask").agg(size(bits).alias("n"))


def bin_counts(bits: DataFrame, bin_size: int) -> DataFrame:
    """gid, chr, start, mask, n of the bins' positions, summed by mask. Runs are few and stay as they are, so that a bin's sums take one
    exchange, before which each task has added up what it holds of a bin."""
    rows = binned(bits, bin_size)
    return rows.withColumnRenamed("length", "n") if "length" in rows.columns else mask_counts(rows, "gid", "chr", "start")


def side_by_side(n: int, counted: Column | None = None) -> Column:
    """An aggregate: the sum of column n where mask has a genome, for each of n genomes; counted tells which rows count."""
    hit = lambda i: (bit(F.col("mask"), F.lit(i)) == 1) if counted is None else counted & (bit(F.col("mask"), F.lit(i)) == 1)
    return F.array(*(F.sum(F.when(hit(i), F.col("n")).otherwise(0)) for i in range(n)))


def pair_counts(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Positions of each key that each genome has, zeros included; counts: mask_counts().

    Up to WORD genomes are summed side by side in one row of a key, so that the shuffle has no row for a mask and genome.
    """
    if n <= WORD and not is_wide(counts):
        return counts.groupBy(*keys).agg(side_by_side(n).alias("each")).select(*keys, F.posexplode("each").alias("other", "n"))
    hit = counts.select(*keys, "n", F.explode(members(F.col("mask"), n)).alias("other")).groupBy(*keys, "other").agg(F.sum("n").alias("n"))
    all_ = counts.select(*keys).distinct().withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return all_.join(hit, [*keys, "other"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bin_similarity(bits: DataFrame, n: int, bin_size: int) -> DataFrame:
    """gid, chr, start, other, sim: a genome's positions in the bin by the most of any genome; null in an empty bin."""
    counts = bin_counts(bits, bin_size)
    if n > WORD or is_wide(counts):
        return similarity(pair_counts(counts, ["gid", "chr", "start"], n))
    rows = counts.groupBy("gid", "chr", "start").agg(side_by_side(n).alias("each"))
    both = F.arrays_zip(F.col("each").alias("n"), shares().alias("sim"))
    return rows.withColumn("most", F.array_max("each")).select("gid", "chr", "start", F.posexplode(both).alias("other", "s")).select("gid", "chr", "start", "other", "s.n", "s.sim")


def shares() -> Column:
    """each by most, elementwise; null where most is 0."""
    return F.transform("each", lambda x: F.try_divide(x.cast("double"), F.col("most").cast("double")))


def bin_vectors(bits: DataFrame, n: int, bin_size: int) -> DataFrame:
    """gid, chr, start, sims: bin_similarity() with a row for each bin, of up to WORD genomes in their order."""
    rows = bin_counts(bits, bin_size).groupBy("gid", "chr", "start").agg(side_by_side(n).alias("each"))
    return rows.withColumn("most", F.array_max("each")).select("gid", "chr", "start", shares().alias("sims"))


def similarity(pairs: DataFrame) -> DataFrame:
    """pair_counts() by gid, chr and start plus sim: n by the most of any genome in the bin, null in an empty one."""
    most = F.max("n").over(Window.partitionBy("gid", "chr", "start"))
    return pairs.withColumn("sim", F.try_divide(F.col("n").cast("double"), most.cast("double")))


def pan_totals(bits: DataFrame) -> DataFrame:
    """gid, chr (null: whole genome), pan_count, n in one pass."""
    by_chr = bits.groupBy("gid", "chr", pan_count(bits).alias("pan_count")).agg(size(bits).alias("n"))
    return by_chr.groupingSets([["gid", "chr", "pan_count"], ["gid", "pan_count"]], "gid", "chr", "pan_count").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts plus freq: n by the key's total."""
    return counts.withColumn("freq", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*keys))))


def pan_average(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pan_count") * F.col("n")).cast("double"), F.sum("n")).alias("average"))


def genome_sizes(chrs: DataFrame) -> DataFrame:
    return chrs.groupBy("gid").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("sequences"))


def pair_totals(bits: DataFrame, n: int) -> DataFrame:
    """gid, other, n, frac: positions shared with each genome, and by the genome's own."""
    pairs = pair_counts(mask_counts(bits, "gid"), ["gid"], n)
    own = F.max(F.when(F.col("other") == F.col("gid"), F.col("n"))).over(Window.partitionBy("gid"))
    return pairs.withColumn("frac", F.try_divide(F.col("n").cast("double"), own.cast("double")))


def conserved_share(bits: DataFrame, n: int, bin_size: int) -> DataFrame:
    """gid, chr, start, unique, universal: shares of positions that one genome or all have."""
    rows, held = binned(bits, bin_size), pan_count(bits)
    each = F.col("length") if "length" in rows.columns else F.lit(1)
    share = lambda k: F.sum(F.when(held == k, each).otherwise(0)) / size(rows)
    return rows.groupBy("gid", "chr", "start").agg(share(1).alias("unique"), share(n).alias("universal"))


def region_composition(bits: DataFrame, gid: int, chr_: object, start: int, end: int) -> DataFrame:
    """pan_count, percent of the region's positions with at least one genome."""
    rows = bits.where((F.col("gid") == gid) & (F.col("chr") == F.lit(chr_)) & (F.col("pos") >= start) & (F.col("pos") < end))
    counts = rows.where(pan_count(bits) > 0).groupBy(pan_count(bits).alias("pan_count")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("pan_count", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def region_difference(bits: DataFrame, n: int, gid: int, chr_: object, start: int, end: int) -> DataFrame:
    """other, local, total, diff: share of each genome in a region (by the most of any) and in the whole genome."""
    here = bits.where((F.col("gid") == gid) & (F.col("chr") == F.lit(chr_)) & (F.col("pos") >= start) & (F.col("pos") < end))
    local = pair_counts(mask_counts(here, "gid"), ["gid"], n)
    local = local.withColumn("local", F.try_divide(F.col("n").cast("double"), F.max("n").over(Window.partitionBy("gid")).cast("double")))
    total = pair_totals(bits.where(F.col("gid") == gid), n)
    return local.select("other", "local").join(total.select("other", F.col("frac").alias("total")), "other").withColumn("diff", F.col("local") - F.col("total"))


def block_averages(bits: DataFrame, block: int, step: int) -> DataFrame:
    rows = bits.where(F.col("pos") % step == 0)
    return rows.groupBy("gid", "chr", F.floor(F.col("pos") / block).alias("block")).agg(F.avg(pan_count(bits)).alias("average"), F.count(F.lit(1)).alias("n"))


def offsets(chrs: DataFrame, step: int = 1) -> DataFrame:
    """chrs plus offset: rows of the chromosomes before it, at that step."""
    before = Window.partitionBy("gid").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return chrs.withColumn("offset", F.coalesce(F.sum(F.ceil(F.col("size") / step)).over(before), F.lit(0)).cast("long"))
