"""Similarity series by bin: filtered similarities, means, smoothing, tapering and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import WORD, is_wide, pan_count, rounded
from loomgram.operators.bitmap import neutralise_unique, omit_fixed
from loomgram.operators.runs import binned
from loomgram.operators.summary import bin_counts, bin_similarity, shares, side_by_side

KEYS = ["gid", "chr", "other"]


def clip(x: Column) -> Column:
    """x within 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def filtered_similarity(bits: DataFrame, n: int, bin_size: int, kept: Column | None = None, fixed: bool = True) -> DataFrame:
    """bin_similarity() after unique k-mers are neutralised (against the mask kept) and fixed ones dropped, in this order.

    Bins that lose all positions have similarity 1.
    """
    if n <= WORD and not is_wide(bits):
        return exploded(filtered_vectors(bits, n, bin_size, kept, fixed))
    rows = bits if kept is None else neutralise_unique(bits, kept)
    rows = omit_fixed(rows, n) if fixed else rows
    sim = bin_similarity(rows, n, bin_size).select("gid", "chr", "start", "other", "sim", F.lit(True).alias("there"))
    all_ = binned(bits, bin_size).select("gid", "chr", "start").distinct().withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = all_.join(sim, ["gid", "chr", "start", "other"], "left")
    return met.select("gid", "chr", "start", "other", F.when(F.col("there"), F.col("sim")).otherwise(F.lit(1.0)).alias("sim"))


def filtered_vectors(bits: DataFrame, n: int, bin_size: int, kept: Column | None = None, fixed: bool = True) -> DataFrame:
    """gid, chr, start, sims: filtered_similarity() with a row for each bin, of up to WORD genomes in their order.

    Masks of a bin that don't count are summed as nothing, so that the bins that lose all need no join.
    """
    counts = bin_counts(bits, bin_size)
    counts = counts if kept is None else neutralise_unique(counts, kept)
    counted = pan_count(counts) < n if fixed else F.lit(True)
    rows = counts.groupBy("gid", "chr", "start").agg(side_by_side(n, counted).alias("each"), F.bool_or(counted).alias("there"))
    sims = F.when(F.col("there"), shares()).otherwise(F.array_repeat(F.lit(1.0), n))
    return rows.withColumn("most", F.array_max("each")).select("gid", "chr", "start", sims.alias("sims"))


def exploded(rows: DataFrame) -> DataFrame:
    """gid, chr, start, other, sim of rows with sims."""
    return rows.select("gid", "chr", "start", F.posexplode("sims").alias("other", "sim"))


def mean_similarity(sim: DataFrame, trim: float = -1.0) -> DataFrame:
    """gid, other, mean over all bins of those within trim sample deviations of the mean; -1: over all.

    Similarities are ratios of counts up to a bin's length, so that equal ones are counted first and few rows are left.
    """
    if trim < 0:
        return sim.groupBy("gid", "other").agg(F.avg("sim").alias("mean"))
    own = Window.partitionBy("gid", "other")
    rows = sim.groupBy("gid", "other", "sim").agg(F.count("sim").alias("n"))
    x, n = F.col("sim"), F.col("n")
    rows = rows.withColumn("m", F.try_divide(F.sum(x * n).over(own), F.sum("n").over(own)))
    rows = rows.withColumn("s", F.sqrt(F.try_divide(F.sum(n * (x - F.col("m")) * (x - F.col("m"))).over(own), F.sum("n").over(own) - 1)))
    inside = (x >= F.col("m") - trim * F.col("s")) & (x <= F.col("m") + trim * F.col("s"))
    return rows.groupBy("gid", "other").agg(F.try_divide(F.sum(F.when(inside, x * n)), F.sum(F.when(inside, n))).alias("mean"))


def shift_to_target(sim: DataFrame, means: DataFrame, target: float = -1.0, limit: float = 0.98) -> DataFrame:
    """Rounded similarities; those of at most limit move by target - mean; all are clipped to 0..1.

    Target -1 is the anchor's largest mean other than 1.
    """
    best = means.where("mean <> 1").groupBy("gid").agg(F.max("mean").alias("goal"))
    goal = F.col("goal") if target < 0 else F.lit(target)
    met = sim.join(means, ["gid", "other"], "left").join(best, "gid", "left")
    x = rounded(F.col("sim"), 2)
    moved = F.when(x <= limit, x + goal - F.col("mean")).otherwise(x)
    return met.select("gid", "chr", "start", "other", clip(moved).alias("sim"))


def smooth(sim: DataFrame, size: int, how: str = "mean") -> DataFrame:
    """Moving mean (nulls ignored) or median (upper of an even window) over each series, ends mirrored (the edge value twice).

    The window of row i begins at i - size div 2. Rows near an end are also put at the places beyond it that mirror them,
    so that a plain window of rows does the rest; no series is gathered in one row. Rows may also hold sims of all genomes
    (filtered_vectors()): then the series of a chromosome move together, and the result has sims too.
    """
    keys, value = (["gid", "chr"], "sims") if "sims" in sim.columns else (KEYS, "sim")
    order = Window.partitionBy(*keys).orderBy("start")
    rows = sim.select(*keys, "start", value).withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
    n = F.col("n")

    def mirrored(low: Column, high: Column) -> Column:
        turn = lambda v: F.pmod(v, 2 * n)
        return F.filter(F.sequence(low, high), lambda v: F.when(turn(v) < n, turn(v)).otherwise(2 * n - 1 - turn(v)) == F.col("i"))

    ends = F.concat(mirrored(F.lit(-size), F.lit(-1)), mirrored(n, n + size - 1))
    near = (F.col("i") < size) | (F.col("i") >= n - size)
    at = rows.withColumn("at", F.explode(F.concat(F.array("i"), F.when(near, ends).otherwise(F.array().cast("array<int>")))))
    frame = Window.partitionBy(*keys).orderBy("at").rowsBetween(-(size // 2), size - 1 - size // 2)
    if value == "sims":
        near = at.withColumn("near", F.collect_list("sims").over(frame)).where("at >= 0 and at < n")
        nth = lambda i: F.transform("near", lambda x: F.get(x, i))
        known = lambda i: F.filter(nth(i), lambda x: x.isNotNull())
        mean = lambda i: F.try_divide(F.aggregate(known(i), F.lit(0.0), lambda a, x: a + x), F.size(known(i)))
        of = mean if how == "mean" else lambda i: F.get(F.array_sort(nth(i)), F.lit(size // 2))
        return near.select("gid", "chr", "start", F.transform(F.sequence(F.lit(0), F.size("sims") - 1), of).alias("sims"))
    if how == "mean":
        value = F.avg("sim").over(frame)
    else:
        value = F.get(F.array_sort(F.transform(F.collect_list(F.struct("sim")).over(frame), lambda x: x["sim"])), F.lit(size // 2))
    return at.withColumn("sim", value).where("at >= 0 and at < n").select("gid", "chr", "start", "other", "sim")


def taper(sim: DataFrame) -> DataFrame:
    """x * (1 + 0.1 exp(-4 t^2) / max), t from -1 to 1 over the bins, clipped; then 0.2 less unless 1, clipped. Rows may hold sims
    of all genomes, as in smooth()."""
    wide = "sims" in sim.columns
    own = Window.partitionBy(*(["gid", "chr"] if wide else KEYS))
    i = F.row_number().over(own.orderBy("start")) - 1
    n = F.count(F.lit(1)).over(own)
    t = F.when(n > 1, -1 + 2 * i / (n - 1)).otherwise(F.lit(-1.0))
    rows = sim.withColumn("bump", F.exp(-4 * t * t))
    rows = rows.withColumn("more", 1 + 0.1 * F.col("bump") / F.max("bump").over(own))
    less = lambda x: clip(F.when(x == 1, x).otherwise(x - 0.2))
    if wide:
        return rows.select("gid", "chr", "start", F.transform(F.transform("sims", lambda x: clip(x * F.col("more"))), less).alias("sims"))
    return rows.withColumn("x", clip(F.col("sim") * F.col("more"))).select("gid", "chr", "start", "other", less(F.col("x")).alias("sim"))


def group_similarity(sim: DataFrame, groups: DataFrame, compare: str) -> DataFrame:
    """gid, chr, start with own (mean of the anchor's group without it), comp (largest of the group compare) and ref
    (mean) and ref_max of REF. Rows of sim may hold sims of all genomes, as in smooth()."""
    if "sims" in sim.columns:
        return _group_vectors(sim, groups, compare)
    named = groups.select(F.col("gid").alias("other"), F.col("grp").alias("other_grp"))
    mine = groups.select("gid", F.col("grp").alias("own_grp"))
    rows = sim.join(named, "other").join(mine, "gid")
    of = lambda c: F.when(c, F.col("sim"))
    return rows.groupBy("gid", "chr", "start").agg(
        F.avg(of((F.col("other_grp") == F.col("own_grp")) & (F.col("other") != F.col("gid")))).alias("own"),
        F.max(of(F.col("other_grp") == compare)).alias("comp"), F.avg(of(F.col("other_grp") == "REF")).alias("ref"), F.max(of(F.col("other_grp") == "REF")).alias("ref_max"),
    )


def _group_vectors(rows: DataFrame, groups: DataFrame, compare: str) -> DataFrame:
    """group_similarity() of rows with sims: the genomes of each group are listed for each anchor, and no row is made for them."""
    other = groups.select(F.col("gid").alias("other"), F.col("grp").alias("other_grp"))
    lists = lambda c: F.collect_list(F.when(c, F.col("other")))
    own = (F.col("other_grp") == F.col("grp")) & (F.col("other") != F.col("gid"))
    met = groups.crossJoin(other).groupBy("gid").agg(lists(own).alias("in_own"), lists(F.col("other_grp") == compare).alias("in_comp"), lists(F.col("other_grp") == "REF").alias("in_ref"))
    of = lambda c: F.filter(F.transform(c, lambda i: F.get("sims", i)), lambda x: x.isNotNull())
    mean = lambda c: F.try_divide(F.aggregate(of(c), F.lit(0.0), lambda a, x: a + x), F.size(of(c)))
    return rows.join(met, "gid").select("gid", "chr", "start", mean("in_own").alias("own"), F.array_max(of("in_comp")).alias("comp"), mean("in_ref").alias("ref"), F.array_max(of("in_ref")).alias("ref_max"))
