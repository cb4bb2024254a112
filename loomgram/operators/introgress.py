"""Introgression calls on similarity series, for many thresholds at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgram.operators import intervals
from loomgram.operators.similarity import group_similarity, mean_similarity, shift_to_target, smooth, taper

#: Thresholds of the sweeps, in hundredths. Fixed values.
TWO_WAY, THREE_WAY = list(range(10, 100, 5)), list(range(0, 72, 4))


def thresholds(rows: DataFrame, hundredths: list[int]) -> DataFrame:
    return rows.withColumn("threshold", F.explode(F.array(*(F.lit(x / 100) for x in hundredths))))


def two_way_reference(sim: DataFrame, ref: int, hundredths: list[int]) -> DataFrame:
    """In the reference's coordinates: recipient's similarity under the threshold."""
    rows = thresholds(sim.where((F.col("gid") == ref) & (F.col("other") != ref)), hundredths)
    return rows.select(F.col("other").alias("accession"), "chr", "start", "threshold", intervals.flag(F.col("sim") < F.col("threshold")).alias("flag"), F.lit("REF").alias("intro_type"))


def two_way_own(grouped: DataFrame, hundredths: list[int]) -> DataFrame:
    """In the accession's coordinates: the largest similarity to REF under the threshold."""
    rows = thresholds(grouped, hundredths)
    return rows.select(F.col("gid").alias("accession"), "chr", "start", "threshold", intervals.flag(F.col("ref_max") < F.col("threshold")).alias("flag"), F.lit("REFA").alias("intro_type"))


def three_way(grouped: DataFrame, compare: str, hundredths: list[int]) -> DataFrame:
    """Similarity to REF under 0.95, and that to the compared group above it by the threshold."""
    rows = thresholds(grouped, hundredths)
    hit = (F.col("ref") < 0.95) & (F.col("comp") >= F.col("ref") + F.col("threshold"))
    return rows.select(F.col("gid").alias("accession"), "chr", "start", "threshold", intervals.flag(hit).alias("flag"), F.lit(compare).alias("intro_type"))


def two_way(sim: DataFrame, grouped: DataFrame, ref: int, own: list[int], hundredths: list[int]) -> DataFrame:
    """Two-way calls of each accession in one view: its own coordinates if it is listed in own, else the reference's."""
    there = two_way_reference(sim, ref, hundredths).where(~F.col("accession").isin(own))
    here = two_way_own(grouped.where(F.col("gid").isin(own)), hundredths)
    return there.union(here)


def merged(calls: DataFrame) -> DataFrame:
    """A bin is introgressed if any compared group says so."""
    rows = calls.groupBy("accession", "chr", "start", "threshold").agg(F.max("flag").alias("flag"))
    return rows.withColumn("intro_type", F.lit("merged"))


def preprocess(sim: DataFrame, trim: float = -1.0, target: float = -1.0, edge: bool = False, size: int = 1, how: str = "mean") -> DataFrame:
    """Shift to the target mean, taper if asked, and smooth."""
    out = shift_to_target(sim, mean_similarity(sim, trim), target)
    out = taper(out) if edge else out
    return smooth(out, size, how) if size > 1 else out


def call(sim: DataFrame, groups: DataFrame, compare: list[str], hundredths: list[int], bin_size: int) -> DataFrame:
    """Intervals (accession, chr, intro_type, threshold, start, end) of three-way calls and their merger."""
    parts = [three_way(group_similarity(sim, groups.where(F.col("grp").isin("REF", g) | ~F.col("grp").isin(compare)), g), g, hundredths) for g in compare]
    calls = parts[0]
    for p in parts[1:]:
        calls = calls.union(p)
    if len(parts) > 1:
        calls = calls.union(merged(calls).select(calls.columns))
    return intervals.merge_bins(calls.where("flag = 1"), ["accession", "chr", "intro_type", "threshold"], bin_size)


def postprocess(series: DataFrame, actions: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Actions on a series, in the order given."""
    for action in actions:
        series = action(series)
    return series
