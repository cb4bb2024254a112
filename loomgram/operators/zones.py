"""Zone maps of the bitmap: for each block of positions, the genomes that any and that all of its positions have.

Each position of the zoned bitmap carries its block's two masks as columns of truth values, any_i and all_i for genome i,
which are the same all over a block and take next to no room. A presence pattern is then a conjunction of plain
comparisons, which Spark pushes to the scan: row groups and pages of blocks that can't hold the pattern aren't read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import WORD, bit, words
from loomgram.operators import bitmap, runs
from loomgram.tables import keep

#: Positions of a block, and rows of a page of the stored table: a page is the least that a scan skips.
BLOCK, PAGE = 4096, 4096


def _parts(n: int) -> list[Column]:
    """The words of mask."""
    return [F.col("mask")] if n <= WORD else [F.get("mask", F.lit(w)) for w in range(words(n))]


def _flags(n: int) -> list[Column]:
    """any_i and all_i from the words any0, .. and all0, .. of a block."""
    whole = lambda name: F.col(f"{name}0") if n <= WORD else F.array(*(F.col(f"{name}{w}") for w in range(words(n))))
    return [(bit(whole(name), F.lit(i), n) == 1).alias(f"{name}_{i}") for name in ("any", "all") for i in range(n)]


def zoned(bits: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """bits (gid, chr, pos, mask of n genomes) plus any_0, .. and all_0, .. of each position's block.

    One shuffle by block, whose rows are at most `block` many. Rows are sorted by the genomes that any position of the block
    has before their place, so that blocks that are alike lie together and are skipped together, also where chromosomes are
    shorter than a block. Rows may also be runs (gid, chr, start, length, mask): they are cut at the blocks' ends and stay runs.
    """
    runs_ = "length" in bits.columns
    bits = runs.by_bin(bits, block) if runs_ else bits
    place = ["start", "length"] if runs_ else ["pos"]
    own = Window.partitionBy("gid", "chr", F.floor(F.col(place[0]) / block))
    masks = [f(x).over(own).alias(f"{name}{w}") for w, x in enumerate(_parts(n)) for name, f in (("any", F.bit_or), ("all", F.bit_and))]
    rows = bits.select("gid", "chr", *place, "mask", *masks)
    order = [f"any{w}" for w in range(words(n))]
    return rows.sortWithinPartitions(*order, "gid", "chr", place[0]).select("gid", "chr", *place, "mask", *_flags(n))


def store(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """Writes a zoned bitmap to the shared folder in pages of at most `page` rows, and reads it."""
    return keep(rows, **{"parquet.page.row.count.limit": str(page)})


def zone_map(bits: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """gid, chr, block, n, any_0, .., all_0, ..: one row for each block, n its positions."""
    masks = [f(x).alias(f"{name}{w}") for w, x in enumerate(_parts(n)) for name, f in (("any", F.bit_or), ("all", F.bit_and))]
    runs_ = "length" in bits.columns
    bits = runs.by_bin(bits, block) if runs_ else bits
    rows = bits.groupBy("gid", "chr", F.floor(F.col("start" if runs_ else "pos") / block).alias("block")).agg(runs.size(bits).alias("n"), *masks)
    return rows.select("gid", "chr", "block", "n", *_flags(n))


def possible(present: list[int], absent: list[int]) -> Column:
    """Whether a block may hold a position in all genomes of present and in none of absent."""
    return reduce(and_, [*(F.col(f"any_{i}") == F.lit(True) for i in present), *(F.col(f"all_{i}") == F.lit(False) for i in absent)], F.lit(True))


def certain(present: list[int], absent: list[int]) -> Column:
    """Whether all positions of a block are such ones."""
    return reduce(and_, [*(F.col(f"all_{i}") == F.lit(True) for i in present), *(F.col(f"any_{i}") == F.lit(False) for i in absent)], F.lit(True))


def pattern(rows: DataFrame, present: list[int], absent: list[int]) -> DataFrame:
    """gid, chr, pos, mask of a zoned bitmap's positions in all genomes of present and in none of absent: bitmap.pattern(),
    reading only pages of blocks that may hold one."""
    met = bitmap.pattern(rows.where(possible(present, absent)), present, absent)
    return runs.decode(met) if "length" in rows.columns else met.select("gid", "chr", "pos", "mask")


def pattern_totals(rows: DataFrame, zones: DataFrame, present: list[int], absent: list[int], *keys: str) -> DataFrame:
    """keys (of gid, chr), n: how many positions pattern() has.

    Blocks all of whose positions fit are counted from the zone map, blocks that can't hold any not at all; only the
    positions of the others are read.
    """
    sure = zones.where(certain(present, absent)).groupBy(*keys).agg(F.sum("n").alias("n"))
    rest = bitmap.pattern(rows.where(possible(present, absent)).where(~certain(present, absent)), present, absent)
    rest = rest.groupBy(*keys).agg(runs.size(rest).alias("n"))
    return sure.union(rest).groupBy(*keys).agg(F.sum("n").alias("n"))
