"""Genes and annotations: names, types, range queries and interval joins with positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import attribute, pan_count
from loomgram.operators import runs
from loomgram.sources.readers import write_genome_part
from loomgram.tables import keep


#: Runs and regions of the cells that one task looks at together, about.
GROUP_ROWS = 500_000


def named(features: DataFrame, name: str = "Name") -> DataFrame:
    """features (.., attr) plus id, parent and name: the name attribute, else the ID."""
    own = features.withColumn("id", attribute(F.col("attr"), "ID")).withColumn("parent", attribute(F.col("attr"), "Parent"))
    return own.withColumn("name", F.coalesce(attribute(F.col("attr"), name), F.col("id")))


def roots(features: DataFrame) -> DataFrame:
    """gid, id, root: the last ancestor of each feature, by pointer jumping; rows without ID can't be parents.

    Each round doubles the distance; a chain that leaves the table ends at its last known member. Chains of n
    features end after log2(n) rounds; what still moves then is in a cycle of parents or hangs on one, and has a null
    root.
    """
    known = features.where("id is not null").select("gid", "id", "parent").dropDuplicates(["gid", "id"])
    up = known.select("gid", F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = known.join(up, ["gid", "parent"], "left").select("gid", "id", F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("root"))
    links = keep(links)
    for _ in range(max(1, links.count()).bit_length() + 1):
        next_ = links.select("gid", F.col("id").alias("root"), F.col("root").alias("further"))
        jumped = keep(links.join(next_, ["gid", "root"]).select("gid", "id", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return links
    return jumped.select("gid", "id", F.when(~F.col("moved"), F.col("root")).alias("root"))


def annotation_names(features: DataFrame) -> DataFrame:
    """features plus root_name: the root's name for a feature with a parent, else its own."""
    top = roots(features).join(features.select("gid", F.col("id").alias("root"), F.col("name").alias("top_name")).dropDuplicates(["gid", "root"]), ["gid", "root"], "left")
    met = features.join(top.select("gid", "id", "top_name"), ["gid", "id"], "left")
    return met.withColumn("root_name", F.when(F.col("parent").isNotNull(), F.col("top_name")).otherwise(F.col("name"))).drop("top_name")


def type_ids(features: DataFrame, order: str) -> DataFrame:
    """type, type_id: exon has 0, the others count from 1 by first appearance."""
    first = features.groupBy("type").agg(F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(F.col("type") == "exon").orderBy("first"))
    return first.select("type", F.when(F.col("type") == "exon", 0).otherwise(rank).alias("type_id"))


def split_types(features: DataFrame, gene_types: list[str], anno_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(genes, annotations): by default every type that isn't a gene's; duplicates and transcripts are left out."""
    genes = features.where(F.col("type").isin(gene_types))
    rest = features.where(F.col("type").isin(anno_types)) if anno_types else features.where(~F.col("type").isin(gene_types))
    return genes, rest.where(F.col("type") != "transcript").dropDuplicates(["gid", "chr", "start", "end", "type", "attr"])


def valid(features: DataFrame, chrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): on a known chromosome, within it and not empty."""
    met = features.join(chrs.select("gid", "chr", "size"), ["gid", "chr"], "left")
    ok = F.coalesce((F.col("end") > F.col("start")) & (F.col("start") >= 0) & (F.col("end") <= F.col("size")), F.lit(False))
    return met.where(ok).drop("size"), met.where(~ok)


def reannotate(features: DataFrame, chrs: DataFrame, path: str, gene_types: list[str], annotations_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(genes, annotations) of the tables in path, after those of the genomes in features have been replaced.

    features: records (gid, chr, start, end, type, attr); genes that pass their chromosome's end are left out. The other
    genomes' partitions stay as they are. annotations_only leaves all genes as they are.
    """
    own, others = split_types(named(features), gene_types)
    if not annotations_only:
        write_genome_part(valid(own, chrs)[0], f"{path}/genes")
    write_genome_part(others, f"{path}/annotations")
    read = features.sparkSession.read
    return read.parquet(f"{path}/genes"), read.parquet(f"{path}/annotations")


def overlapping(features: DataFrame, chr_: object, start: int, end: int) -> DataFrame:
    """Features (1-based records) that overlap [start, end) of a chromosome; chr_ None: of any."""
    near = (F.col("start") - 1 < end) & (F.col("end") > start)
    return features.where(near if chr_ is None else near & (F.col("chr") == F.lit(chr_)))


def is_local(start: Column, end: Column, low: int, high: int) -> Column:
    return F.greatest(start, F.lit(low)) < F.least(end, F.lit(high))


def _block_counts(runs: pa.Table, parts: pa.Table, cell: int) -> pa.Table:
    """region, pan_count, n (positions) of the parts of regions in some cells, by running sums over their runs of each pan-count.

    Cells are laid side by side, twice their length apart, so that one pass serves all of them; the sums of earlier ones cancel.
    """
    out: list[tuple[np.ndarray, ...]] = []
    if runs.num_rows and parts.num_rows:
        name = lambda t: pc.binary_join_element_wise(*(t.column(c).cast(pa.string()) for c in ("gid", "cell", "chr")), "|")
        code = pa.concat_arrays([name(t).combine_chunks() for t in (runs, parts)]).dictionary_encode().indices.to_numpy().astype(np.int64)
        away = [2 * cell * c - cell * t.column("cell").to_numpy() for c, t in zip(np.split(code, [runs.num_rows]), (runs, parts))]
        start, length, pan = (runs.column(c).to_numpy() for c in ("start", "length", "pan_count"))
        low, high, region = (parts.column(c).to_numpy() for c in ("low", "high", "region"))
        start, low, high = start + away[0], low + away[1], high + away[1]
        order = np.lexsort((start, pan))
        start, length, pan = start[order], length[order], pan[order]
        edge = np.flatnonzero(np.r_[True, pan[1:] != pan[:-1], True])
        for a, b in zip(edge[:-1], edge[1:]):
            s, n = start[a:b], length[a:b]
            total = np.r_[0, np.cumsum(n)]

            def before(x: np.ndarray) -> np.ndarray:
                at = np.maximum(np.searchsorted(s, x, "right") - 1, 0)
                return total[at] + np.clip(x - s[at], 0, n[at])

            here = before(high) - before(low)
            hit = np.flatnonzero(here)
            out.append((region[hit], np.full(len(hit), pan[a]), here[hit]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.Table.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int64))], ["region", "pan_count", "n"])


def pan_counts(bits: DataFrame, regions: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """regions' key columns (gid, chr, start, end, name) by pan_count, n: positions in each region.

    Positions become runs of one pan-count within cells of `cell` positions before they are shuffled, and a cell's running sums
    are read at the ends of the regions in it. Of a region over several cells only the first and the last are looked into: the
    cells between are the difference of two sums over whole cells. No position meets a region. A position is counted
    once if the bitmap has it once; regions that are there more than once are counted as often.
    """
    keys = ["gid", "chr", "start", "end", "name"]
    of = regions.where("end > start and gid is not null and chr is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    of = keep(of.withColumn("region", F.monotonically_increasing_id()))
    known = bits.where("gid is not null and chr is not null")
    if "length" in bits.columns:
        cut = runs.by_bin(known.select("gid", "chr", "start", "length", pan_count(bits).alias("mask")), cell)
        rows = keep(cut.select("gid", "chr", "start", "length", F.col("mask").alias("pan_count"), F.floor(F.col("bin") / cell).alias("cell")))
    else:
        rows = keep(runs.encode(known.select("gid", "chr", "pos", pan_count(bits).alias("pan_count")), "pan_count", cell).withColumn("cell", F.floor(F.col("start") / cell)))
    first, last = F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)
    ends = F.explode(F.array_distinct(F.array(first, last))).alias("cell")
    parts = of.select("gid", "chr", ends, "region", "start", "end").select("gid", "chr", "cell", "region", F.greatest("start", F.col("cell") * cell).alias("low"), F.least("end", (F.col("cell") + 1) * cell).alias("high"))
    parts = keep(parts)
    groups = max(2 * bits.sparkSession.sparkContext.defaultParallelism, (rows.count() + parts.count()) // GROUP_ROWS)
    group = F.pmod(F.xxhash64("gid", "chr", "cell"), F.lit(groups)).alias("group")
    near = rows.select("gid", "chr", "cell", "start", "length", "pan_count", group).groupBy("group").cogroup(parts.select("*", group).groupBy("group"))
    found = near.applyInArrow(lambda a, b: _block_counts(a, b, cell), "region long, pan_count int, n long")
    # whole cells between the ends: sums of all cells before a cell, for each pan-count that the chromosome has
    cells = keep(rows.groupBy("gid", "chr", "cell", "pan_count").agg(F.sum("length").alias("n")))
    wide = keep(of.where(last - first > 1).select("gid", "chr", "region", (first + 1).alias("from"), last.alias("to")))
    if not wide.isEmpty():
        asked = wide.select("gid", "chr", F.explode(F.array("from", "to")).alias("cell")).distinct()
        kinds = cells.select("gid", "chr", "pan_count").distinct()
        every = cells.withColumn("asked", F.lit(0)).unionByName(asked.join(kinds, ["gid", "chr"]).withColumn("n", F.lit(0).cast("long")).withColumn("asked", F.lit(1)))
        sums = F.sum("n").over(Window.partitionBy("gid", "chr", "pan_count").orderBy("cell").rangeBetween(Window.unboundedPreceding, -1))
        before = keep(every.withColumn("n", F.coalesce(sums, F.lit(0))).where("asked = 1").select("gid", "chr", "cell", "pan_count", "n"))
        at = lambda c, sign: wide.withColumnRenamed(c, "cell").join(before, ["gid", "chr", "cell"]).select("region", "pan_count", (F.col("n") * sign).alias("n"))
        found = found.union(at("to", 1)).union(at("from", -1))
    # dealt by region alone, which serves the sums, the join and what is added up by region after it
    counts = found.repartition("region").groupBy("region", "pan_count").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.join(of, "region").select(*keys, "pan_count", (F.col("n") * F.col("times")).alias("n"))


def gene_conservation(counts: DataFrame, n: int) -> DataFrame:
    """n_unique and n_universal of each gene, from pan_counts()."""
    size = lambda k: F.coalesce(F.sum(F.when(F.col("pan_count") == k, F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy("gid", "chr", "start", "end", "name").agg(size(1).alias("n_unique"), size(n).alias("n_universal"))


def region_moments(counts: DataFrame) -> DataFrame:
    """Mean and sample deviation of the pan-count in each region, from pan_counts()."""
    total, s, q = F.sum("n"), F.sum(F.col("n") * F.col("pan_count")), F.sum(F.col("n") * F.col("pan_count") * F.col("pan_count"))
    out = counts.groupBy("gid", "chr", "start", "end", "name").agg(total.alias("n"), s.alias("s"), q.alias("q"))
    average = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * average, F.col("n") - 1)))
    return out.select("gid", "chr", "start", "end", "name", "n", average.alias("average"), F.when(F.col("n") > 1, spread).alias("deviation"))


def gene_counts(chrs: DataFrame, genes: DataFrame) -> DataFrame:
    n = genes.groupBy("gid", "chr").agg(F.count(F.lit(1)).alias("gene_count"))
    return chrs.join(n, ["gid", "chr"], "left").withColumn("gene_count", F.coalesce("gene_count", F.lit(0).cast("long")))


def gene_density(genes: DataFrame, bin_size: int) -> DataFrame:
    return genes.groupBy("gid", "chr", F.floor(F.col("start") / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("genes"))


def gene_ranking(conservation: DataFrame, column: str) -> DataFrame:
    """Share of the gene's length and rank in its genome, the largest share first."""
    share = F.col(column) / (F.col("end") - F.col("start"))
    order = Window.partitionBy("gid").orderBy(F.desc("share"), "chr", "start", "end", "name")
    return conservation.withColumn("share", share).withColumn("rank", F.row_number().over(order))


def region_label(genes: DataFrame, regions: DataFrame, most: int = 25, cell: int = 1 << 16) -> DataFrame:
    """regions (gid, chr, low, high) plus genes: names of those that overlap, or how many if over `most`.

    Genes and regions are dealt to cells of `cell` positions and meet in a join on equal keys, in the first cell that
    they share. Names are gathered only where they are `most` at most.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))).alias("cell")
    own = regions.select("gid", "chr", "low", "high").distinct()
    left = own.where("high > low").select("*", cells(F.col("low"), F.col("high")))
    right = genes.where("end > start").select("gid", "chr", "start", "end", "name", cells(F.col("start"), F.col("end")))
    met = left.join(right, ["gid", "chr", "cell"]).where(F.greatest("start", "low") < F.least("end", "high")).where(F.floor(F.greatest("start", "low") / cell) == F.col("cell"))
    region = ["gid", "chr", "low", "high"]
    n = keep(met.groupBy(*region).agg(F.count("name").alias("n")))
    names = met.join(n.where(F.col("n") <= most), region, "left_semi").groupBy(*region).agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = own.join(n, region, "left").join(names, region, "left")
    few = F.array_join(F.coalesce("names", F.array().cast("array<string>")), ", ")
    return out.select(*region, F.when(F.coalesce("n", F.lit(0)) <= most, few).otherwise(F.col("n").cast("string")).alias("genes"))
