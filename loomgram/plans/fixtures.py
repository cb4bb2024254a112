"""Sequences, genes, intervals and groups derived from the given tables, and the index built on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgram.operators import bitmap, buckets, genes, intervals, kmers, runs, summary, zones
from loomgram.sources import sequences
from loomgram.tables import keep, table

#: k, genomes (sources), bin length and the length of a chromosome of intervals (30 days of seconds).
K, GENOMES, BIN, SPAN, HOUR = 21, 20, 200, 30 * 86400, 3600
#: Steps at which coarse bitmaps are stored, and genomes of the finer key.
STEPS, FINE = (20, 100), 100
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letter i stands for ACGT[i mod 4]; q, x and z are invalid bases.
BASES = "".join("N" if c in "qxz" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))


class Index:
    """Tables derived from one folder; positions, sets and bitmaps are written once for a session and read by the queries
    after. Written positions take 8 bytes a base; without them (kmers.positions) each reader makes the k-mers anew."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def seqs(self) -> DataFrame:
        """gid, chr, seq: a document is a chromosome of the genome its source stands for."""
        docs = table(self.spark, self.sf_dir, "documents").repartition(self.spark.sparkContext.defaultParallelism * 2, "doc_id")
        return docs.select(F.substring("source", 4, 9).cast("int").alias("gid"), F.col("doc_id").alias("chr"), sequences.mapped("text", LETTERS, BASES).alias("seq"))

    @cached_property
    def lengths(self) -> DataFrame:
        """gid, chr, length: seqs with the length of seq. A text is measured where it is read, so that none is exchanged for it."""
        docs = table(self.spark, self.sf_dir, "documents")
        length = F.length(sequences.mapped("text", LETTERS, BASES)).alias("length")
        rows = docs.select(F.substring("source", 4, 9).cast("int").alias("gid"), F.col("doc_id").alias("chr"), length)
        return keep(rows.repartition(self.spark.sparkContext.defaultParallelism * 2, "chr"))

    @cached_property
    def pos(self) -> DataFrame:
        return keep(kmers.positions(self.seqs, K))

    @cached_property
    def kmer_runs(self) -> DataFrame:
        """Runs of k-mers by minimizer bucket: two bytes a base. Rows are large, and a reader has a row group's in memory at a time."""
        bases = table(self.spark, self.sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return keep(buckets.super_kmers(kmers.tiles(self.seqs, K - 1), K, buckets.number_of(self.spark, bases)), **{"parquet.block.size": str(1 << 25)})

    @cached_property
    def sets(self) -> DataFrame:
        return keep(buckets.sets(self.kmer_runs, K))

    @property
    def bits(self) -> DataFrame:
        """gid, chr, pos, mask: positions are made of the runs when they are read."""
        return runs.decode(self.coded)

    @cached_property
    def coded(self) -> DataFrame:
        """The bitmap in runs of equal masks."""
        return keep(buckets.coded(self.kmer_runs, K))

    @cached_property
    def zoned(self) -> DataFrame:
        """The bitmap's runs with the masks of their blocks of positions."""
        return zones.store(zones.zoned(self.coded, GENOMES))

    @cached_property
    def zone_map(self) -> DataFrame:
        return keep(zones.zone_map(self.coded, GENOMES))

    @cached_property
    def coarse(self) -> dict[int, DataFrame]:
        """The bitmap at the steps that are stored beside the full one."""
        return {step: keep(bitmap.low_resolution(self.bits, step)) for step in STEPS}

    def at_step(self, step: int) -> DataFrame:
        """Positions divisible by step, from the coarsest bitmap stored that has them."""
        stored = bitmap.at_step(self.bits, step, self.coarse)
        return stored if step in STEPS else bitmap.low_resolution(stored, step)

    @property
    def fine_runs(self) -> DataFrame:
        """As kmer_runs, of 100 genomes: a document's source and the remainder of its number by 5 tell its genome."""
        return self.kmer_runs.withColumn("gid", F.zip_with("gid", "chr", lambda gid, chr_: gid * 5 + F.pmod(chr_, F.lit(5)).cast("int")))

    @cached_property
    def fine_sets(self) -> DataFrame:
        return keep(buckets.sets(self.fine_runs, K, FINE))

    @cached_property
    def fine_bits(self) -> DataFrame:
        return buckets.expanded(keep(buckets.anchored_runs(self.fine_runs, K, FINE)), FINE)

    @property
    def chrs(self) -> DataFrame:
        return summary.chromosomes(self.lengths, K)

    @property
    def features(self) -> DataFrame:
        """gid, chr, i, start, end, type, attr: a feature every 50 bases, some of which pass the end."""
        i = F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 50).cast("int"))).alias("i")
        rows = self.lengths.select("gid", "chr", i).withColumn("start", (F.col("i") * 50).cast("long"))
        rows = rows.withColumn("end", F.col("start") + 30 + (7 * F.col("chr") + 13 * F.col("i")) % 40)
        kind = F.when(F.col("i") % 3 == 0, "gene").when(F.col("i") % 3 == 1, "mRNA").otherwise("exon")
        parent = F.when(F.col("i") % 3 != 0, F.concat(F.lit(";Parent=d"), "chr", F.lit("_"), F.col("i") - 1)).otherwise("")
        name = F.when(F.col("i") % 6 == 0, F.concat(F.lit(";Name=g"), "chr", F.lit("_"), "i")).otherwise("")
        return rows.withColumn("type", kind).withColumn("attr", F.concat(F.lit("ID=d"), "chr", F.lit("_"), "i", parent, name))

    @property
    def named(self) -> DataFrame:
        return genes.named(self.features)

    @property
    def genes(self) -> DataFrame:
        return genes.valid(self.named.where("type = 'gene'"), self.chrs)[0]

    @property
    def groups(self) -> DataFrame:
        """gid, grp of the genomes there are."""
        gid = F.col("gid")
        grp = F.when(gid == 0, "REF").when(gid < 5, "WT").when(gid < 10, "WTB").otherwise("OFFSPRING")
        return self.seqs.select("gid").distinct().withColumn("grp", grp)

    @property
    def bed(self) -> DataFrame:
        """accession, chr, start, end, value of an interval for each event."""
        rows = table(self.spark, self.sf_dir, "events")
        start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
        rows = rows.select(F.concat(F.lit("u"), "user_id").alias("accession"), F.col("event_type").alias("chr"), start.alias("start"), "value")
        return rows.withColumn("end", F.col("start") + F.floor(F.col("value") * 60)).where("value is not null")

    @property
    def spans(self) -> DataFrame:
        return self.bed.select("accession", "chr").distinct().withColumn("size", F.lit(SPAN).cast("long"))

    @property
    def dense(self) -> DataFrame:
        """accession, chr, bin, flag: hours in which an interval of value 100 or more lies."""
        return intervals.dense(intervals.to_bins(self.bed.where("value >= 100"), HOUR), self.spans, ["accession", "chr"], HOUR)

    @property
    def flagged(self) -> DataFrame:
        """The rows of dense with flag 1."""
        return intervals.flagged(intervals.to_bins(self.bed.where("value >= 100"), HOUR), self.spans, ["accession", "chr"], HOUR)

    @property
    def truth(self) -> DataFrame:
        """accession, chr, bin, value: mean value by hour, by 200, up to 1."""
        rows = self.bed.withColumn("bin", F.floor(F.col("start") / HOUR) * HOUR)
        return rows.groupBy("accession", "chr", "bin").agg(F.least(F.lit(1.0), F.avg("value") / 200).alias("value"))


_known: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        _known[key] = Index(spark, sf_dir)
    return _known[key]
