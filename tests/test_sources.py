"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from loomgram.functions import columns
from loomgram.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_plain_and_gzipped(spark, tmp_path):
    text = ">one first\nACGT\nNN\n>two\nGGG\n"
    a = put(tmp_path / "a.fa", text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    for path in (a, str(tmp_path / "b.fa.gz")):
        assert {(r.chr, r.seq) for r in readers.fasta(spark, path).collect()} == {("one", "ACGTNN"), ("two", "GGG")}


def test_fastq(spark, tmp_path):
    path = put(tmp_path / "r.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert {(r.chr, r.seq) for r in readers.fastq(spark, path).collect()} == {("r1", "ACGT"), ("r2", "GG")}


def test_gff_bed_and_empty(spark, tmp_path):
    path = put(tmp_path / "a.gff", "##gff\nchr1\ts\tgene\t10\t20\t.\t+\t.\tID=a;Name=b\n")
    r = readers.gff(spark, path).first()
    assert (r.chr, r.start, r.end, r.type, r.attr) == ("chr1", 10, 20, "gene", "ID=a;Name=b")
    assert readers.bed(spark, put(tmp_path / "e.bed", "")).count() == 0
    assert readers.bed(spark, put(tmp_path / "f.bed", "c\t1\t2\tx\n")).first().end == 2


def test_samples_and_groups(spark, tmp_path):
    rows = readers.samples(spark, put(tmp_path / "s.tsv", "name\tfasta\na\ta.fa\nb\tb.fa\n"), ["b"]).orderBy("id").collect()
    assert [(r.name, r.id, r.anchor, r.gff) for r in rows] == [("a", 0, False, None), ("b", 1, True, None)]
    with pytest.raises(ValueError):
        readers.samples(spark, put(tmp_path / "t.tsv", "name\tfasta\na b\ta.fa\n"))
    with pytest.raises(ValueError):
        readers.samples(spark, put(tmp_path / "u.tsv", "name\na\n"))
    with pytest.raises(ValueError):
        readers.groups(spark, put(tmp_path / "g.tsv", "name\tgroup\na\tW_T\n"))


def test_truth_paf_edges_regions(spark, tmp_path):
    t = readers.truth(spark, put(tmp_path / "t.txt", "Sample\t0\t10\na\t0.5\t\n"))
    assert {(r.accession, r.bin, r.value) for r in t.collect()} == {("a", 0, 0.5), ("a", 10, 0.0)}
    p = readers.paf(spark, put(tmp_path / "a.paf", "q\t10\t0\t10\t-\tt\t20\t5\t15\t10\t10\t60\ttp:A:P\tcg:Z:10M\n")).first()
    assert (p.query, p.strand, p.t_start, p.cigar) == ("q", "-", 5, "10M")
    assert readers.edges(spark, put(tmp_path / "d.tsv", "a\tb\t0.1\t0\t9/10\n")).first().dist == 0.1
    assert readers.feature_table(spark, put(tmp_path / "c.tsv", "n\tc\t5\t9\t1.5\t0.2\tx\n")).first().length == 4


def test_bitmap_round_trip_and_partition_overwrite(spark, tmp_path):
    bits = spark.createDataFrame([(g, 1, p, 1) for g in (0, 1) for p in range(5)], "gid int, chr long, pos long, mask long")
    path = str(tmp_path / "bits")
    readers.write_bitmap(bits, path)
    readers.write_genome_part(bits.where("gid = 1 and pos < 2"), path)
    back = spark.read.parquet(path)
    assert {r.gid: r["count"] for r in back.groupBy("gid").count().collect()} == {0: 5, 1: 2}
    plan = back.where("gid = 1 and pos >= 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gid" in plan and "GreaterThanOrEqual(pos,3)" in plan


def test_region_strings(spark):
    rows = spark.createDataFrame([("g:chr1:5-10",), ("chr2:1-2",), ("bad",)], "s string").select(columns.region(F.col("s")).alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [("g", "chr1", 5, 10), (None, "chr2", 1, 2), (None, None, None, None)]
