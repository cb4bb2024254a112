"""Tiles of FASTA files that are read in byte ranges."""

import gzip
import random
import resource

import pytest
from pyspark.sql import functions as F

from loomgram.operators import buckets, kmers
from loomgram.sources.readers import fasta
from loomgram.sources.sequences import fasta_tiles

R = random.Random(3)


def dna(n):
    return "".join(R.choice("ACGTNacgt") for _ in range(n))


def records(n, most):
    return [(f"r{i}", dna(R.choice([0, 1, 3, most // 7, most]))) for i in range(n)]


def write(path, rows, width, end="\n", open_=open):
    with open_(path, "wt") as f:
        for name, seq in rows:
            f.write(f">{name} described here{end}")
            for i in range(0, len(seq), width):
                f.write(seq[i : i + width] + end)


@pytest.mark.parametrize(("block", "overlap", "size", "width"), [(64, 20, 32, 7), (100, 3, 10, 60), (37, 20, 1000, 5), (1 << 20, 20, 64, 60), (200, 0, 16, 13)])
def test_tiles_of_byte_ranges(spark, tmp_path, block, overlap, size, width):
    files = {}
    for i, (end, zipped) in enumerate([("\n", False), ("\r\n", False), ("\n", True)]):
        files[f"f{i}.fa{'.gz' if zipped else ''}"] = rows = records(9, 900)
        write(tmp_path / list(files)[-1], rows, width, end, gzip.open if zipped else open)
    (tmp_path / "lead.fa").write_text("ACGT\nAC\n>x\nGG\n\nTT\n>\nA\n>last")
    files["lead.fa"] = [("x", "GGTT"), ("", "A"), ("last", "")]
    (tmp_path / "none.fa").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        rows = fasta_tiles(spark, str(tmp_path), overlap=overlap, size=size).collect()
    finally:
        for x in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{x}")
    for name, want in files.items():
        got = {}
        for r in rows:
            if r.path.endswith("/" + name):
                got.setdefault(r.chr, []).append((r["at"], r.tile))
        assert set(got) == {c for c, s in want if s}
        for chr_, seq in want:
            windows = []
            for at, tile in got.get(chr_, []):
                assert seq[at : at + len(tile)] == tile and len(tile) <= size + 2 * overlap
                windows += range(at, at + len(tile) - overlap)
            # each window of overlap + 1 bases is in exactly one tile
            assert sorted(windows) == list(range(max(0, len(seq) - overlap)))


def test_same_kmers_as_whole_records(spark, tmp_path):
    write(tmp_path / "a.fa", records(30, 4000), 60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        cut = fasta_tiles(spark, str(tmp_path / "a.fa"), overlap=20, size=256).select(F.lit(0).alias("gid"), "chr", "at", "tile")
        got = buckets.anchored(buckets.super_kmers(cut, 21, 5), 21)
        whole = kmers.positions(fasta(spark, str(tmp_path / "a.fa")).select(F.lit(0).alias("gid"), "chr", "seq"), 21)
        rows = lambda df: sorted(map(str, df.select("gid", "chr", "pos", "mask").collect()))
        assert rows(got) == rows(kmers.anchor(whole, kmers.kmer_sets(whole)))
    finally:
        for x in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{x}")


def test_a_record_larger_than_a_batch_of_lines(spark, tmp_path):
    """40 MB of one record: the tile sizes tell that no row holds it."""
    line = (dna(60) + "\n").encode()
    with open(tmp_path / "long.fa", "wb") as f:
        f.write(b">one\n" + line * 700_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    r = fasta_tiles(spark, str(tmp_path / "long.fa"), overlap=20).agg(F.sum(F.length("tile") - 20).alias("n"), F.max(F.length("tile")).alias("most"), F.count(F.lit(1)).alias("tiles")).first()
    assert r.n == 42_000_000 - 20 and r.most < 2 * (1 << 16) and r.tiles > 600
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
