"""Trees of a region: those of the positions in it, as if there were no others."""

import random

import pytest
from pyspark.sql import functions as F

from loomgram.operators import cluster, distance, summary

R = random.Random(12)


@pytest.fixture(scope="module")
def bits(spark):
    rows = [(gid, chr_, p, R.getrandbits(6) | 1 << gid) for gid, chr_, n in ((0, 1, 400), (0, 2, 150), (3, 1, 260), (4, 9, 20)) for p in range(n)]
    return spark.createDataFrame(rows, "gid int, chr long, pos long, mask long")


def every(df):
    return sorted((r.gid, r.step, r.left, r.right, round(r.height, 9), r.size) for r in df.collect())


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
@pytest.mark.parametrize("chr_", [None, 1])
def test_only_the_region_counts(bits, method, chr_):
    near = bits.where("pos >= 50 and pos < 200" + ("" if chr_ is None else f" and chr = {chr_}"))
    want = cluster.tree(distance.column_distance(summary.mask_counts(near, "gid"), ["gid"], 6), ["gid"], method)
    got = cluster.region_trees(bits, (50, 200), 6, chr_, method)
    assert every(got) == every(want) and {r.gid for r in got.collect()} == {0, 3}


def test_heights_are_distances_of_the_region(bits):
    """The first merge joins the two genomes that differ least, by a plain count."""
    rows = [r["mask"] for r in bits.where("gid = 0 and pos >= 10 and pos < 90").collect()]
    dist = {(a, b): sum((m >> a ^ m >> b) & 1 for m in rows) ** 0.5 for a in range(6) for b in range(a + 1, 6)}
    first = cluster.region_trees(bits, (10, 90), 6).where("gid = 0 and step = 0").first()
    assert first.height == pytest.approx(min(dist.values())) and dist[first.left, first.right] == min(dist.values())


def test_the_range_reaches_the_scan(spark, bits, tmp_path):
    bits.write.parquet(str(tmp_path / "bits"))
    stored = spark.read.parquet(str(tmp_path / "bits"))
    plan = cluster.region_counts(stored, (50, 200), 1)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pos,50)" in plan and "LessThan(pos,200)" in plan and "EqualTo(chr,1)" in plan


def test_an_empty_region(bits):
    assert cluster.region_trees(bits, (5000, 6000), 6).count() == 0
    assert cluster.region_trees(bits.where(F.lit(False)), (0, 10), 6).count() == 0
