"""The bitmap in runs, and regions counted by running sums, against plain counts."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomgram.operators import bitmap, genes, runs, summary

R = random.Random(6)


@pytest.fixture(scope="module")
def bits(spark):
    rows = []
    for gid, chr_, n in ((0, 1, 700), (0, 2, 90), (3, 1, 333), (5, 9, 1)):
        mask, p = 1, 0
        while p < n:
            for _ in range(R.choice([1, 2, 30, 100])):
                if p < n and R.random() > 0.002:
                    rows.append((gid, chr_, p, mask))
                p += 1
            mask = R.choice([0, 1, 3, 6, 7, 9, 15])
    return spark.createDataFrame(rows, "gid int, chr long, pos long, mask long").coalesce(2)


@pytest.mark.parametrize("block", [None, 64])
def test_round_trip(spark, bits, block):
    got = runs.encode(bits, block=block)
    every = lambda df: sorted(map(tuple, df.select("gid", "chr", "pos", "mask").collect()))
    assert every(runs.decode(got)) == every(bits) and got.count() < bits.count() / 5
    mixed = runs.encode(bits.orderBy(F.rand(3)), block=block)
    assert every(runs.decode(mixed)) == every(bits)
    if block:
        assert got.where(F.floor(F.col("start") / block) != F.floor((F.col("start") + F.col("length") - 1) / block)).count() == 0
    wide = bits.select("gid", "chr", "pos", F.array(F.lit(0).cast("long"), "mask").alias("mask"))
    assert runs.encode(wide, block=block).count() == got.count()
    assert runs.encode(bits.limit(0)).count() == 0


def test_aggregates_by_length(spark, bits):
    coded = runs.encode(bits)
    for start, end, step in ((0, 700, 1), (37, 411, 10), (698, 5000, 7), (900, 1000, 1)):
        want = bitmap.query(bits, 0, 1, start, end, step)
        assert sorted(map(str, runs.query(coded, 0, 1, start, end, step).collect())) == sorted(map(str, want.select("gid", "chr", "pos", "mask").collect()))
    cut = runs.by_bin(coded, 50).select("gid", "chr", F.col("bin").alias("start"), "length", "mask")
    want = summary.mask_counts(bits.select("gid", "chr", (F.floor(F.col("pos") / 50) * 50).alias("start"), "mask"), "gid", "chr", "start")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(runs.mask_counts(cut, "gid", "chr", "start"), want)
    assert same(runs.pan_totals(coded, "gid"), summary.pan_totals(bits).where("chr is null"))


@pytest.mark.parametrize("cell", [16, 100, 1 << 20])
def test_regions_by_running_sums(spark, bits, cell):
    spots = [(0, 1), (0, 2), (3, 1), (5, 9), (7, 7)]
    regions = [(*R.choice(spots), a, a + R.choice([0, 1, 5, 40, 300, 1000]), f"r{i}") for i, a in enumerate(R.choices(range(-5, 720), k=120))]
    regions += [regions[3], regions[3], (0, 1, 0, 700, "whole"), (0, 1, 5, 3, "empty")]
    want = collections.Counter()
    at = collections.defaultdict(list)
    for r in bits.collect():
        at[r.gid, r.chr].append((r.pos, bin(r["mask"]).count("1")))
    for r in regions:
        for p, n in at[r[:2]]:
            if r[2] <= p < r[3]:
                want[(*r, n)] += 1
    table = spark.createDataFrame(regions, "gid int, chr long, start long, end long, name string")
    got = {tuple(r)[:6]: r.n for r in genes.pan_counts(bits, table, cell).collect()}
    assert got == dict(want)


def test_positions_do_not_meet_regions(spark, bits):
    table = spark.createDataFrame([(0, 1, 0, 600, "a")], "gid int, chr long, start long, end long, name string")
    plan = genes.pan_counts(bits, table)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "generate explode(sequence" not in plan.lower()
