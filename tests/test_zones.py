"""Presence patterns from zone maps: the same rows, and blocks that can't hold one aren't read."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomgram.operators import bitmap, zones

R = random.Random(8)
PATTERNS = [([1, 2], [3, 4]), ([0], []), ([], [0]), ([], []), ([4], [0, 1, 2, 3]), ([0, 1, 2, 3, 4], [])]


def masks(n):
    """Stretches of positions whose masks have much in common."""
    out = []
    while len(out) < n:
        must, may = R.choice([0, 1, 6, 22, 31]), R.choice([0, 0, 1, 31])
        out += [must | (R.getrandbits(5) & may) for _ in range(R.choice([3, 100, 400]))]
    return out[:n]


@pytest.fixture(scope="module")
def bits(spark):
    rows = [(gid, chr_, p, m) for gid, chr_, n in ((0, 1, 3000), (0, 2, 10), (3, 1, 999), (4, 9, 1)) for p, m in enumerate(masks(n))]
    return spark.createDataFrame(rows, "gid int, chr long, pos long, mask long")


def rows_read(df):
    """Rows that the plan's only scan handed on, once df has run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan()
    leaves = leaves.executedPlan() if leaves.nodeName() == "AdaptiveSparkPlan" else leaves
    scan = leaves.collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize(("present", "absent"), PATTERNS)
def test_same_rows(spark, bits, present, absent):
    got = zones.pattern(zones.zoned(bits, 5, 64), present, absent)
    want = bitmap.pattern(bits, present, absent)
    every = lambda df: sorted(map(tuple, df.collect()))
    assert every(got) == every(want)
    wide = bits.withColumn("mask", F.array("mask", F.lit(5).cast("long")))
    more = zones.pattern(zones.zoned(wide, 70, 64), [*present, 63], [*absent, 64])
    assert sorted(tuple(r)[:3] for r in more.collect()) == sorted(tuple(r)[:3] for r in want.collect())
    totals = zones.pattern_totals(zones.zoned(bits, 5, 64), zones.zone_map(bits, 5, 64), present, absent, "gid", "chr")
    assert {(r.gid, r.chr): r.n for r in totals.collect()} == dict(collections.Counter((r.gid, r.chr) for r in want.collect()))


def test_zone_map_is_the_or_and_the_and(bits):
    got = {(r.gid, r.chr, r.block): r for r in zones.zone_map(bits, 5, 100).collect()}
    own = collections.defaultdict(list)
    for r in bits.collect():
        own[r.gid, r.chr, r.pos // 100].append(r["mask"])
    assert got.keys() == own.keys()
    for k, v in own.items():
        assert got[k].n == len(v)
        for i in range(5):
            assert got[k][f"any_{i}"] == any(m >> i & 1 for m in v) and got[k][f"all_{i}"] == all(m >> i & 1 for m in v)


def test_blocks_that_cannot_hold_the_pattern_are_not_read(spark):
    """200 blocks of 1,000 positions; two hold genome 3, and one of them is full of it."""
    mask = F.when(F.col("id").between(50_000, 50_999), 9).when(F.col("id") == 120_500, 8).otherwise(F.lit(1) + F.col("id") % 2 * 2)
    bits = spark.range(200_000, numPartitions=2).select(F.lit(0).alias("gid"), F.lit(1).cast("long").alias("chr"), F.col("id").alias("pos"), mask.cast("long").alias("mask"))
    stored = zones.store(zones.zoned(bits, 4, 1000).coalesce(1), 500)
    assert rows_read(stored) == 200_000
    found = zones.pattern(stored, [3], [])
    assert rows_read(found) <= 5_000 and found.count() == 1001
    text = found._jdf.queryExecution().toString()
    assert "EqualTo(any_3,true)" in text
    assert rows_read(zones.pattern(stored, [3], [0])) <= 3_000
    totals = zones.pattern_totals(stored, zones.zone_map(bits, 4, 1000), [3], [], "gid")
    assert [tuple(r) for r in totals.collect()] == [(0, 1001)]


def test_nothing(bits):
    assert zones.pattern(zones.zoned(bits.limit(0), 5), [1], [2]).count() == 0
    assert zones.pattern_totals(zones.zoned(bits.limit(0), 5), zones.zone_map(bits.limit(0), 5), [1], [2], "gid").count() == 0
