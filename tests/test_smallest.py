"""Bottom-s selections against plain sorts, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from loomgram.operators import bitmap, distance
from loomgram.operators.smallest import smallest, smallest_distinct

R = random.Random(9)


@pytest.mark.parametrize("most", [1, 7, 300, 5000])
def test_first_rows_of_each_key(spark, most):
    rows = [(k, R.randrange(1000), i) for k, n in (("a", 3000), ("b", 300), ("c", 1), ("d", 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, h long, i long").repartition(5)
    got = sorted(map(tuple, smallest(df, ["k"], ["h", "i"], F.col("h") / 1000, most).collect()))
    assert got == sorted(r for k in "abcd" for r in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:])[:most])


@pytest.mark.parametrize("most", [1, 50, 2000])
def test_distinct_values(spark, most):
    rows = [(g, R.randrange(2**20)) for g in range(3) for _ in range(900)] * 3 + [(3, 5), (4, 7)] + [(5, 2**20 - 1 - i) for i in range(100)]
    got = sorted(map(tuple, smallest_distinct(spark.createDataFrame(rows, "g int, h long"), "g", "h", 0.0, 2.0**20, most).collect()))
    assert got == sorted((g, h) for g in range(6) for h in sorted({h for x, h in rows if x == g})[:most])


def test_few_rows_are_sorted(spark):
    """The window sees about as many rows as are asked for, not all of a chromosome."""
    bits = spark.range(200_000).select(F.lit(0).alias("gid"), F.lit(1).cast("long").alias("chr"), F.col("id").alias("pos"), F.lit(1).cast("long").alias("mask"))
    out = bitmap.sample(bits, 1500)
    assert out.count() == 1500
    want = bits.withColumn("h", F.md5(F.concat_ws(":", "gid", "chr", "pos"))).orderBy("h", "pos").limit(1500)
    assert {r.pos for r in out.collect()} == {r.pos for r in want.collect()}
    # rows that reach the window: those up to the last bin
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "gid", "chr", "pos")), 1, 12), 16, 10).cast("double") / 2.0**48
    bins = -(-200_000 * 16 // 1500)
    last = max(r["b"] for r in out.select(F.floor(h * bins).alias("b")).collect())
    assert bits.where(F.floor(h * bins) <= last).count() < 1700


def test_sketch_of_a_large_genome(spark):
    pos = spark.range(60_000).select((F.col("id") % 2).cast("int").alias("gid"), F.when(F.col("id") % 10 < 9, F.floor(F.col("id") / 4)).alias("kmer"))
    want = {}
    for r in pos.where("kmer is not null").select("gid", F.xxhash64("kmer").alias("h")).distinct().collect():
        want.setdefault(r.gid, []).append(r.h)
    got = {}
    for r in distance.sketch(pos, 2000).collect():
        got.setdefault(r.gid, []).append(r.h)
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x)[:2000] for g, x in want.items()}
