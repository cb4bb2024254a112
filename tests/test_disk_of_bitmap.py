"""What a query leaves on disk: runs instead of positions, small parts, and shuffles that are given back."""

import random
import time

import numpy as np

from loomgram import tables
from loomgram.operators import buckets, kmers, runs, summary

R = random.Random(31)


def test_conserved_share_of_runs_is_that_of_positions(spark):
    rows, at = [], 0
    for i in range(200):
        length = R.choice([1, 3, 50, 130])
        rows.append((i % 2, R.choice([5, None]), at, length, R.getrandbits(4)))
        at += length
    coded = spark.createDataFrame(rows, "gid int, chr long, start long, length long, mask long")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(summary.conserved_share(coded, 4, 100).collect(), key=key)
    assert got == sorted(summary.conserved_share(runs.decode(coded), 4, 100).collect(), key=key) and len(got) > 50
    assert {float(r.unique) for r in got} != {0.0}


def test_parts_have_names_of_every_kind(spark):
    for kind, names in (("long", [2**62, -(2**62), 5, 6, None]), ("long", list(range(-9, 30))), ("string", ["a", None, "b"])):
        rows = [(R.randrange(4), c, "".join(R.choices("ACGT", k=R.randrange(30, 300)))) for c in names]
        seqs = spark.createDataFrame(rows, f"gid int, chr {kind}, seq string")
        got = buckets.super_kmers(kmers.tiles(seqs, 20), 21, 3)
        key = lambda r: tuple(str(x) for x in r)
        positions = runs.decode(buckets.coded(got, 21, parts=2)).select("gid", "chr", "pos", "mask").collect()
        assert sorted(positions, key=key) == sorted(buckets.anchored(got, 21).select("gid", "chr", "pos", "mask").collect(), key=key)


def test_names_of_many_chromosomes_are_small():
    steps = np.vstack([np.zeros(5000), np.cumsum(np.random.default_rng(1).integers(1, 9, 5000))]).astype(np.int64)
    assert len(buckets._squeezed(np.diff(steps, prepend=0))) < 5000


def test_kept_tables_give_their_shuffles_back(spark, monkeypatch):
    monkeypatch.setattr(tables, "LONG", 0)
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    tables.released(spark)
    time.sleep(2)
    before = files()
    kept = tables.keep(spark.range(1000).repartition(7).groupBy("id").count())
    end = time.monotonic() + 20
    while files() > before and time.monotonic() < end:
        time.sleep(0.2)
    assert files() <= before and kept.count() == 1000
