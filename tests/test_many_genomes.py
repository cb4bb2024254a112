"""Any number of genomes: masks of several words against plain sets, and distances against plain counts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgram.functions import columns
from loomgram.operators import bitmap, distance, genes, kmers, summary

R = random.Random(3)
K, N = 5, 130


@pytest.fixture(scope="module")
def made(spark):
    texts = {g: "".join(R.choice("ACGT") for _ in range(30)) + R.choice(["AACCGGTTAC", "TTGACCATGA", "N"]) for g in range(N)}
    pos = kmers.positions(spark.createDataFrame([(g, 7, t) for g, t in texts.items()], "gid int, chr long, seq string"), K)
    sets = kmers.kmer_sets(pos, n=N)
    rows = pos.collect()
    holds: dict[int, set[int]] = {}
    for r in rows:
        if r.kmer is not None:
            holds.setdefault(r.kmer, set()).add(r.gid)
    return pos, sets, kmers.anchor(pos, sets, N), rows, holds


def test_wide_sets_and_positions(made):
    pos, sets, bits, rows, holds = made
    got = {r.kmer: set(r.m) for r in sets.select("kmer", columns.members(F.col("mask"), N).alias("m")).collect()}
    assert got == holds and max(map(max, holds.values())) > 126
    at = {(r.gid, r.pos): set(r.m) for r in bits.select("gid", "pos", columns.members(F.col("mask"), N).alias("m")).collect()}
    assert at == {(r.gid, r.pos): holds.get(r.kmer, set()) for r in rows}


def test_wide_summaries(made):
    _, _, bits, rows, holds = made
    own = {g: [holds.get(r.kmer, set()) for r in rows if r.gid == g] for g in range(N)}
    got = {(r.gid, r.pan_count): r.n for r in summary.pan_totals(bits).where("chr is null").collect()}
    assert all(n == sum(len(x) == c for x in own[g]) for (g, c), n in got.items()) and sum(got.values()) == len(rows)
    pairs = {(r.gid, r.other): r.n for r in summary.pair_totals(bits, N).collect()}
    assert len(pairs) == N * N and all(n == sum(o in x for x in own[g]) for (g, o), n in pairs.items())
    flat = [x for own_ in own.values() for x in own_]
    assert bitmap.pattern(bits, [3], [64, 129]).count() == sum(3 in x and 64 not in x and 129 not in x for x in flat)
    assert bitmap.omit_fixed(bits, 2).count() == sum(len(x) < 2 for x in flat)
    kept = columns.mask_of([0, 127], N)
    new = bitmap.neutralise_unique(bits, kept).select(columns.members(F.col("mask"), N).alias("m")).collect()
    assert sorted(map(sorted, (r.m for r in new))) == sorted(sorted(x if x & {0, 127} else x | {0, 127}) for x in flat)
    assert bitmap.unpack(bits.where("gid = 1"), N).agg(F.sum("bit")).first()[0] == sum(map(len, own[1]))
    counts = genes.pan_counts(bits, bits.sparkSession.createDataFrame([(1, 7, 3, 20, "x")], "gid int, chr long, start long, end long, name string"))
    assert sum(r.n * r.pan_count for r in counts.collect()) == sum(map(len, own[1][3:20]))


@pytest.mark.parametrize("n", [N, 20])
def test_distances_of_all_pairs(spark, made, n):
    pos, _, _, rows, holds = made
    few = pos.where(F.col("gid") < n)
    holds = {k: {g for g in x if g < n} for k, x in holds.items()}
    got = {(r.a, r.b): r for r in distance.jaccard(kmers.kmer_sets(few, n=n), n, K).collect()}
    own = {g: {k for k, x in holds.items() if g in x} for g in range(n)}
    assert set(got) == set(itertools.combinations(range(n), 2))
    for (a, b), r in got.items():
        shared, either = len(own[a] & own[b]), len(own[a] | own[b])
        assert r.shared == shared and r.jaccard == pytest.approx(shared / either)
    sketched = {(r.a, r.b): r.jaccard for r in distance.sketch_distance(distance.sketch(few), K, block=16).collect()}
    assert sketched == pytest.approx({k: r.jaccard for k, r in got.items()})  # sketches hold everything here
    bits = kmers.anchor(few, kmers.kmer_sets(few, n=n), n)
    far = {(r.gid, r.a, r.b): r.dist for r in distance.column_distance(summary.mask_counts(bits.where("gid < 3"), "gid"), ["gid"], n).collect()}
    for g, a, b in [(0, 0, 1), (2, 5, n - 1), (1, 3, 17)]:
        assert far[g, a, b] == pytest.approx(math.sqrt(sum((a in holds.get(r.kmer, ())) != (b in holds.get(r.kmer, ())) for r in rows if r.gid == g)))
    assert len(far) == 3 * n * (n - 1) // 2


def test_small_sketches(spark, made):
    pos, size = made[0].where("gid < 4"), 6
    kept: dict[int, set[int]] = {}
    for r in distance.sketch(pos, 10**6).collect():
        kept.setdefault(r.gid, set()).add(r.h)
    got = {(r.a, r.b): r.jaccard for r in distance.sketch_distance(distance.sketch(pos, size), K, size, block=2).collect()}
    for a, b in itertools.combinations(range(4), 2):
        one, two = (set(sorted(kept[g])[:size]) for g in (a, b))
        low = sorted(one | two)[:size]
        assert got[a, b] == sum(h in one and h in two for h in low) / len(low)


def test_ids_without_a_place_are_an_error(made):
    pos = made[0]
    for bad in (kmers.kmer_sets(pos), kmers.kmer_sets(pos, n=70)):
        with pytest.raises(Exception, match="genome id"):
            bad.collect()
    with pytest.raises(ValueError):
        kmers.anchor(pos, made[1])
    with pytest.raises(ValueError):
        columns.mask_of([63])
