"""The bitmap stored as runs, and the steps that count by them: equal to the same on positions, and no row for each position."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from loomgram.operators import bitmap, genes, kmers, runs, similarity, summary, zones
from loomgram.operators.smallest import leading
from loomgram.sources.sequences import mapped

R = random.Random(7)
BITS = [(g, c, p, m) for g in range(2) for c in (3, 4) for m, lot in [(0, range(5)), (7, range(5, 90)), (5, range(90, 120)), (2, range(121, 300, 2))] for p in lot]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _both(spark):
    bits = spark.createDataFrame(BITS, "gid int, chr long, pos long, mask long").coalesce(1)
    return bits, runs.encode(bits)


def test_joined_runs_are_those_of_positions(spark):
    pieces = [(0, 1, 0, [3, 3, 3]), (0, 1, 3, [3, 5]), (0, 1, 6, [5]), (0, 2, 7, [5, 5]), (1, 2, 9, [5])]
    rows = spark.createDataFrame(pieces, "gid int, chr long, start long, masks array<long>").coalesce(1)
    got = _rows(runs.joined(rows))
    assert got == [(0, 1, 0, 4, 3), (0, 1, 4, 1, 5), (0, 1, 6, 1, 5), (0, 2, 7, 2, 5), (1, 2, 9, 1, 5)]
    wide = rows.withColumn("masks", F.flatten(F.transform("masks", lambda x: F.array(F.lit(1).cast("long"), x))))
    assert [(*r[:4], r[4][1]) for r in _rows(runs.joined(wide, 70))] == got
    assert runs.joined(rows.limit(0)).count() == 0


def test_runs_count_as_their_positions(spark):
    bits, coded = _both(spark)
    chrs = spark.createDataFrame([(g, c, 300) for g in range(2) for c in (3, 4)], "gid int, chr long, size long")
    regions = spark.createDataFrame([(0, 3, 2, 95, "a"), (1, 4, 0, 400, "b"), (1, 4, 118, 122, "c")], "gid int, chr long, start long, end long, name string")
    ways = [
        lambda x: summary.bin_similarity(x, 3, 64), lambda x: summary.pan_totals(x), lambda x: summary.pan_bins(x, 3, 64), lambda x: summary.pair_totals(x, 3),
        lambda x: summary.adaptive_pan_bins(x, chrs, 3).where("n > 0"), lambda x: similarity.filtered_similarity(x, 3, 64, F.lit(1).cast("long")), lambda x: genes.pan_counts(x, regions, 32),
        lambda x: zones.pattern(zones.zoned(x, 3, 64), [0], [1]), lambda x: zones.pattern_totals(zones.zoned(x, 3, 64), zones.zone_map(x, 3, 64), [1], [0], "gid", "chr"),
    ]
    for i, way in enumerate(ways):
        assert _rows(way(bits)) == _rows(way(coded)), i
    assert _rows(summary.adaptive_pan_bins(bits, chrs, 3).where("n > 0")) == _rows(summary.adaptive_pan_bins(coded, chrs, 3, zeros=False))


def test_pair_counts_shuffle_no_row_for_a_mask_and_genome(spark):
    counts = summary.mask_counts(_both(spark)[0], "gid")
    plan = summary.pair_counts(counts, ["gid"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_few_smallest_of_many_keys_are_not_joined(spark):
    rows = [(g, c, p, 1) for g in range(3) for c in range(40) for p in range(c * 5)]
    bits = spark.createDataFrame(rows, "gid int, chr long, pos long, mask long")
    got = bitmap.sample(bits, 20)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    import hashlib

    own = {}
    for g, c, p, _ in rows:
        own.setdefault((g, c), []).append((hashlib.md5(f"{g}:{c}:{p}".encode()).hexdigest(), p))
    assert sorted((r.gid, r.chr, r.pos) for r in got.collect()) == sorted((*k, p) for k, v in own.items() for _, p in sorted(v)[:20])
    ties = spark.createDataFrame([("a", 1.0)] * 3 + [("a", 2.0), (None, 0.0), (None, 5.0)], "k string, unit double").coalesce(1)
    assert _rows(leading(ties, ["k"], "unit", 1)) == [("a", 1.0)] * 3 + [(None, 0.0)]


def test_codes_in_parts_and_mapped_letters(spark):
    data = np.frombuffer("".join(R.choices("ACGTN", [9, 9, 9, 9, 0.05], k=2 * kmers.NEAR + 40)).encode(), np.uint8)
    for k in (1, 11, 21, 31):
        whole, text = kmers.codes(data, k), bytes(data).decode()
        assert len(whole) == len(data) - k + 1
        for i in (0, kmers.NEAR - 1, kmers.NEAR, 2 * kmers.NEAR + 1, len(whole) - 1):
            a = text[i : i + k]
            b = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
            number = lambda x: int("".join(str("ACGT".index(y)) for y in x), 4)
            assert whole[i] == (-1 if "N" in a else min(number(a), number(b))), (k, i)
    texts = [None, "", "aBqéZ", "İKß\U00010400b"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.translate(F.regexp_replace(F.lower("t"), "[^a-z]", ""), "abikqz", "ACGTNN")
    assert d.where(~slow.eqNullSafe(mapped("t", "abikqz", "ACGTNN"))).count() == 0
