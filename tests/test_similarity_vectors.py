"""Similarities with a row for each bin: equal to those with a row for each genome, without their joins and windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgram.operators import cluster, similarity, summary

R = random.Random(11)
N, BIN = 5, 10


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(round(y, 9) for y in x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bits(spark):
    rows = [(g, c, p, R.choice([0, 31, 31, 1 << g, R.randrange(32)]) if p // BIN != 3 else 31) for g in range(3) for c in (1, 2) for p in range(R.choice([8, 47, 65]))]
    rows += [(4, 9, p, 0) for p in range(25)]
    return spark.createDataFrame(rows, "gid int, chr long, pos long, mask long").cache()


def _plain(bits, kept=0, fixed=False):
    bins = {}
    for g, c, p, m in map(tuple, bits.collect()):
        bins.setdefault((g, c, p // BIN * BIN), []).append(m | kept if kept and not m & kept else m)
    out = []
    for key, masks in bins.items():
        left = [m for m in masks if not fixed or m.bit_count() < N]
        each = [sum(m >> i & 1 for m in left) for i in range(N)]
        out += [(*key, i, x, (x / max(each) if max(each) else None) if left else 1.0) for i, x in enumerate(each)]
    return out


def _sorted(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_vectors_are_the_long_similarities(bits):
    want = _plain(bits)
    assert _rows(summary.bin_similarity(bits, N, BIN)) == _sorted(want)
    assert _rows(similarity.exploded(summary.bin_vectors(bits, N, BIN))) == _sorted((*r[:4], r[5]) for r in want)
    for kept, fixed in ((3, True), (0, True), (3, False)):
        got = similarity.filtered_similarity(bits, N, BIN, F.lit(kept).cast("long") if kept else None, fixed)
        assert _rows(got) == _sorted((*r[:4], r[5]) for r in _plain(bits, kept, fixed))


def test_steps_on_vectors_are_those_on_rows(spark, bits):
    rows = similarity.filtered_vectors(bits, N, BIN, F.lit(3).cast("long")).cache()
    sim = similarity.exploded(rows).cache()
    for how, size in (("median", 3), ("mean", 2), ("median", 12)):
        assert _rows(similarity.exploded(similarity.smooth(rows, size, how))) == _rows(similarity.smooth(sim, size, how))
    assert _rows(similarity.exploded(similarity.taper(rows))) == _rows(similarity.taper(sim))
    groups = spark.createDataFrame([(0, "REF"), (1, "WT"), (2, "WT"), (4, "O")], "gid int, grp string")
    assert _rows(similarity.group_similarity(rows, groups, "WT")) == _rows(similarity.group_similarity(sim, groups, "WT"))
    assert _rows(cluster.features(rows)) == _rows(cluster.features(sim))


def test_trimmed_means_are_those_of_all_rows(spark):
    x = [R.choice([0.0, 0.25, 1 / 3, 0.5, 1.0, None]) for _ in range(200)]
    sim = spark.createDataFrame([(0, i % 3, v) for i, v in enumerate(x)] + [(1, 0, 0.5), (1, 1, None)], "gid int, other int, sim double")
    got = {(r.gid, r.other): r["mean"] for r in similarity.mean_similarity(sim, 1.0).collect()}
    for o in range(3):
        v = [y for y in x[o::3] if y is not None]
        m = sum(v) / len(v)
        s = (sum((y - m) ** 2 for y in v) / (len(v) - 1)) ** 0.5
        inside = [y for y in v if m - s <= y <= m + s]
        assert got[0, o] == pytest.approx(sum(inside) / len(inside))
    assert got[1, 0] is None and got[1, 1] is None


def test_no_window_and_no_join(bits):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(summary.bin_similarity(bits, N, BIN))
    both = plan(similarity.filtered_similarity(bits, N, BIN, F.lit(3).cast("long")))
    assert "Join" not in both and "Window" not in both
