"""Density clusters with cores, borders and noise, against a plain version."""

import random

import pytest

from loomgram.operators import cluster

SCHEMA = "id long, x double, y double, name string"


def plain(rows, eps, samples):
    near = {a[0]: [b[0] for b in rows if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= eps * eps] for a in rows}
    cores = {a for a in near if len(near[a]) >= samples}
    found, n = {}, 0
    for a in sorted(cores):
        if a not in found:
            todo = [a]
            while todo:
                b = todo.pop()
                if b in cores and b not in found:
                    found[b] = n
                    todo += near[b]
            n += 1
    border = {a: min((found[b] for b in near[a] if b in cores), default=-1) for a in near}
    return {a: (border[a], a in cores) for a in near}


@pytest.mark.parametrize("samples", [3, 9])
def test_core_clusters_by_hand(spark, samples):
    r = random.Random(samples)
    spots = [(r.choice([0.0, 3.0, 4.5, -2.0]) + r.gauss(0, 0.6), r.gauss(0, 0.6)) for _ in range(260)]
    spots += [(50.0, 50.0)] * 3 + [(51.0, 50.0), (80.0, 80.0)] + [(-7.0, 7.0)] * 40  # repeated points, a border of the exact distance, a lone one
    rows = [(i, x, y, None) for i, (x, y) in enumerate(r.sample(spots, len(spots)))]
    got = cluster.core_clusters(spark.createDataFrame(rows, SCHEMA), 0.25 if samples < 9 else 0.5, samples).collect()
    assert len(got) == len(rows)
    want = plain(rows, 0.25 if samples < 9 else 0.5, samples)
    assert {g.id: (g.cluster, g.core) for g in got} == want
    assert -1 in {c for c, _ in want.values()}


def test_one_sample_is_density_clusters(spark):
    pts = spark.createDataFrame([(i, i * 0.7 + (i > 5) * 3, 0.0, "n") for i in range(12)], SCHEMA)
    a = {r.id: r.cluster for r in cluster.core_clusters(pts, 1.0, 1).collect()}
    assert a == {r.id: r.cluster for r in cluster.density_clusters(pts, 1.0).collect()} and set(a.values()) == {0, 1}


def test_no_points_and_points_without_place(spark):
    rows = [(1, None, 0.0, "a"), (2, float("nan"), 1.0, "b"), (3, 0.0, 0.0, "c"), (4, 0.0, -0.0, "d")]
    got = cluster.core_clusters(spark.createDataFrame(rows, SCHEMA), 1.0, 2).collect()
    assert {r.id: (r.cluster, r.core) for r in got} == {1: (-1, False), 2: (-1, False), 3: (0, True), 4: (0, True)}
    assert cluster.core_clusters(spark.createDataFrame([], SCHEMA), 1.0, 2).count() == 0
