"""Chains of alignments and trees by rounds of joins, against plain versions."""

import random

import pytest

from loomgram.operators import cluster, intervals

R = random.Random(2)
PAF = "query string, target string, strand string, q_start long, q_end long, t_start long, cigar string"


def test_a_repeated_alignment_counts_once(spark):
    row = ("q", "t", "+", 0, 110, 1000, "50M10D50M")
    rows = spark.createDataFrame([("q", 60, 70)], "query string, start long, end long")
    for n in (1, 2):
        blocks = intervals.alignment_blocks(spark.createDataFrame([row] * n, PAF))
        assert [(r.new_start, r.new_end) for r in intervals.liftover(rows, blocks).collect()] == [(1070, 1080)]
        assert [(r.new_start, r.new_end, r.covered) for r in intervals.chained_liftover(rows, blocks).collect()] == [(1070, 1080, 10)]


def test_one_locus_where_alignments_overlap(spark):
    paf = [("q", "t", "+", 0, 100, 0, "100M"), ("q", "t", "+", 120, 220, 130, "100M"), ("q", "t", "+", 50, 130, 90_000, "80M"), ("q", "u", "-", 0, 220, 500, "60M"), ("q", "t", "-", 300, 400, 10, "100M")]
    rows = spark.createDataFrame([("q", a, b, f"{a}") for a, b in ((10, 20), (60, 125), (90, 210), (110, 118), (310, 320), (500, 600))], "query string, start long, end long, name string")
    blocks = intervals.alignment_blocks(spark.createDataFrame(paf, PAF))
    got = {r.name: (r.target, r.covered, r.new_start, r.new_end) for r in intervals.chained_liftover(rows, blocks, 1000, 64).collect()}
    assert got == {"10": ("t", 10, 10, 20), "60": ("t", 65, 90_010, 90_075), "90": ("t", 100, 90, 220), "110": ("t", 8, 90_060, 90_068), "310": ("t", 10, 90, 100)}
    hull = {r.name: (r.new_start, r.new_end) for r in intervals.liftover(rows.where("name = '60'"), blocks, 64).where("target = 't'").collect()}
    assert hull == {"60": (60, 90_075)}  # all that is hit


@pytest.mark.parametrize("gap", [20, 200])
def test_chains_by_hand(spark, gap):
    paf = set()
    while len(paf) < 90:
        n, strand = R.randint(5, 40), R.choice("+-")
        q = R.randrange(1200)
        t = (q if strand == "+" else 1300 - q) + R.choice([0, 3, 600]) + R.randint(-8, 8)
        paf.add((R.choice("qr"), "t", strand, q, q + n, t + 100, f"{n}M"))
    paf = sorted(paf)
    blocks = intervals.alignment_blocks(spark.createDataFrame(paf, PAF))
    number = {(r.query, r.strand, r.qs, r.qe, r.ts): r.aln for r in blocks.collect()}
    want = {}
    for query in "qr":
        for strand in "+-":
            rows = sorted((q, e, t, t + e - q, e - q, number[query, strand, q, e, t]) for a, _, s, q, e, t, _ in paf if (a, s) == (query, strand))
            best, back = [], []
            for i, b in enumerate(rows):
                options = [(0, -1)]
                for j, p in enumerate(rows[:i]):
                    dq, dt = b[0] - p[1], (p[2] - b[3] if strand == "-" else b[2] - p[3])
                    if 0 <= dq <= gap and 0 <= dt <= gap:
                        options.append((best[j] - abs(dq - dt), j))
                top = max(options, key=lambda x: (x[0], -x[1] if x[1] >= 0 else 1))
                best.append(b[4] + top[0])
                back.append(top[1])
            used = {}
            for i in sorted(range(len(rows)), key=lambda i: (-best[i], i)):
                path, at = [], i
                while at >= 0 and at not in used:
                    path.append(at)
                    at = back[at]
                for k in path:
                    used[k] = rows[path[-1]][5]
            want |= {rows[k][5]: c for k, c in used.items()}
    got = {r.aln: r.chain for r in intervals.chains(blocks, gap).collect()}
    assert got == want and len(set(got.values())) < len(got)


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
def test_same_merges_as_the_plain_tree(spark, method):
    rows = []
    for key, n in (("x", 40), ("y", 2), ("z", 13)):
        at = {i: (R.random(), R.random(), R.random()) for i in R.sample(range(500), n)}
        rows += [(key, a, b, sum((u - v) ** 2 for u, v in zip(at[a], at[b])) ** 0.5) for a in at for b in at if a < b]
    df = spark.createDataFrame(rows, "key string, a int, b int, dist double").repartition(3)
    plain = {(r.key, r.step): r for r in cluster.tree(df, ["key"], method).collect()}
    got = cluster.joined_tree(df, ["key"], method).collect()
    assert len(got) == len(plain) == 39 + 1 + 12
    for r in got:
        p = plain[r.key, r.step]
        assert (r.left, r.right, r.size) == (p.left, p.right, p.size) and r.height == pytest.approx(p.height)


def test_no_leaves(spark):
    assert cluster.joined_tree(spark.createDataFrame([], "key string, a int, b int, dist double"), ["key"]).count() == 0
