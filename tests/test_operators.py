"""Hand-made cases for the k-mer, bitmap, interval, similarity and scoring operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomgram.functions import columns
from loomgram.operators import bitmap, cluster, distance, genes, graph, intervals, introgress, kmers, scoring, similarity, summary


def seqs(spark, *rows):
    return spark.createDataFrame([(g, c, s) for g, c, s in rows], "gid int, chr long, seq string")


def masks(spark, k, *rows):
    pos = kmers.positions(seqs(spark, *rows), k)
    return kmers.anchor(pos, kmers.kmer_sets(pos))


def decode(code, k):
    return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))


def test_canonical_codes(spark):
    pos = kmers.positions(seqs(spark, (0, 1, "ACG"), (1, 2, "ACGT"), (2, 3, "CGT")), 3).collect()
    assert {(r.gid, r.pos, decode(r.kmer, 3)) for r in pos} == {(0, 0, "ACG"), (1, 0, "ACG"), (1, 1, "ACG"), (2, 0, "ACG")}
    got = spark.createDataFrame([("CGT",), ("ACGT",)], "s string").select(columns.canonical(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == ["ACG", "ACGT"]


def test_sets_and_anchoring(spark):
    pos = kmers.positions(seqs(spark, (0, 1, "AACCG"), (1, 2, "AACC")), 4)
    assert {(decode(r.kmer, 4), r["mask"]) for r in kmers.kmer_sets(pos).collect()} == {("AACC", 3), ("ACCG", 1)}
    bits = masks(spark, 4, (0, 1, "AACCG"), (1, 2, "AACC")).where("gid = 0").orderBy("pos").collect()
    assert [bin(r["mask"]).count("1") for r in bits] == [2, 1]


def test_invalid_bases_have_mask_zero(spark):
    bits = masks(spark, 2, (0, 1, "AANCC")).orderBy("pos").collect()
    assert [r["mask"] for r in bits] == [1, 0, 0, 1]


def test_lower_case_short_and_empty_sequences(spark):
    assert kmers.positions(seqs(spark, (0, 1, ""), (0, 2, "AC"), (0, 3, None)), 3).count() == 0
    assert kmers.positions(seqs(spark, (0, 1, "acg")), 3).first().kmer == kmers.positions(seqs(spark, (0, 1, "ACG")), 3).first().kmer


def test_tiles_do_not_lose_windows(spark):
    long = "ACGTTGCA" * 20000 + "NACGT"
    got = kmers.positions(seqs(spark, (0, 1, long)), 21)
    assert got.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.max("pos")).first() == (len(long) - 20, len(long) - 20, len(long) - 21)


def test_own_bit_is_set_and_strand_does_not_matter(spark):
    s, t = "ACGTTGCAACCGGTATTACG", "TTGACCAACCGGTATTACGA"
    back = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a = {(r.gid, r.pos): r["mask"] for r in masks(spark, 5, (0, 1, s), (1, 2, t)).collect()}
    b = {(r.gid, r.pos): r["mask"] for r in masks(spark, 5, (0, 1, back(s)), (1, 2, t)).collect()}
    assert all(m >> g & 1 for (g, _), m in a.items())
    assert all(a[0, p] == b[0, len(s) - 5 - p] for p in range(len(s) - 4))


def test_min_count_and_words(spark):
    pos = kmers.positions(seqs(spark, (0, 1, "AAAA"), (9, 2, "AAAC")), 3)
    assert [(r.gid, r.n) for r in kmers.genome_sets(pos, 2).collect()] == [(0, 2)]
    words = {(decode(r.kmer, 3), r.word): r["mask"] for r in kmers.kmer_words(pos, 8).collect()}
    assert words[("AAA", 0)] == 1 and words[("AAA", 1)] == 2 and words[("AAC", 1)] == 2


@pytest.mark.parametrize(("size", "length"), [(1000, 10), (50, 1), (10**9, 200_000)])
def test_adaptive_bin(spark, size, length):
    assert spark.range(1).select(summary.adaptive_bin(F.lit(size)).alias("x")).first().x == length


def test_empty_bin_has_no_similarity(spark):
    sim = summary.bin_similarity(masks(spark, 2, (0, 1, "NNNN")), 2, 10).collect()
    assert len(sim) == 2 and all(r.sim is None for r in sim)


def test_histogram_adds_up(spark):
    bits = masks(spark, 4, (0, 1, "AACCGTTTGACN"), (1, 2, "AACCGG"))
    assert summary.pan_bins(bits, 2, 3).agg(F.sum("n")).first()[0] == bits.count()
    whole = summary.pan_totals(bits).where("chr is null").agg(F.sum("n")).first()[0]
    assert whole == bits.count()


def test_patterns(spark):
    bits = spark.createDataFrame([(0, 1, 0, 3), (0, 1, 1, 5), (0, 1, 2, 1)], "gid int, chr long, pos long, mask long")
    assert [r.pos for r in bitmap.pattern(bits, [0], [1]).orderBy("pos").collect()] == [1, 2]
    assert [r["mask"] for r in bitmap.neutralise_unique(bits, F.lit(2).cast("long")).orderBy("pos").collect()] == [3, 7, 3]
    assert bitmap.query(bits, 0, 1, 1, 3).count() == 2 and bitmap.omit_fixed(bits, 2).count() == 1


def series(spark, flags, size=10):
    return spark.createDataFrame([("a", i * size, f) for i, f in enumerate(flags)], "k string, bin long, flag int")


def flags(df):
    return [r.flag for r in df.orderBy("bin").collect()]


def test_gaps_and_small_runs(spark):
    assert flags(intervals.fill_gaps(series(spark, [0, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0]), ["k"], 1)) == [0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1]
    assert flags(intervals.remove_small(series(spark, [0, 1, 0, 1, 1, 0]), ["k"], 2)) == [0, 0, 0, 1, 1, 0]
    assert flags(intervals.fill_exact(series(spark, [0, 0, 1, 0, 1, 0, 0, 1, 0]), ["k"], 1)) == [1, 0, 1, 1, 1, 0, 0, 1, 1]


def test_islands_and_back(spark):
    bins = spark.createDataFrame([("a", 0), ("a", 10), ("a", 30)], "k string, start long")
    merged = intervals.merge_bins(bins, ["k"], 10)
    assert [(r.start, r.end) for r in merged.orderBy("start").collect()] == [(0, 19), (30, 39)]
    assert sorted(r.bin for r in intervals.to_bins(merged, 10).collect()) == [0, 10, 30]


@pytest.mark.parametrize(("start", "end", "size", "bins"), [(4, 27, 10, [0, 10, 20]), (5, 15, 10, [0, 10]), (10, 30, 100, []), (10, 40, 100, [0])])
def test_rounding_to_bins(spark, start, end, size, bins):
    rows = spark.createDataFrame([("a", start, end)], "k string, start long, end long")
    assert sorted(r.bin for r in intervals.to_bins(rows, size).collect()) == bins


def test_merge_over_n_gap(spark):
    rows = spark.createDataFrame([("a", 0, 9), ("a", 30, 39), ("a", 60, 69)], "k string, start long, end long")
    gaps = spark.createDataFrame([("a", 12, 25)], "k string, g_start long, g_end long")
    got = intervals.merge_over_gaps(rows, gaps, ["k"], 10)
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 39), (60, 69)]
    n = intervals.n_runs(seqs(spark, (0, 1, "AC" + "N" * 60 + "GT" + "N" * 10)), tile=16).collect()
    assert [(r.start, r.end) for r in n] == [(2, 62)]


def test_liftover(spark):
    paf = spark.createDataFrame([("q", "t", "+", 0, 25, 100, "10M5D10M5I"), ("r", "t", "-", 0, 10, 0, "4M6=")], "query string, target string, strand string, q_start long, q_end long, t_start long, cigar string")
    blocks = intervals.alignment_blocks(paf)
    rows = spark.createDataFrame([("q", 5, 15), ("q", 20, 25), ("r", 0, 3)], "query string, start long, end long")
    got = {(r.query, r.start): (r.new_start, r.new_end) for r in intervals.liftover(rows, blocks).collect()}
    assert got == {("q", 5): (105, 120), ("r", 0): (7, 10)}


def test_longest_prefix(spark):
    names = spark.createDataFrame([("a_b_chr1",), ("a",), ("z_1",)], "stem string")
    known = spark.createDataFrame([("a",), ("a_b",)], "accession string")
    assert {r.stem: r.accession for r in intervals.longest_prefix(names, known).collect()} == {"a_b_chr1": "a_b", "a": "a", "z_1": None}


def test_rounding_as_numpy(spark):
    assert spark.range(1).select(columns.rounded(F.lit(0.575), 2).alias("x")).first().x == 0.57


def sims(spark, values):
    return spark.createDataFrame([(0, 1, i * 10, 1, v) for i, v in enumerate(values)], "gid int, chr long, start long, other int, sim double")


def test_smoothing(spark):
    out = lambda df: [r.sim for r in df.orderBy("start").collect()]
    assert out(similarity.smooth(sims(spark, [1.0, 2.0, 4.0]), 2)) == [1.0, 1.5, 3.0]
    assert out(similarity.smooth(sims(spark, [1.0, 9.0, 2.0]), 3, "median")) == [1.0, 2.0, 2.0]
    assert out(similarity.taper(sims(spark, [1.0, 0.5, None])))[2] is None


def test_means_and_targets(spark):
    sim = sims(spark, [0.0, 10.0, 10.0, 10.0, 20.0])
    assert similarity.mean_similarity(sim, 1).first()["mean"] == 10 and similarity.mean_similarity(sims(spark, [1.0]), 1).first()["mean"] is None
    low = sims(spark, [0.5, 0.99, None])
    means = spark.createDataFrame([(0, 1, 0.6)], "gid int, other int, mean double")
    assert [r.sim for r in similarity.shift_to_target(low, means, 0.9).orderBy("start").collect()] == [pytest.approx(0.8), 0.99, None]


def test_three_way(spark):
    rows = spark.createDataFrame([(5, 1, 0, None, 0.75, 0.5, 0.5), (5, 1, 10, None, 1.0, 0.96, 0.96), (5, 1, 20, None, None, 0.1, 0.1)], "gid int, chr long, start long, own double, comp double, ref double, ref_max double")
    assert [r.flag for r in introgress.three_way(rows, "WT", [20]).orderBy("start").collect()] == [1, 0, 0]


def test_confusion(spark):
    p = spark.createDataFrame([("a", "c", i, f) for i, f in enumerate([1, 1, 0, 0])], "accession string, chr string, bin long, flag int")
    t = spark.createDataFrame([("a", "c", i, f) for i, f in enumerate([1, 0, 1, 0])], "accession string, chr string, bin long, truth int")
    r = scoring.metrics(scoring.counts(scoring.labelled(p, t), "chr")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1) and {r.precision, r.recall, r.accuracy, r.fpr} == {0.5}
    none = scoring.metrics(scoring.counts(scoring.labelled(p.where("flag = 0"), t.where("truth = 0")), "chr")).first()
    assert none.precision is None and scoring.curve(scoring.counts(scoring.labelled(p.where("flag = 0"), t.where("truth = 0")), "chr")).first().precision == 0


def test_gff_names_and_roots(spark):
    rows = [(0, 1, "gene", "ID=g;name=N1"), (0, 1, "mRNA", "ID=m;Parent=g"), (0, 1, "exon", "ID=e;Parent=m"), (0, 1, "exon", "ID=x;Parent=lost")]
    named = genes.named(spark.createDataFrame(rows, "gid int, chr long, type string, attr string"))
    assert {r.id: r.root_name for r in genes.annotation_names(named).collect()} == {"g": "N1", "m": "N1", "e": "N1", "x": "x"}


def test_gene_counts_by_position(spark):
    bits = spark.createDataFrame([(0, 1, p, 1 if p < 5 else 3) for p in range(10)], "gid int, chr long, pos long, mask long")
    rows = spark.createDataFrame([(0, 1, 2, 8, "a"), (0, 1, 4, 4, "none")], "gid int, chr long, start long, end long, name string")
    counts = genes.pan_counts(bits, rows, 4)
    r = genes.gene_conservation(counts, 2).collect()
    assert [(x.name, x.n_unique, x.n_universal) for x in r] == [("a", 3, 3)]
    assert genes.region_moments(counts).first().average == 1.5


def test_jaccard_and_trees(spark):
    sets = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4)], "kmer long, mask long")
    d = {(r.a, r.b): r for r in distance.jaccard(sets, 3, 21).collect()}
    assert d[0, 1].jaccard == pytest.approx(1 / 3) and d[0, 2].dist == 1 and d[0, 1].dist == pytest.approx(-math.log(0.5) / 21)
    edges = spark.createDataFrame([("t", 0, 1, 1.0), ("t", 0, 2, 4.0), ("t", 1, 2, 5.0)], "k string, a int, b int, dist double")
    assert [(r.left, r.right, r.height, r.size) for r in cluster.tree(edges, ["k"], "average").orderBy("step").collect()] == [(0, 1, 1.0, 2), (2, 3, 4.5, 3)]
    assert distance.symmetric(edges).count() == 9


def test_sketch_equals_exact_when_it_holds_all(spark):
    pos = kmers.positions(seqs(spark, (0, 1, "ACGTTGCAACCGGTATTACG"), (1, 2, "TTGACCAACCGGTATTACGA")), 5)
    exact = distance.jaccard(kmers.kmer_sets(pos), 2, 5).first().jaccard
    assert distance.sketch_distance(distance.sketch(pos), 5).first().jaccard == pytest.approx(exact)


def test_density_clusters_and_components(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0), (4, 5.0, 5.0), (5, 5.0, 5.0)], "id long, x double, y double")
    assert {r.id: r.cluster for r in cluster.density_clusters(pts, 1.0).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.connected_components(chain.where("src = dst")).count() == 0


def test_members_and_dominant_leaf(spark):
    edges = spark.createDataFrame([("t", 0, 1, 1.0), ("t", 0, 2, 4.0), ("t", 1, 2, 5.0)], "k string, a int, b int, dist double")
    trees = cluster.tree(edges, ["k"], "average")
    assert [r.members for r in trees.orderBy("step").collect()] == [[0, 1], [0, 1, 2]]
    values = spark.createDataFrame([("t", 0, 7), ("t", 1, 7), ("t", 2, 9)], "k string, other int, value long")
    assert [(r.other, r.value) for r in cluster.dominant(trees, values, ["k"]).orderBy("step").collect()] == [(0, 7), (2, 9)]
    assert [r.other for r in cluster.dominant(trees, values.where("value > 9"), ["k"]).collect()] == [None, None]


def test_listed_accessions_are_called_in_their_own_view(spark):
    sim = spark.createDataFrame([(0, 1, 0, 1, 0.1), (0, 1, 0, 2, 0.1)], "gid int, chr long, start long, other int, sim double")
    own = spark.createDataFrame([(1, 1, 5, 0.9), (2, 1, 5, 0.9)], "gid int, chr long, start long, ref_max double")
    got = introgress.two_way(sim, own, 0, [2], [50]).collect()
    assert {(r.accession, r.intro_type, r.start, r.flag) for r in got} == {(1, "REF", 0, 1), (2, "REFA", 5, 0)}
