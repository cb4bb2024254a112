"""Operators whose plans avoid pairs, whole series in a row and global sorts, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgram import tables
from loomgram.operators import bitmap, cluster, genes, intervals, scoring, similarity
from loomgram.sources import readers

R = random.Random(8)


@pytest.mark.parametrize("eps", [0.03, 0.3])
def test_density_clusters(spark, eps):
    pts = [(i, R.random(), R.random()) for i in range(150)] + [(200 + i, 0.5 + R.random() * 0.02, 0.5 + R.random() * 0.02) for i in range(80)]
    pts += [(400, 0.25, 0.25), (401, 0.25, 0.25), (402, 0.25 + eps, 0.25), (403, -0.5, -0.5)]
    root = {i: i for i, _, _ in pts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x, y in pts:
        for j, u, v in pts:
            if (x - u) * (x - u) + (y - v) * (y - v) <= eps * eps:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    order = {r: k for k, r in enumerate(sorted({find(i) for i in root}))}
    got = {r.id: r.cluster for r in cluster.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), eps).collect()}
    assert got == {i: order[find(i)] for i in root}


def test_numbering_by_ranges(spark):
    values = R.sample(range(10**6), 500)
    got = {r.v: r.n for r in cluster.numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values))} and cluster.numbered(spark.createDataFrame([], "v long"), "v", "n").count() == 0


@pytest.mark.parametrize(("size", "how"), [(1, "mean"), (2, "mean"), (3, "median"), (4, "median"), (7, "mean")])
def test_smoothing(spark, size, how):
    series = {(g, n): [None if R.random() < 0.2 else R.random() for _ in range(n)] for g in range(2) for n in (1, 2, 5, 30)}
    rows = [(g, n, 10 * i, 0, x) for (g, n), s in series.items() for i, x in enumerate(s)]
    got = {(r.gid, r.chr, r.start): r.sim for r in similarity.smooth(spark.createDataFrame(rows, "gid int, chr long, start long, other int, sim double"), size, how).collect()}
    for (g, n), s in series.items():
        for i in range(n):
            at = [(i - size // 2 + k) % (2 * n) for k in range(size)]
            w = [s[j] if j < n else s[2 * n - 1 - j] for j in at]
            full = sorted(x for x in w if x is not None)
            if how == "mean":
                want = sum(full) / len(full) if full else None
            else:
                want = (full + [None] * size)[size // 2]
            assert got[g, n, 10 * i] == (pytest.approx(want) if want is not None else None)


def test_merging_over_gaps(spark):
    own, gaps = [], []
    for k in "ab":
        at = 0
        for _ in range(25):
            at += R.choice([1, 2, 2, 3]) * 10
            own.append((k, at, at + 9))
            at += 10
        gaps += [(k, g, g + R.choice([1, 5, 20])) for g in R.sample(range(0, at), 12)]
    want = []
    for k in "ab":
        prev = None
        for _, a, b in sorted(x for x in own if x[0] == k):
            joined = prev is not None and a - prev - 1 == 20 and any(q == k and s >= prev and e <= a for q, s, e in gaps)
            if joined:
                want[-1] = (k, want[-1][1], b)
            else:
                want.append((k, a, b))
            prev = b
    args = spark.createDataFrame(own, "acc string, start long, end long"), spark.createDataFrame(gaps, "acc string, g_start long, g_end long")
    assert sorted(map(tuple, intervals.merge_over_gaps(*args, ["acc"], 10).select("acc", "start", "end").collect())) == want
    assert intervals.merge_over_gaps(args[0], args[1].limit(0), ["acc"], 10).count() == len(own)


def test_labels_of_regions_over_several_cells(spark):
    table = [(0, 1, a, a + R.randint(1, 60), f"g{i:03d}") for i, a in enumerate(R.choices(range(400), k=60))] + [(1, 1, 0, 5, "other")]
    asked = [(0, 1, 0, 450), (0, 1, 37, 41), (0, 1, 500, 600), (0, 2, 0, 10), (1, 1, 3, 3), (1, 1, 4, 90)]
    got = {tuple(r)[:4]: r.genes for r in genes.region_label(spark.createDataFrame(table, "gid int, chr long, start long, end long, name string"), spark.createDataFrame(asked, "gid int, chr long, low long, high long"), 5, 16).collect()}
    for g, c, low, high in asked:
        hit = sorted(n for p, q, a, b, n in table if (p, q) == (g, c) and max(a, low) < min(b, high))
        assert got[g, c, low, high] == (", ".join(hit) if len(hit) <= 5 else str(len(hit)))


def test_cycles_of_parents_have_no_root(spark):
    rows = [(0, "a", "b", "A"), (0, "b", "c", "B"), (0, "c", "a", "C"), (0, "d", "a", "D"), (0, "e", None, "E"), (0, "f", "e", "F"), (0, "g", "f", "G"), (0, "h", "gone", "H"), (1, "a", None, "X")]
    got = {(r.gid, r.id): r.root for r in genes.roots(spark.createDataFrame(rows, "gid int, id string, parent string, name string")).collect()}
    assert got == {(0, "a"): None, (0, "b"): None, (0, "c"): None, (0, "d"): None, (0, "e"): "e", (0, "f"): "e", (0, "g"): "e", (0, "h"): "h", (1, "a"): "a"}


def test_replicated_bins(spark):
    bins = spark.createDataFrame([("c", b) for b in range(7)], "chr string, bin int")
    names = spark.createDataFrame([(f"a{i}",) for i in range(5)], "accession string")
    got = scoring.replicate(bins, names, 3)
    assert sorted((r.chr, r.bin, r.accession) for r in got.collect()) == sorted(("c", b, f"a{i}") for b in range(7) for i in range(5))
    assert scoring.replicate(bins, names.limit(0)).count() == 0


def test_coarse_bitmaps(spark, tmp_path):
    bits = spark.createDataFrame([(g, 1, p, p) for g in (0, 1) for p in range(450)], "gid int, chr long, pos long, mask long")
    stored = {100: bitmap.low_resolution(bits, 100), 20: bitmap.low_resolution(bits, 20)}
    assert bitmap.at_step(bits, 200, stored) is stored[100] and bitmap.at_step(bits, 40, stored) is stored[20] and bitmap.at_step(bits, 30, stored) is bits and bitmap.at_step(bits, 100, stored, 7) is bits
    for start, step in ((0, 200), (40, 60), (7, 10)):
        got = [r.pos for r in bitmap.query(bits, 1, 1, start, 400, step, stored).orderBy("pos").collect()]
        assert got == list(range(start, 400, step))
    path = str(tmp_path / "b")
    readers.write_bitmaps(bits, path)
    assert readers.read_bitmap(spark, path, 200).count() == 6 and readers.read_bitmap(spark, path, 7).count() == 2 * len(range(0, 450, 7))
    assert "step=100" in readers.read_bitmap(spark, path, 200).inputFiles()[0]


def test_quality_lines_that_begin_with_the_sign(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGGA\n+r2\n@@I\n@r3\nTT\n+\nII\n")
    assert {(r.chr, r.seq) for r in readers.fastq(spark, str(tmp_path / "r.fq")).collect()} == {("r1", "ACGT"), ("r2", "GGA"), ("r3", "TT")}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_reannotation_replaces_one_genome(spark, tmp_path):
    record = "gid int, chr long, start long, end long, type string, attr string"
    first = spark.createDataFrame([(g, 1, 10 * i, 10 * i + 5, t, f"ID=x{i}") for g in (0, 1) for i, t in enumerate(["gene", "exon", "mRNA"])], record)
    chrs = spark.createDataFrame([(0, 1, 100), (1, 1, 100)], "gid int, chr long, size long")
    genes.reannotate(first, chrs, str(tmp_path), ["gene"])
    new = spark.createDataFrame([(1, 1, 50, 60, "gene", "ID=n"), (1, 1, 95, 105, "gene", "ID=out"), (1, 1, 1, 2, "exon", "ID=e")], record)
    own, others = genes.reannotate(new, chrs, str(tmp_path), ["gene"])
    assert sorted((r.gid, r.start, r.name) for r in own.collect()) == [(0, 0, "x0"), (1, 50, "n")]
    assert sorted((r.gid, r.type) for r in others.collect()) == [(0, "exon"), (0, "mRNA"), (1, "exon")]
    again, others = genes.reannotate(new.where("type = 'exon'").withColumn("type", F.lit("CDS")), chrs, str(tmp_path), ["gene"], annotations_only=True)
    assert again.where("gid = 1").count() == 1 and [r.type for r in others.where("gid = 1").collect()] == ["CDS"]


def _joins(df):
    """The physical plan before it runs, without what AQE may still change."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_and_sweeps_send_no_bins_through_the_driver(spark, tmp_path):
    from loomgram.plans import queries
    from loomgram.plans.fixtures import HOUR

    rows = [(u, e, 3600 * R.randrange(700), R.uniform(1, 400)) for u in range(12) for e in ("click", "view") for _ in range(20)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, s long, value double").selectExpr("user_id", "event_type", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as ts", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("w1_merged_bins", "w2_interval_bins", "w6_merged_over_gaps", "w11_rescaled", "a21_threshold_curve", "a22_curve_area", "a23_accession_curve", "a24_chromosome_curve"):
        assert "Broadcast" not in _joins(queries.QUERIES[name](spark, str(tmp_path))), name
    marked = {(f"u{u}", e, b * HOUR) for u, e, s, v in rows if v >= 100 for b in range(round(s / HOUR), round((s + int(v * 60)) / HOUR) if round((s + int(v * 60)) / HOUR) > round(s / HOUR) else round(s / HOUR) + 1) if b < 720}
    got = [(r.accession, r.chr, r.bin) for r in queries.QUERIES["w2_interval_bins"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(marked)


def test_dense_and_flagged_over_odd_spans(spark):
    marked = [("a", 0), ("a", 0), ("a", 20), ("a", 25), ("a", 30), ("a", -10), ("b", 0), ("d", 0), (None, 10)]
    spans = [("a", 25), ("b", 0), ("c", 11), (None, 15)]
    m, s = spark.createDataFrame(marked, "k string, bin long"), spark.createDataFrame(spans, "k string, size long")
    want = [("a", 0, 1), ("a", 10, 0), ("a", 20, 1), ("c", 0, 0), ("c", 10, 0), (None, 0, 0), (None, 10, 0)]
    order = lambda x: (str(x[0]), x[1])
    assert sorted((tuple(r) for r in intervals.dense(m, s, ["k"], 10).collect()), key=order) == sorted(want, key=order)
    assert sorted(tuple(r) for r in intervals.flagged(m, s, ["k"], 10).collect()) == [w for w in want if w[2]]
    assert dict(intervals.dense(m, s, ["k"], 10).dtypes) == {"k": "string", "bin": "bigint", "flag": "int"}
