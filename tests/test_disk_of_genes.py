"""Genes and regions take no texts along and are dealt once."""

import random

from loomgram.operators import genes, summary
from loomgram.plans import fixtures

R = random.Random(31)


def test_lengths_take_no_text_along(spark, tmp_path):
    rows = [(i, f"src{i % 3}", "Ab q" * R.randrange(400)) for i in range(1, 30)] + [(40, "src1", None), (None, "src1", "abc" * 50)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ix = fixtures.Index(spark, str(tmp_path))
    assert "text" not in ix.genes._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(ix.chrs.collect(), key=key) == sorted(summary.chromosomes(ix.seqs, fixtures.K).collect(), key=key)
    assert {(r.chr, r.length) for r in ix.lengths.collect()} == {(i, None if t is None else len(t.replace(" ", ""))) for i, _, t in rows}


def test_regions_are_dealt_once(spark):
    coded = spark.createDataFrame([(0, 1, 10 * i, 10, R.getrandbits(3)) for i in range(90)], "gid int, chr long, start long, length long, mask long")
    regions = spark.createDataFrame([(0, 1, 7 * i, 7 * i + 30, f"g{i}") for i in range(120)] * 2, "gid int, chr long, start long, end long, name string")
    counts = genes.pan_counts(coded, regions, 64)
    # sums by region and pan-count, and the join on the region, read one exchange
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(region" in plan and not any("hashpartitioning(region" in x and "pan_count" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
    want = {}
    pan = [bin(r.mask).count("1") for r in coded.orderBy("start").collect() for _ in range(10)]
    for i in range(120):
        for p in range(7 * i, min(7 * i + 30, 900)):
            want[f"g{i}", pan[p]] = want.get((f"g{i}", pan[p]), 0) + 2
    assert {(r["name"], r.pan_count): r.n for r in counts.collect()} == want
