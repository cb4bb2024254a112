"""Every bin is asked for its nearest others."""

import random

import numpy as np

from __spark_entry__ import queries
from loomgram.plans import fixtures

R = random.Random(29)


def documents(spark, path):
    """20 texts of five genomes; parts of them are shared."""
    words = ["".join(R.choices(fixtures.LETTERS, k=60)) for _ in range(40)]
    rows = [(i, f"src{i % 5}", " ".join(R.choices(words, k=12))) for i in range(1, 21)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(2).write.parquet(f"{path}/documents.parquet")


def test_all_bins_have_their_neighbours(spark, tmp_path):
    documents(spark, tmp_path)
    ix = fixtures.index(spark, str(tmp_path))
    got = {}
    for r in queries()["t2_nearest"](spark, str(tmp_path)).collect():
        got.setdefault((r.gid, r.chr, r.start), {})[r.rank] = r.dist
    each = {}
    for r in ix.coded.collect():
        for p in range(r.start, r.start + r.length):
            n = each.setdefault((r.gid, r.chr, p // fixtures.BIN * fixtures.BIN), np.zeros(fixtures.GENOMES))
            n += [r.mask >> o & 1 for o in range(fixtures.GENOMES)]
    sims = {k: n / n.max() if n.max() else n for k, n in each.items()}
    v = np.unique(np.array(list(sims.values())), axis=0)
    assert len(got) == len(sims) and {k[1] for k in got} == set(range(1, 21))
    for k, x in sims.items():
        want = np.sort(np.sqrt(((v - x) ** 2).sum(1)))[1:5]
        assert np.allclose([got[k][r] for r in (1, 2, 3, 4)], want, atol=1e-6)
