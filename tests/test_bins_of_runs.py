"""Bins of runs take one exchange."""

import random

from loomgram.operators import summary

R = random.Random(17)


def test_vectors_of_runs_take_one_exchange(spark):
    rows = [(g, c, 7 * i, 7, R.randrange(1 << 4) | 1 << g) for g in range(4) for c in ("a", None) for i in range(60)]
    runs = spark.createDataFrame(rows, "gid int, chr string, start long, length long, mask long")
    vectors = summary.bin_vectors(runs, 4, 50)
    assert vectors._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    each = {}
    for g, c, s, n, m in rows:
        for p in range(s, s + n):
            for o in range(4):
                each.setdefault((g, str(c), p // 50 * 50), [0] * 4)[o] += m >> o & 1
    want = {k: [x / max(v) for x in v] for k, v in each.items()}
    assert {(r.gid, str(r.chr), r.start): r.sims for r in vectors.collect()} == want
