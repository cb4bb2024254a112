"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.tables import keep

#: Rows of a bucket and queries of a block, about.
BUCKET, BLOCK = 8192, 1024
#: Longest vectors on which a first bound for each query's k-th score is found.
FIRST = 4096
#: Norm levels that the driver learns the limits of, at most; larger inputs have several buckets a level.
LEVELS = 256
#: Coordinates of a query that are tried for pruning.
FOCUS = 4


def integer_vectors(rows: DataFrame, vector: Column, scale: int = 1024) -> DataFrame:
    """rows with v: floor(scale * x) of each component, and norm; rows with null or non-finite components are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = rows.where(vector.isNotNull()).where(~bad)
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return ok.withColumn("v", v).withColumn("norm", norm).withColumn("dim", F.size("v"))


class Bucket:
    """Vectors in order of falling norm, with each coordinate of the unit vectors sorted when first needed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = self.unit[order, f], order
        return self.sorted[f]

    def candidates(self, q: np.ndarray, q_norm: float, bound: float) -> np.ndarray | slice:
        """Rows that can score bound or more: the shorter of a length prefix and of a coordinate's feasible range."""
        longest = self.norms[0] if len(self.norms) else 0.0
        if q_norm == 0 or longest == 0 or bound <= 0:
            return slice(0, len(self.ids) if bound <= 0 else 0)
        slack = 1 - 1e-9
        theta = bound / (q_norm * longest) * slack  # local cosine threshold of the bucket
        if theta > 1:
            return slice(0, 0)
        prefix = int(np.searchsorted(-self.norms, -bound / q_norm * slack, "right"))
        best: np.ndarray | slice = slice(0, prefix)
        unit = q / q_norm
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            x = float(unit[f])
            room = np.sqrt(max(0.0, (1 - theta * theta) * (1 - x * x))) + 1e-9
            low = -2.0 if x < -theta else x * theta - room
            high = 2.0 if x > theta else x * theta + room
            values, order = self.coordinate(f)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if b - a < prefix // 2 and b - a < (len(best) if isinstance(best, np.ndarray) else prefix):
                best = order[a:b]
        return best


def search(bucket: Bucket, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the k best of a bucket for each query, ties to the smaller id, if they reach its bound."""
    out = []
    exact = float(np.abs(bucket.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2**53
    for i, q in enumerate(queries):
        rows = bucket.candidates(q, float(np.sqrt(q @ q)), bounds[i])
        v, name = bucket.vectors[rows], bucket.ids[rows]
        score = v @ q if exact else np.array([sum(int(a) * int(b) for a, b in zip(x, q)) for x in v], dtype=object)
        ok = (name != ids[i]) & (score >= bounds[i])
        name, score = name[ok], score[ok]
        if len(name) > 4 * k and exact:
            limit = np.partition(score, len(score) - k)[len(score) - k]
            name, score = name[score >= limit], score[score >= limit]
        best = sorted(zip((-score).tolist(), name.tolist()))[:k]
        out += [(int(ids[i]), int(n), int(-s)) for s, n in best]
    return out


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    v = t.column(column).combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1)


def top_k(rows: DataFrame, vector: str, query: Column, k: int = 10, id_: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row for which query holds.

    Components are floor(1024 x). Candidates are all rows but those with the query's id; ties go to the smaller id.
    Repeated rows count once; of rows with one id and different vectors each is a candidate, and queries of that id
    are answered together. Vectors of other length than the query's, null ones and ones with null or non-finite
    components take no part; a null id takes no part either.

    Rows are dealt to buckets of falling norm. The FIRST longest vectors give each query a bound that its k-th score
    reaches; blocks of queries then meet only those buckets whose longest vector can reach some bound, and in each a
    query prunes by length or by a coordinate before products are taken. No task holds more than one bucket and one
    block of queries.
    """
    all_ = integer_vectors(rows.select(F.col(id_).alias("vec_id"), F.col(vector).alias("x")), F.col("x")).where("vec_id is not null")
    all_ = keep(all_.select("vec_id", "v", "norm", "dim").distinct())
    total = all_.count()
    levels = max(1, min(LEVELS, total // BUCKET))
    limits = all_.approxQuantile("norm", [i / levels for i in range(1, levels)], 0.2 / levels) if levels > 1 else []
    level = F.lit(0)
    for x in sorted(set(limits)):
        level = level + (F.col("norm") < x).cast("int")
    # a level's rows are dealt to as many buckets as its own number of rows takes, equal norms or not
    rows_of = {r["level"]: r["count"] for r in all_.groupBy(level.alias("level")).count().collect()}
    parts = [max(1, -(-rows_of.get(i, 0) // BUCKET)) for i in range(levels)]
    first = [sum(parts[:i]) for i in range(levels)]
    of = lambda x: F.element_at(F.array(*map(F.lit, x)), level + 1)
    bucket = (of(first) + F.pmod(F.xxhash64("vec_id", "v"), of(parts)).cast("int")).alias("bucket")
    probes = all_.select("vec_id", "v", "norm", "dim", bucket)
    asked = all_.where(query)
    blocks = max(1, asked.count() // BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            b = Bucket(left.column("vec_id").to_numpy(), _matrix(left), left.column("norm").to_numpy())
            found = search(b, right.column("q_id").to_numpy(), _matrix(right, "q_v"), right.column("bound").to_numpy(), k)
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def meet(probe: DataFrame, queries: DataFrame) -> DataFrame:
        left = probe.select("dim", "bucket", "block", "vec_id", "v", "norm")
        right = queries.select(F.col("dim").alias("q_dim"), F.col("bucket").alias("q_bucket"), F.col("block").alias("q_block"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), "bound")
        return left.groupBy("dim", "bucket", "block").cogroup(right.groupBy("q_dim", "q_bucket", "q_block")).applyInArrow(ask, "query_id long, vec_id long, score long")

    # a bound for each query from the longest vectors of its length
    top = probes.orderBy(F.desc("norm"), "vec_id").limit(FIRST).withColumn("bucket", F.lit(-1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = meet(top, asked.withColumn("bucket", F.lit(-1)).withColumn("bound", F.lit(float("-inf"))))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    bound = keep(kth.select(F.col("query_id").alias("vec_id"), F.col("low").cast("double").alias("low")))
    asked = keep(asked.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("low", F.lit(float("-inf")))).drop("low"))

    # which blocks meet which buckets: two small tables, one row for each bucket and each block
    size = probes.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"))
    reach = asked.groupBy("dim", "block").agg(F.min(F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("least"))
    pairs = keep(size.join(reach, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("least")).select("dim", "bucket", "block"))
    found = meet(probes.join(pairs, ["dim", "bucket"]), asked.join(pairs, ["dim", "block"]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, "embedding", F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
