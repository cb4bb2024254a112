"""Whitening of embeddings by distributed block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgram.llm.text import aside
from loomgram.tables import keep, table

#: Rows and columns of a block.
BLOCK = 1024
#: Components are told from rounding if their eigenvalue is over this share of the trace.
LEAST = 1e-12
#: Integers from which on a scaled component doesn't count as one.
LARGE = 1 << 53


def integer_rows(rows: DataFrame, vector: Column, scale: int) -> DataFrame:
    """rows with x: floor(scale * c) of each component c as longs.

    Left out are rows whose vector is null or empty, holds null or non-finite components, or components that pass LARGE
    when scaled, and rows whose length isn't the commonest one (of equally common ones the greatest).
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * F.lit(float(scale)) >= F.lit(float(LARGE))))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    out = keep(rows.where(vector.isNotNull() & (F.size(vector) > 0)).where(~bad).withColumn("x", x))
    common = out.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return out.where(F.size("x") == (common["dim"] if common else 0))


def indexed(rows: DataFrame) -> DataFrame:
    """rows plus index: 0, 1, .. in the order in which they are written; written once, so that it stays."""
    rows = keep(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    first = [(r["part"], int(b)) for r, b in zip(sizes, np.cumsum([0, *(r["n"] for r in sizes)]))]
    offsets = rows.sparkSession.createDataFrame(first, "part int, first long")
    return rows.join(F.broadcast(offsets), "part").withColumn("index", F.col("first") + F.col("place")).drop("part", "place", "first")


def blocks(rows: DataFrame, centre: np.ndarray, n: int) -> BlockMatrix:
    """The matrix of n rows (index, x) less centre, as blocks."""
    away = F.zip_with("x", F.array(*(F.lit(float(c)) for c in centre)), lambda x, c: x.cast("double") - c)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(away).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, len(centre)).toBlockMatrix(BLOCK, BLOCK)


def gram(m: BlockMatrix) -> np.ndarray:
    """Transpose of m by m. The long side is split, so that tasks multiply their own blocks and hand on sums: without the
    splits all blocks of a narrow matrix would meet in one task. (The number of splits is Spark's public parameter
    of multiply(); its Python wrapper has no argument for it.)"""
    splits = max(1, -(-m.numRows() // (4 * BLOCK)))
    t = m.transpose()
    product = t._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, BLOCK, BLOCK).toLocalMatrix().toArray()


def times(m: BlockMatrix, w: np.ndarray) -> BlockMatrix:
    """m by a small matrix w."""
    parts = [((i, 0), Matrices.dense(len(p), p.shape[1], p.flatten("F"))) for i, p in ((a // BLOCK, w[a : a + BLOCK]) for a in range(0, len(w), BLOCK))]
    sc = m.blocks.ctx
    return m.multiply(BlockMatrix(sc.parallelize(parts, 1), BLOCK, BLOCK, *w.shape))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> tuple[DataFrame, dict]:
    """(rows with x, deviation and whitened, facts): the projections of each row on the leading components, of unit variance.

    x is floor(scale * c) of each component c. The fit list holds each distinct x once: n of them with sums S; V is its
    covariance with divisor n. whitened has (x - S/n) on each unit eigenvector of V by the root of its eigenvalue, largest
    first and `components` at most; an axis points to the side of its largest loading. Axes whose eigenvalue is zero but
    for rounding are left out, so that with one distinct vector whitened is empty. deviation is the exact sum of
    (n * x - S)^2, null where it passes a long. facts: n, S, values, trace, axes and identity_error, the largest entry by
    which the covariance of the fit list's whitened vectors differs from the identity.

    Repeated rows and null ids come back as often as they are there; what integer_rows() leaves out doesn't. The fit list is
    combined before its shuffle, and all rows are projected by themselves, so that a vector that a third of the
    rows have is no hot key. Columns of rows with one of the new names come back as aside() names them.
    """
    spark = rows.sparkSession
    rows, moved = aside(rows, "x", "deviation", "whitened", "index", "part", "place", "first")
    all_ = indexed(integer_rows(rows, F.col(moved.get(vector, vector)), scale))
    fit = indexed(all_.select("x").distinct())
    n = fit.count()
    empty = {"n": 0, "sums": [], "values": [], "trace": 0.0, "axes": np.zeros((0, 0)), "identity_error": None}
    none = all_.withColumn("deviation", F.lit(None).cast("long")).withColumn("whitened", F.array().cast("array<double>")).drop("index")
    if not n:
        return none, empty
    sums = [r["s"] for r in fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()]
    sums, top = [int(s) for s in sums], fit.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0]
    d, centre = len(sums), np.array([float(s) / n for s in sums])
    of_fit = blocks(fit, centre, n)
    v = gram(of_fit) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST * max(np.trace(v), 0.0)]
    axes = vectors[:, order] * np.where(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] < 0, -1.0, 1.0)
    facts = {"n": n, "sums": sums, "values": values[order].tolist(), "trace": float(np.trace(v)), "axes": axes, "identity_error": None}
    kind = "long" if d * (2 * n * top) ** 2 < 1 << 62 else "decimal(38,0)"
    away = F.zip_with("x", F.array(*(F.lit(s).cast(kind) for s in sums)), lambda x, s: x.cast(kind) * F.lit(n).cast(kind) - s)
    squares = F.aggregate(away, F.lit(0).cast(kind), lambda a, y: (a + y * y).cast(kind))
    all_ = all_.withColumn("deviation", squares if kind == "long" else squares.try_cast("long"))
    if not order:
        return all_.withColumn("whitened", F.array().cast("array<double>")).drop("index"), facts
    w = axes / np.sqrt(values[order])
    projected = times(of_fit, w)
    facts["identity_error"] = float(np.abs(gram(projected) / n - np.eye(len(order))).max())
    whitened = times(blocks(all_.select("index", "x"), centre, all_.count()), w).toIndexedRowMatrix()
    got = whitened.rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    return all_.join(keep(spark.createDataFrame(got, "index long, whitened array<double>")), "index").drop("index"), facts


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each embedding and component."""
    rows, facts = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.array(*(F.lit(v / facts["trace"]) for v in facts["values"])).cast("array<double>")
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(facts["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(facts["identity_error"]).cast("double").alias("identity_error"),
    )
