"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import SPACE, aside, mix, prefix_sums, row_sums, runs, slices, span_hash, text_bytes

#: Weights are 2**BITS.
BITS = 20
#: Values of a document's features add up to this.
SCALE = 12.0
#: Labelled documents that the model is fitted on, about; a stated bound, see train().
MAX_TRAIN = 12000

#: 0 white space, 1 letters, digits and bytes of non-ASCII characters, 2 other signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, row) of each hashed uni- and bigram; tokens are runs of word characters or of other signs. row ascends."""
    start, end, row = runs(_KIND[data], off)
    h = span_hash(prefix_sums(data), start, end)
    two = row[1:] == row[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[two]
    index = np.concatenate([h, pair]) >> np.uint64(64 - BITS)
    rows = np.concatenate([row, row[:-1][two]])
    order = np.argsort(rows, kind="stable")
    return index[order].astype(np.int64), rows[order]


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """FTRL-proximal over (indices, values, label) examples; the weights, with the bias at the end."""
    n_weights = (1 << BITS) + 1
    z, n = np.zeros(n_weights), np.zeros(n_weights)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, label in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(n_weights)).astype(np.float32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for b in slices(batches):
        index, row = features(*text_bytes(b.column("text")))
        label = b.column("label").to_pylist()
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        for k in range(b.num_rows):
            i, c = np.unique(index[cut[k] : cut[k + 1]], return_counts=True)
            examples.append((np.r_[i, 1 << BITS], np.r_[SCALE * c / max(c.sum(), 1), 1.0], label[k]))
    if examples:
        yield pa.RecordBatch.from_arrays([pa.array([fit(examples).tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, where: Column | None = None) -> np.ndarray:
    """Weights fitted on labelled rows of docs (doc_id, text) that satisfy where.

    About max_train labelled rows take part, chosen by a hash of doc_id, so that the one task that fits holds a
    bounded number; FTRL takes them in the order of that hash. Labels other than 0 and 1 are ignored, and of several
    labels of a document the smallest holds. No label at all: weights zero, every score 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    share = min(1.0, max_train / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").where(chosen if where is None else chosen & where).join(known.where(chosen), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    model = rows.mapInArrow(_train, "weights binary").first()
    return np.frombuffer(model[0], np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs plus score, 0 to 1, of each whole text: a sparse dot product, then the logistic function.

    Null and empty texts have the bias alone. The weights go to the executors as one broadcast of fixed size. A column
    score of docs comes back as aside() names it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for b in slices(batches):
            index, row = features(*text_bytes(b.column("text")))
            count = np.maximum(np.bincount(row, minlength=b.num_rows), 1)
            logit = w[-1] + SCALE * row_sums(w[index], row, b.num_rows) / count
            yield b.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35)))))

    clean, _ = aside(docs, "score")
    return clean.mapInArrow(task, T.StructType([*clean.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out)
    out = score(docs, weights)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
