"""Language identification by multilingual mixture inference over character n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import LOWER, SPACE, aside, row_sums, runs, slices, text_bytes

#: Cells of a language's table of hashed byte trigrams.
CELLS = 1 << 16
#: Added to each cell's count.
SMOOTH = 0.2
#: Labelled documents that the tables are counted on, about; a stated bound, see train().
MAX_TRAIN = 20000
#: Rounds of expectation-maximisation.
ROUNDS = 6
#: Times the usual penalty (half the logarithm of the number of words) that another language must gain.
PENALTY = 2.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of the trigram around each byte, whether the byte is part of a letter, and word start and row).

    A-Z are lower-cased; a trigram doesn't reach over white space or the ends of a row.
    """
    low = LOWER[data].astype(np.uint32)
    low[SPACE[data]] = 32
    left, right = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    left[1:], right[:-1] = low[:-1], low[1:]
    first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    left[first], right[last] = 32, 32
    cell = ((left << np.uint32(16) | low << np.uint32(8) | right) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    letter = _LETTER[low]
    start, _, row = runs((low != 32).view(np.uint8), off)
    return cell, letter, start, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in slices(batches):
        data, off = text_bytes(b.column("text"))
        cell, letter, _, _ = trigrams(data, off)
        cell, at = cell[letter], np.flatnonzero(letter)
        row = np.searchsorted(off, at, "right") - 1
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        both = np.bincount(code[row] * CELLS + cell, minlength=len(names) * CELLS).reshape(-1, CELLS)
        for k, x in enumerate(names):
            total[x] = total.get(x, 0) + both[k]
    for x, counts in total.items():
        at = np.flatnonzero(counts)
        cols = [pa.array([x] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "cell", "n"])


def train(docs: DataFrame, max_train: int = MAX_TRAIN, where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities, CELLS x languages) from rows of docs (doc_id, text, lang) that satisfy where.

    About max_train rows with a language take part, chosen by a hash of doc_id. Counts are added up by Spark; what
    reaches the driver is CELLS numbers for each language at most.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if where is None else rows.where(where)
    share = min(1.0, max_train / max(1, rows.select("doc_id").count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((CELLS, max(len(langs), 1)), SMOOTH)
    for k, x in enumerate(langs):
        own = got[got["lang"] == x]
        table[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _mixture(like: np.ndarray, row: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each row after rounds of expectation-maximisation from share; like: words x languages."""
    n = len(share)
    words = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
    for _ in range(rounds):
        part = like * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = row_sums(part, row, n) / words
    return share, row_sums(np.log((like * share[row]).sum(axis=1)), row, n)


def infer(log_table: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each language in each row, whether the row has n-grams of letters).

    Each word's likelihood in a language is the product over its trigrams. The shares are fitted with all languages;
    then language sets of growing size, by share, are fitted anew, and the set of best penalised likelihood stays.
    """
    n, k = len(off) - 1, log_table.shape[1]
    cell, letter, start, row = trigrams(data, off)
    if not len(start):
        return np.zeros((n, k)), np.zeros(n, bool)
    logs = log_table[cell]
    logs[~letter] = 0
    logs = np.add.reduceat(logs, start, axis=0).astype(np.float64)
    used = np.add.reduceat(letter.astype(np.int64), start) > 0
    logs, row = logs[used], row[used]
    count = np.bincount(row, minlength=n)
    some = count > 0
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60)) if len(logs) else logs
    full, _ = _mixture(like, row, np.full((n, k), 1 / k), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    price = PENALTY * 0.5 * np.log(np.maximum(count, 2))
    best, value = np.zeros((n, k)), np.full(n, -np.inf)
    open_ = some.copy()
    for size in range(1, k + 1):
        if not open_.any():
            break
        own = open_[row]
        number = np.cumsum(open_) - 1
        share = np.where(rank < size, full + 1e-9, 0)[open_]
        share /= share.sum(axis=1, keepdims=True)
        share, ll = _mixture(np.maximum(like[own], 1e-300), number[row[own]], share, 2 if size > 1 else 0)
        ll -= price[open_] * (size - 1)
        better = ll > value[open_]
        at = np.flatnonzero(open_)
        best[at[better]], value[at[better]] = share[better], ll[better]
        open_[at[~better]] = False  # a larger set has to beat the one before it
    return best, some


def identify(docs: DataFrame, langs: list[str], log_table: np.ndarray) -> DataFrame:
    """docs plus lang_pred, score (the share of that language, 0 to 1) and shares (a map of the languages selected).

    A null text, or one without a letter, is `und` with score 0 and no shares; a letter of a script that no training
    text has still counts as one. Ties go to the language that sorts first. Columns of docs that have a new column's name
    come back as aside() names them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, log_table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in slices(batches):
            share, some = infer(table, *text_bytes(b.column("text")))
            text = b.column("text")
            for i in np.flatnonzero(some):
                if not any(map(str.isalpha, text[int(i)].as_py())):
                    some[i] = False
            top = share.argmax(axis=1)
            some &= bool(langs)
            pred = [langs[j] if ok else "und" for j, ok in zip(top.tolist(), some.tolist())]
            score = np.where(some, np.clip(share[np.arange(len(top)), top], 0, 1), 0.0)
            kept = [{langs[j]: float(p[j]) for j in np.flatnonzero(p)} if ok else {} for p, ok in zip(share, some)]
            for name, values in (("lang_pred", pa.array(pred, pa.string())), ("score", pa.array(score)), ("shares", pa.array([list(x.items()) for x in kept], pa.map_(pa.string(), pa.float64())))):
                b = b.append_column(name, values)
            yield b

    clean, _ = aside(docs, "lang_pred", "score", "shares")
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]
    return clean.mapInArrow(task, T.StructType([*clean.schema.fields, *new]))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    langs, table = train(docs, where=~held_out)
    out = identify(docs.select("doc_id", "text"), langs, table)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
