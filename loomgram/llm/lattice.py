"""Language-model scores by a subword lattice: all segmentations of a word, weighted by unigram piece scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import LOWER, powers, prefix_sums, slices, text_bytes, words
from loomgram.tables import keep

#: Bytes of text whose words are numbered together.
SLICE = 16 << 20
#: Rounds in which the pieces' weights are estimated anew from the training words.
ROUNDS = 3
#: Uses of pieces that the vocabulary's own scores count for, beside those in the training words.
PRIOR = 10_000.0
#: Rows of the byte matrix of words handled at a time.
_CHUNK = 4096
#: Fewer words than this of one length are walked along their bytes one by one, and so many bytes at a time.
FEW, ALONG = 16, 1 << 16


class Pieces:
    """A unigram vocabulary of byte strings with log probabilities; a space stands for the start of a word.

    Every single byte is a piece, so that all words have a segmentation.
    """

    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        self.weight = weight
        size = np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        sums = prefix_sums(np.frombuffer(b"".join(pieces), np.uint8))
        h = raw_hash(sums, end - size, end)
        self.longest = int(size.max())
        order = np.argsort(h)
        self.key, self.piece = h[order], order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows whose hash is a piece's, that piece); few rows get past the first look-up."""
        rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.key, h[rows]), len(self.key) - 1)
        ok = self.key[at] == h[rows]
        return rows[ok], self.piece[at[ok]]


def raw_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans, not mixed."""
    _, inverse = powers(len(sums))
    return (sums[end] - sums[start]) * inverse[start]


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file, and log weights from the scores that it has.

    Scores that are ranks become weights by Zipf's law. Pieces with A-Z or an inner space can't match and are left
    out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i).replace("▁", " ").encode()
        if p and not any(65 <= c <= 90 for c in p) and b" " not in p[1:]:
            rank[p] = -np.log(10 + max(0.0, -model.get_score(i))) if model.get_score(i) <= 0 else float(model.get_score(i))
    for b in range(256):
        rank.setdefault(bytes([b]), -np.log(1e6))
    pieces = sorted(rank)
    weight = np.array([rank[p] for p in pieces])
    return pieces, weight - np.log(np.exp(weight).sum())


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, bytes with a space before each word) of words of equal length."""
    data, off = text_bytes(column)
    size = np.diff(off)
    order = np.argsort(size, kind="stable")
    for n in np.unique(size):
        own = order[np.searchsorted(size[order], n, "left") : np.searchsorted(size[order], n, "right")]
        step = max(1, int(_CHUNK * 16 // (n + 1)))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            yield at, np.hstack([np.full((len(at), 1), 32, np.uint8), data[off[at][:, None] + np.arange(n)]])


def _spans(pieces: Pieces, m: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end, (length, rows, pieces) of the spans that end there and are a piece."""
    rows, n = m.shape
    sums = prefix_sums(m.ravel())
    base = np.arange(rows) * n
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
    for j in range(1, n + 1):
        found = []
        for size in range(1, min(j, pieces.longest) + 1):
            at, got = pieces.find(raw_hash(sums, base + j - size, base + j))
            if len(at):
                found.append((size, at, got))
        out.append(found)
    return out


def _forward(pieces: Pieces, m: np.ndarray, spans: list) -> np.ndarray:
    """alpha[j]: log probability of the first j bytes over all segmentations."""
    alpha = np.full((m.shape[1] + 1, len(m)), -np.inf)
    alpha[0] = 0
    for j in range(1, len(alpha)):
        for size, at, got in spans[j]:
            alpha[j, at] = np.logaddexp(alpha[j, at], alpha[j - size, at] + pieces.weight[got])
    return alpha


def _spans_along(pieces: Pieces, sums: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, pieces) of the spans of one word that are a piece and end in low + 1 .. high, by their ends."""
    found = []
    for size in range(1, min(high, pieces.longest) + 1):
        start = np.arange(max(0, low + 1 - size), high - size + 1)
        at, got = pieces.find(raw_hash(sums, start, start + size))
        found.append((start[at], start[at] + size, got))
    start, end, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order]


def _parts(n: int) -> list[tuple[int, int]]:
    return [(low, min(n, low + ALONG)) for low in range(0, n, ALONG)]


def _forward_along(pieces: Pieces, sums: np.ndarray) -> list[float]:
    """As _forward(), of one word of any length: its spans are found for ALONG ends at a time."""
    alpha = [0.0]
    for low, high in _parts(len(sums) - 1):
        start, end, piece = _spans_along(pieces, sums, low, high)
        edge = np.searchsorted(end, np.arange(low + 1, high + 2)).tolist()
        s, w = start.tolist(), pieces.weight[piece].tolist()
        for a, b in zip(edge[:-1], edge[1:]):
            ways = [alpha[s[i]] + w[i] for i in range(a, b)]
            top = max(ways)
            alpha.append(top + math.log(sum([math.exp(x - top) for x in ways])) if b > a + 1 else top)
    return alpha


def _expected_along(pieces: Pieces, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, expected uses) of one word of any length, part by part from its end."""
    alpha = np.array(_forward_along(pieces, sums))
    beta = [-math.inf] * len(alpha)
    beta[-1] = 0.0
    for low, high in reversed(_parts(len(alpha) - 1)):
        start, end, piece = _spans_along(pieces, sums, low, high)
        w = pieces.weight[piece]
        for s, e, x in zip(start[::-1].tolist(), end[::-1].tolist(), w[::-1].tolist()):
            x += beta[e]
            y = beta[s]
            top, less = (x, y) if x > y else (y, x)
            beta[s] = top + math.log1p(math.exp(less - top))
        after = np.array(beta[low + 1 : high + 1])[end - low - 1]
        yield piece, np.exp(alpha[start] + w + after - alpha[-1])


def log_probability(pieces: Pieces, column: pa.Array) -> np.ndarray:
    """Natural logarithm of each word's marginal probability; a very long word is no exception."""
    out = np.zeros(len(column))
    for at, m in _matrix(column):
        if len(at) < FEW:
            for i, own in zip(at.tolist(), m):
                out[i] = _forward_along(pieces, prefix_sums(own))[-1]
        else:
            out[at] = _forward(pieces, m, _spans(pieces, m))[-1]
    return out


def expected_counts(pieces: Pieces, column: pa.Array, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted by times (forward-backward)."""
    out = np.zeros(len(pieces.weight))
    for rows, m in _matrix(column):
        if len(rows) < FEW:
            for i, own in zip(rows.tolist(), m):
                for got, use in _expected_along(pieces, prefix_sums(own)):
                    out += np.bincount(got, use * times[i], minlength=len(out))
            continue
        spans = _spans(pieces, m)
        alpha = _forward(pieces, m, spans)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for j in range(len(alpha) - 1, 0, -1):
            for size, at, got in spans[j]:
                use = pieces.weight[got] + beta[j, at]
                beta[j - size, at] = np.logaddexp(beta[j - size, at], use)
                out += np.bincount(got, np.exp(use + alpha[j - size, at] - alpha[-1, at]) * times[rows[at]], minlength=len(out))
    return out


def _whole_word_share(priced: DataFrame, n: int) -> float:
    """Weight of the corpus counts of whole words in word_score: of 99 candidates the most likely one when each training
    token is left out of the counts in turn, found in one aggregation."""
    grid = [k / 100 for k in range(1, 100)]
    left = (F.col("c") - 1) / float(max(n - 1, 1))
    sums = [F.sum(F.col("c") * F.log(F.lit(x) * left + F.lit(1 - x) * F.greatest(F.exp("log_p"), F.lit(1e-300)))).alias(f"x{k}") for k, x in enumerate(grid)]
    row = priced.where("c > 0").agg(*sums).first()
    return grid[int(np.argmax([-np.inf if v is None else v for v in row]))]


_SLICES = "slice long, words array<string>, trained array<long>, doc_ids array<{id}>, held array<boolean>, sizes array<int>, codes binary"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for b in slices(batches, limit=SLICE):
        data, off = text_bytes(b.column("text"))
        start, end, row = words(data, off)
        keep_ = np.zeros(len(data) + 1, np.int8)
        keep_[start] = 1
        keep_[end] -= 1
        inside = np.cumsum(keep_[:-1], dtype=np.int8).view(bool)
        to = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(to), pa.py_buffer(LOWER[data[inside]]))
        coded = text.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        rank = np.argsort(np.argsort(-np.bincount(code), kind="stable"), kind="stable").astype(np.int32)  # frequent words get small numbers
        dictionary = coded.dictionary.take(pa.array(np.argsort(rank)))
        code = rank[code]
        held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
        trained = np.bincount(code[~held[row]], minlength=len(dictionary))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        cols = [
            pa.array([part << 32 | k], pa.int64()), one(dictionary.cast(pa.string()), pa.string()), one(trained, pa.int64()), one(b.column("doc_id"), b.column("doc_id").type),
            one(held, pa.bool_()), one(np.bincount(row, minlength=b.num_rows).astype(np.int32), pa.int32()), pa.array([zstandard.compress(code.tobytes(), 1)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["slice", "words", "trained", "doc_ids", "held", "sizes", "codes"])
        k += 1


def score(docs: DataFrame, held_out: Column, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score of each document (doc_id, text).

    Tokens are the words of the text with A-Z lower-cased, then one end. All scores are log10 probabilities learnt from
    all rows that aren't held out; a null held_out counts as not held out.

    * base_score: the add-one unigram word model.
    * score: the lattice. The text's marginal probability over all segmentations of its words into the vocabulary's pieces,
      and the end. The pieces' weights are the vocabulary's scores, which count for PRIOR uses, and the expected uses over
      all segmentations of all training words (forward-backward, ROUNDS times); without training words the scores stand
      alone. Pieces that begin a word hold its space, so that the probabilities of all words add up to 1.
    * word_score: the lattice mixed word by word with the corpus counts of whole words, in a share that leaving-one-out finds.

    Null and empty texts have the end alone.

    Words are numbered slice by slice where they are read, so that a slice sends each of its words once to where the
    corpus counts it, and gets one count and one probability back; no word's occurrences meet in one task. Only the
    pieces' weights, whose number the vocabulary fixes, reach the driver.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    parts = keep(rows.mapInArrow(_number, _SLICES.format(id=kind.simpleString())))
    entries = parts.select("slice", F.posexplode(F.arrays_zip("words", "trained")).alias("code", "x"))
    counts = keep(entries.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.trained").alias("c")))
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = parts.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n, v = int(seen["n"]) + ends, int(seen["v"]) + (ends > 0)

    vocab, own = vocabulary(path)
    weight = own
    shared = spark.sparkContext.broadcast(vocab)
    known = counts.where("c > 0")

    def pieces_of(w) -> Pieces:
        return Pieces(shared.value, w.value)

    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(weight)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, total = pieces_of(now), 0
            for b in batches:
                total = total + expected_counts(pieces, b.column("word"), b.column("c").to_numpy().astype(float))
            if isinstance(total, np.ndarray):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "x"])

        got = known.mapInArrow(expect, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).toPandas()
        use = PRIOR * np.exp(own)
        use[got["piece"].to_numpy()] += got["x"].to_numpy()
        weight = np.log(use / use.sum())
    final = spark.sparkContext.broadcast(weight)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for b in batches:
            pieces = pieces or pieces_of(final)
            yield b.append_column("log_p", pa.array(log_probability(pieces, b.column("word"))))

    priced = keep(counts.mapInArrow(marginal, "word string, c long, log_p double"))
    back = entries.select("slice", "code", F.col("x.words").alias("word")).join(priced, "word").select(F.col("slice").alias("of"), "code", "c", "log_p")
    words_ = n - ends
    share = _whole_word_share(priced, words_) if words_ else 0.0
    unit, end_unit = float(np.log10(n + v + 1)), float(np.log10(ends + 1) - np.log10(n + v + 1))
    end = (ends + 1) / (n + 2)
    end_p, word_p, some = float(np.log10(end)), float(np.log10(1 - end)), int(ends > 0)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"]
        out = []
        code = right.column("code").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        count, log_p = np.zeros(len(code), np.int64), np.zeros(len(code))
        if len(code):
            count[code], log_p[code] = right.column("c").to_numpy(), right.column("log_p").to_numpy()
        with np.errstate(divide="ignore"):
            mixed = np.logaddexp(np.log(count) + np.log(share / max(words_, 1)), log_p + np.log1p(-share))
        price, mixed = log_p / np.log(10) + word_p, mixed / np.log(10) + word_p
        for k in range(left.num_rows):
            cell = lambda c, k=k: left.column(c)[k].values
            size = cell("sizes").to_numpy().astype(np.int64)
            to = np.r_[0, np.cumsum(size)]
            codes = np.frombuffer(zstandard.decompress(left.column("codes")[k].as_py()), np.int32)
            total = lambda x: np.diff(np.r_[0, np.cumsum(x)][to])
            base = total(np.log10(count[codes] + 1) - unit) + end_unit
            known_ = total((count[codes] > 0).astype(np.int64)) + some
            cols = [cell("doc_ids"), cell("held"), pa.array(size + 1), pa.array(known_), pa.array(np.full(len(size), n)), pa.array(base), pa.array(total(price[codes]) + end_p), pa.array(total(mixed[codes]) + end_p)]
            out.append(pa.Table.from_arrays(cols, names))
        return pa.concat_tables(out)

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "word_score")),
    ])
    return parts.drop("words", "trained").groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)


def op6_lattice(spark, sf_dir: str) -> DataFrame:
    """score() of the table documents; a remainder of 2 by 7 of crc32(doc_id) is held out, a null doc_id isn't."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
