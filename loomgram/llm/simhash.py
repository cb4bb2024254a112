"""SimHash near-duplicates: fingerprints, and links found by bit-sliced comparison.

Bit planes are stored vertically: plane b of a block of 64 fingerprints is one 64-bit word. For one fingerprint the
differing bits of 64 others are one XOR a plane; a carry-save counter (one word for each binary digit) adds them up,
and a comparison stops as soon as every counter is past the radius.

Narrow fingerprints decide a link by themselves. Wide ones only choose candidates, which are compared by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import LOWER, mix, row_sums, slices, text_bytes, words
from loomgram.operators.graph import connected_components
from loomgram.tables import keep

#: Rows of a bucket compared with each other at most; larger buckets are split into pairs of parts.
LARGEST = 16384
#: Rows of small buckets that are compared together.
POOL = 2048
#: Min-hashed pairs of shingles by which wide fingerprints are dealt to buckets.
BANDS = 12
#: Shingles of one part of a component whose candidates are compared at most, besides LARGEST / 2 rows.
SHINGLES = 1 << 22
#: Rows and shingles of small components that are compared together.
FEW, FEW_SHINGLES = 256, 1 << 21
#: Standard deviations over the mean distance up to which wide fingerprints are candidates.
DEVIATIONS = 4
_U = np.uint64


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 with seed 42 of each shingle, its row), A-Z lower-cased, words joined by one space.

    A text of fewer words than size has one shingle, its whole sequence; one without words has none.
    """
    start, end, row = words(data, off)
    n = len(off) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words, each with one space after it
    length = end - start
    to = np.cumsum(length + 1)
    at = to - length - 1
    out = np.full(int(to[-1]), 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    gap = np.ones(len(out), bool)
    gap[to - 1] = False
    out[gap] = LOWER[data[inside]]
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count)[row]  # one past the row's last word
    k = np.arange(len(start))
    stop = np.minimum(k + size, last)
    ok = (k + size <= last) | ((count[row] < size) & (k == last - count[row]))
    text, h = out.tobytes(), xxhash.xxh64_intdigest
    a, b = at[ok].tolist(), (to[stop[ok] - 1] - 1).tolist()
    return np.array([h(text[i:j], 42) for i, j in zip(a, b)], dtype=np.uint64), row[ok]


_LANES = _U(0x0101010101010101)


def fingerprints(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprint of each of n rows: a bit is 1 if set in over half of the row's hashes; none: zero."""
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    part = (np.arange(len(h)) - first[row]) // 255  # sums of up to 255 fit a byte
    key = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.zeros(0, int)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        sums = np.add.reduceat((h >> _U(k)) & _LANES, key) if len(h) else np.zeros(0, np.uint64)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int32)
        bits = row_sums(lanes, row[key], n) * 2 > count[:, None]
        for j in range(8):
            out |= bits[:, j].astype(np.uint64) << _U(8 * j + k)
    return out


def _min_hashes(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each row the BANDS keys made of two min-hashes each; rows without shingles share one key a band."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(h):
        return out
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for k in range(2 * BANDS):
        low = np.minimum.reduceat(mix(h ^ _U((0xA24BAED4963EE407 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)), at)
        out[row[at], k // 2] = mix(out[row[at], k // 2] + low)
    return out


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) without the repeats in each row; a row's hashes ascend."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, int)
    return h[new], row[new]


def differing(similarity: float) -> float:
    """The largest share of bits by which two sets of that Jaccard similarity differ on average.

    For large sets it is the angle of cosine 2s / (1 + s); sets of a few shingles can have more, as sums tie.
    """
    half = [np.ones(1)]
    for _ in range(80):
        half.append(np.convolve(half[-1], [0.5, 0.5]))
    over = [np.r_[np.cumsum(x[::-1])[::-1], 0.0] for x in half]  # P(sum >= k)

    def is_set(common: int, more: int) -> np.ndarray:
        """P(bit is set), by the sum over the common shingles."""
        return over[more][np.clip((common + more) // 2 + 1 - np.arange(common + 1), 0, more + 1)]

    most = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    for common in range(1, 61):
        for apart in range(min(int(common * (1 - similarity) / similarity + 1e-9), 20) + 1):
            for a in range((apart + 1) // 2, apart + 1):
                x, y = is_set(common, a), is_set(common, apart - a)
                most = max(most, float(half[common] @ (x * (1 - y) + y * (1 - x))))
    return most


def _digest(shingle: int, width: int, bands: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_bytes(b.column("text"))
            n = b.num_rows
            h, row = shingle_hashes(data, off, shingle)
            if bands:
                h, row = distinct(h, row)
            cols = [fingerprints(h if k == 0 else mix(h + _U(k)), row, n) for k in range(width // 64)]
            raw = np.stack(cols, axis=1).astype(">u8").tobytes()
            size = width // 8
            out = [b.column("doc_id"), b.column("text_key"), pa.array([raw[i * size : (i + 1) * size] for i in range(n)], pa.binary())]
            if bands:
                keys = _min_hashes(h, row, n).view(np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())))
                size = np.bincount(row, minlength=n)
                out += [pa.array(mix(row_sums(mix(h), row, n) + size.astype(np.uint64)).view(np.int64)), pa.array(size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "fp", *["bands", "node", "shingles"] * bands])

    return task


def digest(docs: DataFrame, shingle: int, width: int = 64, bands: bool = False) -> DataFrame:
    """doc_id, text_key (XXH64 of the text), fp (binary of width bits) of each document.

    With bands, repeated shingles count once, and there are also the band keys, node (a hash of the set of shingles) and
    shingles (how many there are).
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.BinaryType()),
        *[T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("node", T.LongType()), T.StructField("shingles", T.LongType())] * bands,
    ])
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_digest(shingle, width, bands), schema)


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes (bits x words) of fingerprints given as a (rows x bytes) array; rows are padded to 64."""
    bits = np.unpackbits(fp, axis=1)
    pad = np.zeros((-len(bits) % 64, bits.shape[1]), np.uint8)
    return np.packbits(np.ascontiguousarray(np.vstack([bits, pad]).T), axis=1).view(">u8").astype(np.uint64)


def within(fp: np.ndarray, low: int, high: int, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Boolean (high - low) x rows: which rows differ from each of rows low..high-1 in radius bits at most.

    A word of 64 rows that are all past the radius for every one of these rows is dropped from the comparison.
    """
    ones = _U(0xFFFFFFFFFFFFFFFF)
    bits = np.unpackbits(fp[low:high], axis=1)
    n_bits, n_words = vertical.shape
    live = np.arange(n_words)
    count = [np.zeros((high - low, n_words), np.uint64) for _ in range(int(radius + 1).bit_length())]
    over = np.zeros((high - low, n_words), np.uint64)
    for b in range(n_bits):
        carry = vertical[b][None, live] ^ np.where(bits[:, b], ones, _U(0))[:, None]
        for k, c in enumerate(count):  # carry-save: each digit takes the carry and passes its own on
            count[k], carry = c ^ carry, c & carry
        over |= carry
        if b >= 2 * radius and b % 16 == 15:
            alive = ((over | _past(count, radius)) != ones).any(axis=0)
            if alive.mean() < 0.8:
                live, over, count = live[alive], over[:, alive], [c[:, alive] for c in count]
                if not len(live):
                    break
    near = np.zeros((high - low, n_words), np.uint64)
    near[:, live] = ~(over | _past(count, radius))
    return np.unpackbits(near.astype(">u8").view(np.uint8), axis=1)[:, : len(fp)].astype(bool)


def _past(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counter is over the radius: a comparison digit by digit from the top."""
    more = np.zeros_like(count[0])
    same = ~more
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def _forest(node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked in one block: from each node to the first node that its links reach.

    Every row is compared with the whole block, but there is one edge for each node at most, however many links.
    """
    n = len(node)
    label = np.arange(n)
    vertical = planes(fp)
    for low in range(0, n, 256):
        near = within(fp, low, min(low + 256, n), vertical, radius)
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            met = np.unique(label[near[i]])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    linked = label != np.arange(n)
    return node[linked], node[label[linked]]


def _exact_forest(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """As _forest(), but of the pairs within radius only those are linked whose sets have that Jaccard similarity.

    Pairs that are connected already are not compared.
    """
    n = len(node)
    label = np.arange(n)
    size = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = np.split(code, np.cumsum(size)[:-1])
    mine = np.zeros(int(size.sum()) + 1, bool)
    vertical = planes(fp)
    for low in range(0, n, 256):
        near = within(fp, low, min(low + 256, n), vertical, radius)
        for i in range(low, min(low + 256, n)):
            left = np.flatnonzero(near[i - low, :i] & (size[:i] > 0))
            left = left[label[left] != label[i]]
            if not len(left) or not size[i]:
                continue
            mine[code[i]] = True
            step = 1
            while len(left):
                part, left = left[:step], left[step:]
                first = np.cumsum(size[part]) - size[part]
                both = np.add.reduceat(mine[np.concatenate([code[j] for j in part])], first, dtype=np.int64)
                met = np.unique(label[part[both / (size[i] + size[part] - both) >= similarity]])
                if len(met):
                    met = np.union1d(met, label[i])
                    label[np.isin(label, met[1:])] = met[0]
                    left = left[label[left] != label[i]]
                step = min(step * 8, 1024)
            mine[code[i]] = False
    linked = label != np.arange(n)
    return node[linked], node[label[linked]]


def _sets(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, row = distinct(*shingle_hashes(*text_bytes(b.column("text")), shingle))
            at = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))] * 8
            raw = h.tobytes()
            own = pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            names = ["component", "parts", "node", "fp"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), own], [*names, "own"])

    return task


def _verify(width: int, radius: int, similarity: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, np.ndarray]] = {}
        size, last = 0, None

        def block() -> pa.RecordBatch:
            node = np.array(sorted(held), np.int64)
            fp = np.frombuffer(b"".join(held[k][0] for k in node.tolist()), np.uint8).reshape(-1, width // 8)
            a, b = _exact_forest(node, fp, [held[k][1] for k in node.tolist()], radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        for batch in batches:
            for c, i, j, k, fp, own in zip(*(batch.column(x).to_pylist() for x in ("component", "i", "j", "node", "fp", "own"))):
                if (c, i, j) != last and (len(held) >= FEW or size >= FEW_SHINGLES):
                    yield block()
                    held.clear()
                    size = 0
                last = c, i, j
                held[k] = fp, np.frombuffer(own, np.uint64)
                size += len(own) // 8
        if len(held) > 1:
            yield block()

    return task


def similar(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int, width: int, radius: int, similarity: float) -> DataFrame:
    """src, dst edges that connect the nodes whose sets of shingles have that Jaccard similarity or more.

    nodes: (node, fp, shingles, low, text_key), where a row of docs with low and text_key has the node's shingles.
    candidates: (node, component); only nodes of one component are compared. The texts of nodes without a component stay
    out, and each other one is read once. A large component is dealt to pairs of parts like a bucket of linked().
    """
    rows = nodes.join(candidates, "node").select("node", "fp", "shingles", "low", "text_key", "component")
    rows = keep(rows)
    parts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"))
    parts = parts.select("component", F.ceil(F.greatest(F.col("n") / (LARGEST // 2), F.col("s") / SHINGLES, F.lit(1.0))).cast("int").alias("parts"))
    rows = rows.join(keep(parts), "component")
    texts = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), "text")
    rows = rows.join(texts, (F.col("text_key") == F.col("own_key")) & F.col("low").eqNullSafe(F.col("own_id")))
    rows = rows.dropDuplicates(["node"]).select("component", "parts", "node", "fp", "text")
    rows = rows.mapInArrow(_sets(shingle), "component long, parts int, node long, fp binary, own binary")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "fp", "own")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return rows.mapInArrow(_verify(width, radius, similarity), "src long, dst long")


def _compare(width: int, radius: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(-1, width // 8)
            node = t.column("node").to_numpy()
            node, at = np.unique(node, return_index=True)
            a, b = _forest(node, fp[at], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        def gather() -> Iterator[pa.Table]:
            rows, keys = 0, ["key", "i", "j"]
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows < POOL:
                    continue
                t = pa.Table.from_batches(held)
                k = np.stack([t.column(c).to_numpy() for c in keys])
                new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
                while len(new) and rows >= POOL:  # whole buckets, several small ones together
                    cut = int(new[max(np.searchsorted(new, POOL, "right") - 1, 0)])
                    yield t.slice(0, cut)
                    t, rows, new = t.slice(cut), rows - cut, new[new > cut] - cut
                held[:] = t.to_batches()
            if held:
                yield pa.Table.from_batches(held)

        for t in gather():
            if t.num_rows > 1:
                yield block(t)

    return task


def linked(keys: DataFrame, width: int, radius: int) -> DataFrame:
    """src, dst edges that connect all fingerprints within radius among those that share a key.

    keys: (key, node, fp). A bucket of over LARGEST / 2 rows is dealt to pairs of parts, so that no task holds a
    whole bucket. Small buckets share a block; those of one row have nothing to compare.
    """
    half = LARGEST // 2
    dealt = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keep(dealt.select("key", F.ceil(F.col("n") / half).cast("int").alias("parts")))
    dealt = keys.join(dealt, "key")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare(width, radius), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 5, width: int = 512, radius: int | None = None, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, fp, component_id, root of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links; it is null for each class that has only null ones. root is
    another number of the class, never null and different for each.

    With width 64 and a radius under 8, texts are linked if their fingerprints (over word shingles, repeats included)
    differ in radius bits at most. The search is complete: fingerprints are dealt to buckets by each of radius + 1 blocks
    of bits, of which near ones share one.

    Otherwise texts are linked if the Jaccard similarity of their sets of shingles is similarity or more, and the
    fingerprints (over these sets) only choose candidates. They are dealt to buckets by BANDS pairs of min-hashed
    shingles, one of which near texts share with probability 1 - (1 - s^2)^BANDS: all but 5 in a million at s = 0.8.
    Candidates differ in radius bits at most: without radius DEVIATIONS standard deviations over the mean at similarity,
    for the sets of shingles that have the largest one; the binomial law leaves out 4 pairs in 100,000 of these.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. Repeated
    rows have equal fingerprints and thus one class. A null doc_id counts as larger than all others.
    """
    exact = radius is not None and radius < 8 and width == 64
    if radius is None:
        p = differing(similarity)
        radius = int(np.ceil(width * p + DEVIATIONS * np.sqrt(width * p * (1 - p))))
    rows = keep(digest(docs, shingle, width, bands=not exact))
    if exact:
        same = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
        nodes = keep(same.withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")))
        bits = [round(k * width / (radius + 1)) for k in range(radius + 2)]
        digits = [F.conv(F.substring(F.hex("fp"), 1 + 4 * k, 4), 16, 10).cast("int") for k in range(4)] if radius == 3 else None
        if digits is None:
            text = F.lpad(F.conv(F.hex("fp"), 16, 2), width, "0")
            digits = [F.conv(F.substring(text, 1 + a, b - a), 2, 10).cast("int") for a, b in zip(bits, bits[1:])]
        key = F.posexplode(F.array(*digits))
        keys = nodes.select("node", "fp", key).select("node", "fp", F.xxhash64("pos", "col").alias("key"))
        roots = connected_components(linked(keys, width, radius))
    else:
        text_key = F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key")
        nodes = keep(rows.groupBy("node", "fp", "bands", "shingles").agg(F.min("doc_id").alias("low"), text_key))
        keys = nodes.select("node", "fp", F.posexplode("bands")).select("node", "fp", F.xxhash64("pos", "col").alias("key"))
        candidates = keep(connected_components(linked(keys, width, radius)))
        roots = connected_components(similar(docs, nodes, candidates, shingle, width, radius, similarity))
    low = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    on = "fp" if exact else "node"
    low = keep(low.select(on, "root", "low"))
    least = keep(low.groupBy("root").agg(F.min("low").alias("component_id")))
    named = keep(low.join(least, "root").select(on, "component_id", "root"))
    return rows.join(named, on, "left").select("doc_id", "text_key", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class of near_duplicates(): the one of smallest doc_id, then smallest text_key."""
    classes = near_duplicates(docs, **how)
    best = classes.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "doc_id", "text_key")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("id"), F.col("b.text_key").alias("key"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    met = own.join(best, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    return met.dropDuplicates(["id", "key"]).select("row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, shingle=3, width=64, radius=3)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
