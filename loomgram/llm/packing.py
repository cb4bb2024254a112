"""Packing of tokenised documents into sequences by best-two-fit."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import SPACE, aside, slices, text_bytes
from loomgram.tables import keep

#: Pre-tokens of the byte-level BPE vocabulary (the pattern published with GPT-2). Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces packed together in one group.
GROUP_PIECES = 8000
#: Encoded chunks of text that a task remembers.
REMEMBERED = 400_000


def encoder(path: str):
    """An encoder with the ranks of a byte-level BPE file of the tokenizers library; it gives the same ids, faster.

    The literal text of an added token is text like any other to it; encode_texts() takes such texts.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a text can be cut and encoded chunk by chunk: at its start and at single white-space signs in it.

    A pre-token holds a space at its start only, and a single line feed is a pre-token of its own, so that both
    begin one. The sign before and the one after must be ASCII or Latin-1 letters, that is no white space.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid = ~SPACE[data] & (data < 128)
        latin = data == 0xC3
        before = solid[:-2] | (np.r_[False, latin[:-3]] & (data[:-2] >= 128))
        cut[1 : n - 1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & before & (solid | latin)[2:]
    cut[off] = True
    return np.flatnonzero(cut[:n])


def encode(data: np.ndarray, off: np.ndarray, enc, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their offsets by row) of whole texts; each distinct chunk is encoded once and remembered in known."""
    at = chunk_starts(data, off)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    ends = np.r_[at, len(data)]
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
    coded = text.dictionary_encode()
    chunks = coded.dictionary.to_pylist()
    if len(known) > REMEMBERED:
        known.clear()
    ids = []
    for c in chunks:
        x = known.get(c)
        if x is None:
            x = known[c] = enc.encode_ordinary(c)
        ids.append(x)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
    first = np.cumsum(size) - size
    code = coded.indices.to_numpy(zero_copy_only=False)
    length = size[code]
    to = np.cumsum(length)
    where = np.arange(int(to[-1])) + np.repeat(first[code] - (to - length), length)
    return flat[where], np.r_[0, to][np.searchsorted(at, off, "left")]


class AddedTokens:
    """The added tokens of a file, and its own tokenizer for the texts that hold one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.contents = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.path, self._own = path, None

    def inside(self, column: pa.Array) -> np.ndarray:
        """Which texts hold one."""
        out = np.zeros(len(column), bool)
        for c in self.contents:
            out |= pc.fill_null(pc.match_substring(column, c), False).to_numpy(zero_copy_only=False)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        from tokenizers import Tokenizer

        if self._own is None:
            self._own = Tokenizer.from_file(self.path)
        return [np.array(self._own.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]


def encode_texts(column: pa.Array, enc, known: dict, added: AddedTokens) -> tuple[np.ndarray, np.ndarray]:
    """As encode(), for a column of texts; where the literal text of an added token stands, there is that token."""
    hit = added.inside(column)
    if not hit.any():
        return encode(*text_bytes(column), enc, known)
    ids, at = encode(*text_bytes(pc.if_else(pa.array(hit), "", column)), enc, known)
    rows = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
    where = np.flatnonzero(hit)
    for k, x in zip(where.tolist(), added.encode(column.take(pa.array(where)).to_pylist())):
        rows[k] = x
    return np.concatenate(rows), np.r_[0, np.cumsum([len(x) for x in rows])]


def tokenize(docs: DataFrame, path: str, most: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids of each piece of at most `most` tokens.

    A document is its text's ids, as the tokenizers library gives them by default, and then `end`; a null text is empty.
    Longer ones are cut so that the first piece may be shorter.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, added = encoder(path), {}, AddedTokens(path)
        for b in slices(batches, limit=4 << 20):
            ids, at = encode_texts(b.column("text"), enc, known, added)
            take, piece, start, length, crc, own = [], [], [], [], [], []
            for k in range(b.num_rows):
                x = np.empty(at[k + 1] - at[k] + 1, "<u4")
                x[:-1], x[-1] = ids[at[k] : at[k + 1]], end
                low, high, p = 0, (len(x) - 1) % most + 1, 0
                while low < len(x):
                    part = x[low:high]
                    take.append(k), piece.append(p), start.append(low), length.append(high - low), crc.append(zlib.crc32(part))
                    if with_ids:
                        own.append(part)
                    low, high, p = high, high + most, p + 1
            cols = [b.column("doc_id").take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(own, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    return docs.select("doc_id", "text").mapInArrow(task, T.StructType(fields))


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin is filled greedily: the longest left, then again and again the longest that fits. Then its smallest is put
    back, if two of those left fill the widened gap further than it did; this repeats as long as it helps. Bins that are
    not full in the end are packed once more, longest first and each where it fits best, if that takes fewer of them.
    """
    order = np.argsort(-lengths, kind="stable")
    rows: list[list[int]] = [[] for _ in range(most + 1)]
    for i in order[::-1].tolist():
        rows[int(lengths[i])].append(i)
    count = np.array([len(r) for r in rows])
    sizes = np.arange(most + 1)
    below = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # the longest left of at most each size

    def take(n: int) -> None:
        count[n] -= 1
        if not count[n]:
            stop = n + 1
            while stop <= most and not count[stop]:
                stop += 1
            below[n:stop] = below[n - 1]

    def give(n: int) -> None:
        count[n] += 1
        if count[n] == 1:
            stop = n + 1
            while stop <= most and not count[stop]:
                stop += 1
            below[n:stop] = n

    full, open_ = [], []
    while below[most]:
        held, gap = [], most
        while gap and (n := int(below[gap])):
            take(n)
            held.append(n)
            gap -= n
        while gap and len(held) > 1 and below[most]:
            small = min(held)
            room = gap + small
            a = sizes[1 : room // 2 + 1]
            a = a[count[a] > 0]
            b = below[room - a]
            b = np.where((b == a) & (count[a] < 2), below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            k = len(total) - 1 - int(np.argmax(total[::-1])) if len(total) else 0  # of equal sums the one of like sizes
            if not len(total) or total[k] <= small:
                break
            x, y = int(a[k]), int(b[k])
            held.remove(small)
            take(x)
            take(y)
            give(small)
            held += [x, y]
            gap = room - x - y
        (open_ if gap else full).append([rows[n].pop() for n in held])
    again = _best_fit([i for own in open_ for i in own], lengths, most)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, own in enumerate(full + min(open_, again, key=len)):
        at = 0
        for i in own:
            where[i], offset[i] = number, at
            at += lengths[i]
    return where, offset


def _best_fit(rows: list[int], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of rows, longest first, each in the bin whose gap it fills best."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (gap, bin), in order
    for i in sorted(rows, key=lambda i: -lengths[i]):
        n = int(lengths[i])
        k = bisect.bisect_left(gaps, (n, -1))
        if k < len(gaps):
            gap, number = gaps.pop(k)
        else:
            gap, number = most, len(bins)
            bins.append([])
        bins[number].append(i)
        if gap > n:
            bisect.insort(gaps, (gap - n, number))
    return bins


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """pieces (doc_id, piece, length of 1 to most, ...) plus sequence_id and offset.

    Pieces are dealt to groups of about GROUP_PIECES by a hash of their place in the written table, so that repeated
    rows are spread like any others; each group is packed in one task. Full pieces are sequences of their own. Columns
    of pieces that have a new column's name come back as aside() names them.
    """
    pieces, _ = aside(pieces, "sequence_id", "offset")
    pieces = keep(pieces)
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    spread = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("sequence_id", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).withColumn("offset", F.lit(0).cast("long"))

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in spread])
        where, offset = best_two_fit(t.column("length").to_numpy(), most)
        base = t.column("sequence_id").to_numpy().astype(np.int64) << 32
        t = t.set_column(t.schema.get_field_index("sequence_id"), "sequence_id", pa.array(base + where))
        return t.set_column(t.schema.get_field_index("offset"), "offset", pa.array(offset))

    return dealt.groupBy("sequence_id").applyInArrow(group, dealt.schema)


def pack_documents(docs: DataFrame, path: str | None = None, most: int = 1024, end: int = 2) -> DataFrame:
    """tokenize(), then pack(): one row for each piece, with its sequence_id and offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(tokenize(docs, path, most, end), most)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
