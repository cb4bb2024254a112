"""Removal of repeated strings of bytes by deep-shallow sorting of suffixes.

Any two equal strings of min_bytes have an anchor at the same place: the gram of half their length whose hash is
smallest among those inside (winnowing). Anchors that occur twice bring together the text around them; sorting what
follows and what precedes an anchor gives the longest common parts, and thus which strings over it are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import aside, mix, powers, prefix_sums, slices, span_hash, text_bytes, unused
from loomgram.tables import keep

#: Bytes to which multikey quicksort sorts; groups that are equal so far go to blind tries.
SHALLOW = 16
#: Occurrences of an anchor that one task sorts; more of them are dealt out string by string.
LARGEST = 20000
#: Occurrences up to which all pairs of one anchor are looked at in a matrix; more go by classes.
SQUARE = 600
#: Bytes from which op7_suffixes reports a repeated passage: 50 words of four letters or so.
PASSAGE = 240
#: What remove_repeats() adds.
COLUMNS = ("n_repeated", "kept", "kept_text", "n_removed", "n_spans")


def _lcp(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix; low bytes are known to be equal."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("at", "next")

    def __init__(self, at: int):
        self.at, self.next = at, {}


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """(order, common prefix of neighbours) of strings that agree in depth bytes.

    Inner nodes hold the place of a branching byte only. A string goes down blindly to some leaf, is compared with
    that one string, and is put in where they part; leaves list equal strings.
    """
    root: _Node | list[int] = [group[0]]
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, _Node):
            node = node.next.get(s[node.at] if node.at < len(s) else -1) or next(iter(node.next.values()))
        other = strings[node[0]]
        common = _lcp(s, other, depth)
        if common == len(s) == len(other):
            node.append(i)
            continue
        up, node = None, root
        while isinstance(node, _Node) and node.at < common:
            up, node = (node, s[node.at]), node.next[s[node.at]]
        mine = s[common] if common < len(s) else -1
        if isinstance(node, _Node) and node.at == common:
            node.next[mine] = [i]
            continue
        fork = _Node(common)
        fork.next[other[common] if common < len(other) else -1] = node
        fork.next[mine] = [i]
        if up is None:
            root = fork
        else:
            up[0].next[up[1]] = fork
    order: list[int] = []
    common_: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Node):
            for k, c in enumerate(sorted(node.next, reverse=True)):
                stack.append((node.next[c], before if k == len(node.next) - 1 else node.at))
        else:
            common_.append(before)
            common_ += [len(strings[node[0]])] * (len(node) - 1)
            order += node
    return order, common_[1:]


def deep_shallow(strings: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    """(sorted order, common prefix length of each with the next): multikey quicksort, then blind tries.

    The strings agree in their first `known` bytes; quicksort sorts by the SHALLOW bytes after them.
    """
    order: list[int] = []
    common: list[int] = []
    shallow = known + SHALLOW
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), known, 0)]
    while stack:
        group, depth, before = stack.pop()
        if order:
            common.append(before)
        if len(group) == 1:
            order.append(group[0])
        elif depth >= shallow:
            part, inner = _blind_trie(strings, group, depth)
            order += part
            common += inner
        else:
            if order:
                common.pop()
            char = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
            pivot = sorted((char[0], char[len(char) // 2], char[-1]))[1]
            less = [i for i, c in zip(group, char) if c < pivot]
            same = [i for i, c in zip(group, char) if c == pivot]
            more = [i for i, c in zip(group, char) if c > pivot]
            first = before
            parts = []
            if less:
                parts.append((less, depth, first))
                first = depth
            if pivot >= 0:
                parts.append((same, depth + 1, first))
            else:  # strings that end here are equal
                parts.append((same, shallow, first))
            if more:
                parts.append((more, depth, depth))
            stack += parts[::-1]
    return order, common


class _Sorted:
    """Distinct strings in deep-shallow order; own: of each string, the number of its distinct one."""

    def __init__(self, strings: list[bytes], known: int = 0):
        number: dict[bytes, int] = {}
        self.own = np.array([number.setdefault(x, len(number)) for x in strings])
        kinds = list(number)
        self.size = np.array([len(x) for x in kinds])
        order, common = deep_shallow(kinds, known)
        self.order, self.common = np.array(order), np.array(common, np.int64)

    def classes(self, depth: int) -> np.ndarray:
        """Of each string, the number of its class of strings that agree in depth bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.common < depth)]
        return out[self.own]

    def pairs(self) -> np.ndarray:
        """Length of the common prefix of all pairs of strings."""
        n = len(self.order)
        far = np.zeros((n, n), np.int64)
        if n > 1:
            at = np.arange(n - 1)
            upper = np.minimum.accumulate(np.where(at >= np.arange(n)[:, None], self.common, 1 << 40), axis=1)
            place = np.empty(n, np.int64)
            place[self.order] = np.arange(n)
            far[:, 1:] = np.where(at >= np.arange(n)[:, None], upper, 0)
            far = np.maximum(far, far.T)[place[:, None], place]
        far[np.arange(n), np.arange(n)] = self.size
        return far[self.own[:, None], self.own]


def covered(left: list[bytes], right: list[bytes], levels: list[int], gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, how far before and after each occurrence of an anchor the repeated strings of that many bytes over it reach.

    left: what precedes, backwards; right: what follows, the anchor included; no two occurrences have both alike.
    (0, 0): no such string. All levels come from one sorting of both sides.
    """
    n = len(right)
    if n == 2:
        a, b = _lcp(left[0], left[1]), _lcp(right[0], right[1])
        return [((a, a), (b, b)) if a + b >= most else ((0, 0), (0, 0)) for most in levels]
    alike = len({x[:gram] for x in right}) == 1  # else two grams have one hash
    one, two = _Sorted(left), _Sorted(right, gram * alike)
    if n > SQUARE:
        return [_reach(one, two, most, gram) for most in levels]
    before, after = one.pairs(), two.pairs()
    both = before + after
    both[np.arange(n), np.arange(n)] = 0
    return [(np.where(both >= most, before, 0).max(axis=1).tolist(), np.where(both >= most, after, 0).max(axis=1).tolist()) for most in levels]


def _reach(one: _Sorted, two: _Sorted, most: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """covered() at one level for many occurrences: classes by what precedes and what follows at each depth at which they change."""
    n = len(one.own)
    left_n, right_n = one.size[one.own], two.size[two.own]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in np.unique(np.clip(np.r_[0, most - gram, one.common, one.size, most - two.common, most - two.size], 0, most - gram)).tolist():
        fit = np.flatnonzero((left_n >= o) & (right_n >= most - o))
        if len(fit) < 2:
            continue
        both = one.classes(o)[fit] * (len(two.order) + 1) + two.classes(most - o)[fit]
        _, at, times = np.unique(both, return_inverse=True, return_counts=True)
        hit = fit[times[at] > 1]
        before[hit] = o
        first = hit[after[hit] == 0]
        after[first] = most - o
    return before.tolist(), after.tolist()


def _slide(x: np.ndarray, w: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over each w neighbours of x: out[i] = f(x[i : i + w])."""
    n = len(x)
    y = np.full(-(-n // w) * w, pad, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    head = f.accumulate(y, axis=1).ravel()
    tail = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(tail[: n - w + 1], head[w - 1 : n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    sums = prefix_sums(data)
    _, inverse = powers(len(data) + 1)
    return mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]) | np.uint64(1)


def anchors(h: np.ndarray, off: np.ndarray, most: int, gram: int) -> np.ndarray:
    """Whether each gram, of hashes h, is smallest by hash in some string of `most` bytes of one row."""
    w = most - gram + 1
    if len(h) < w:
        return np.zeros(len(h), bool)
    low = _slide(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
    whole = np.zeros(len(low) + 1, np.int8)  # strings that lie in one row
    size = np.diff(off)
    np.add.at(whole, off[:-1][size >= most], 1)
    np.add.at(whole, off[1:][size >= most] - most + 1, -1)
    low[np.cumsum(whole[:-1]) == 0] = 0
    edge = np.zeros(w - 1, np.uint64)
    return _slide(np.concatenate([edge, low, edge]), w, np.maximum, 0) == h


def _anchor_rows(low: int, high: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_bytes(b.column("text"))
            if len(data) < low:
                continue
            h = gram_hashes(data, gram)
            at = np.flatnonzero(anchors(h, off, low, gram))
            wide = np.ones(len(at), bool) if low == high else anchors(h, off, high, gram)[at]
            row = np.searchsorted(off, at, "right") - 1
            key = b.column("key").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(key), pa.array(at - off[row]), pa.array(wide)], ["h", "key", "pos", "wide"])

    return task


def _context_rows(low: int, high: int, gram: int):
    """What stands around each anchor: enough for strings of `high` bytes over wide ones, of `low` bytes over the others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for text, spots in zip(b.column("text").to_pylist(), b.column("spots").to_pylist()):
                raw = text.encode()
                name = hashlib.md5(raw).digest()
                seen: dict[tuple, list[int]] = {}
                for s in spots:
                    p, most = s["pos"], high if s["wide"] else low
                    if p + gram <= len(raw):
                        seen.setdefault((s["h"], raw[max(0, p - most + gram) : p], raw[p : p + most]), []).append(p)
                for (h, left, right), at in seen.items():
                    out.append((h, name, at[0], left[::-1], right, None))
                    if len(at) > 1 and len(left) + len(right) >= low:
                        out += [(None, name, p, None, None, (len(left) << 32) + len(right)) for p in at]
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "name", "pos", "before", "after", "found"])

    return task


_SPAN = "name binary, low long, high long, wide boolean"


def _sort_rows(low: int, high: int, gram: int):
    levels = sorted({low, high})

    tops = [(k, most, most == high) for k, most in enumerate(levels)][::-1]

    def close(names: list[bytes], places: list[int], befores: list[bytes], afters: list[bytes], found: tuple[list, ...]) -> None:
        if len(names) < 2:
            return
        alike: dict[tuple, list[tuple]] = {}
        for name, place, before, after in zip(names, places, befores, afters):
            key = before, after
            if key in alike:
                alike[key].append((name, place))
            else:
                alike[key] = [(name, place)]
        kinds = list(alike)
        reach = covered([k[0] for k in kinds], [k[1] for k in kinds], levels, gram) if len(kinds) > 1 else None
        for i, ((before, after), rows) in enumerate(alike.items()):
            if len(rows) > 1:
                rows = list(dict.fromkeys(rows))  # a repeated row is one occurrence
            last = (0, 0)
            for level, most, wide in tops:
                a, b = (reach[level][0][i], reach[level][1][i]) if reach else (0, 0)
                if len(rows) > 1 and len(before) + len(after) >= most:
                    a, b = len(before), len(after)
                if a + b and (a, b) != last:
                    last = a, b
                    for name, p in rows:
                        found[0].append(name), found[1].append(p - a), found[2].append(p + b), found[3].append(wide)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        last = None
        found: tuple[list, ...] = ([], [], [], [])

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(found, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))]
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["name", "low", "high", "wide"])

        for batch in batches:
            h = batch.column("h").to_numpy()
            if not len(h):
                continue
            cols = [batch.column(c).to_pylist() for c in ("name", "pos", "before", "after")]
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for i, j in zip(cuts, cuts[1:]):
                if last == h[i]:
                    for x, c in zip(held, cols):
                        x += c[i:j]
                    continue
                close(*held, found)
                last, held = h[i], [c[i:j] for c in cols]
            if found[0]:
                yield out()
        close(*held, found)
        if found[0]:
            yield out()

    return task


def _string_rows(low: int, high: int, gram: int):
    """Hash of each string of `low` and of `high` bytes over an anchor, for anchors that occur too often for one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                before, after = part.column("before").to_pylist(), part.column("after").to_pylist()
                raw = b"".join(x[::-1] + y for x, y in zip(before, after))
                sums = prefix_sums(np.frombuffer(raw, np.uint8))
                a, c = np.array([len(x) for x in before]), np.array([len(x) for x in after])
                base = np.cumsum(a + c) - c  # the anchor's place
                for most in sorted({low, high}):
                    first, last = np.maximum(0, most - c), np.minimum(a, most - gram)  # bytes before the anchor
                    times = np.maximum(last - first + 1, 0)
                    row = np.repeat(np.arange(len(a)), times)
                    o = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
                    hashes = span_hash(sums, base[row] - o, base[row] - o + most)
                    of = pa.array(row)
                    cols = [*(part.column(x).take(of) for x in ("h", "kind", "again", "own", "pos")), pa.array(np.full(len(row), most)), pa.array(hashes.view(np.int64)), pa.array(o)]
                    yield pa.RecordBatch.from_arrays(cols, ["h", "kind", "again", "own", "pos", "most", "string", "o"])

    return task


def repeated_spans(docs: DataFrame, min_bytes: int = 400, report_bytes: int | None = None) -> DataFrame:
    """name (MD5 of a text), spans (array of low, high: maximal runs of bytes that lie in a string of min_bytes that occurs
    again) and n_repeated (bytes that lie in such a string of report_bytes, by default of min_bytes; at most min_bytes).

    Repeats inside a text and with other texts count here; copies of a whole text don't, see remove_repeats(). An
    anchor with up to LARGEST occurrences is sorted in one task. One with more is dealt out: occurrences that stand
    in equal surroundings are one kind, the kinds' strings meet by their hashes, and what a kind has found goes back to
    its occurrences in a join that Spark can split.
    """
    low, high = report_bytes or min_bytes, min_bytes
    if low > high:
        raise ValueError("report_bytes must be min_bytes at most")
    gram = max(1, low // 2)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where(F.octet_length("text") >= low)
    spots = keep(rows.mapInArrow(_anchor_rows(low, high, gram), "h long, key long, pos long, wide boolean"))
    twice = spots.groupBy("h").agg(F.min(x := F.xxhash64("key", "pos")).alias("a"), F.max(x).alias("b")).where("a <> b").select("h")
    again = keep(twice)
    at = spots.join(again, "h").groupBy("key").agg(F.collect_set(F.struct("h", "pos", "wide")).alias("spots"))
    first = rows.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first"))
    at = at.join(first, "key")
    texts = rows.withColumn("first", F.coalesce("doc_id", F.lit(2**63 - 1))).join(at, ["key", "first"]).select("text", "spots")
    around = keep(texts.mapInArrow(_context_rows(low, high, gram), "h long, name binary, pos long, before binary, after binary, found long"))
    left, right = F.shiftright("found", 32), F.col("found").bitwiseAND(F.lit(0xFFFFFFFF))
    inside = around.where("found is not null").select("name", (F.col("pos") - left).alias("low"), (F.col("pos") + right).alias("high"), (left + right >= high).alias("wide"))
    around = around.where("found is null").drop("found")
    often = keep(around.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST).select("h"))
    few = around.join(often, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    few = few.mapInArrow(_sort_rows(low, high, gram), _SPAN)

    many = around.join(often, "h").withColumn("kind", F.xxhash64("before", "after"))
    x = F.xxhash64("name", "pos")
    own = [F.xxhash64(F.min("name")).alias("own"), F.min("pos").alias("pos")]  # of a kind's only occurrence
    kinds = many.groupBy("h", "kind").agg((F.min(x) != F.max(x)).alias("again"), *own, F.min("before").alias("before"), F.min("after").alias("after"))
    strings = keep(kinds).mapInArrow(_string_rows(low, high, gram), "h long, kind long, again boolean, own long, pos long, most long, string long, o long")
    x = F.xxhash64("own", F.col("pos") - F.col("o"))  # over several anchors of equal hash a string is still one
    both = strings.groupBy("h", "most", "string").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.max("again").alias("again"))
    both = keep(both.where("a <> b or again").select("h", "most", "string"))
    met = strings.join(both, ["h", "most", "string"]).groupBy("h", "kind", "most").agg(F.max("o").alias("before"), F.min("o").alias("least"))
    met = keep(met)
    many = many.select("h", "kind", "name", "pos").join(met, ["h", "kind"])
    many = many.select("name", (F.col("pos") - F.col("before")).alias("low"), (F.col("pos") + F.col("most") - F.col("least")).alias("high"), (F.col("most") == high).alias("wide"))
    return _merged(inside.union(few).union(many))


def _merged(spans: DataFrame) -> DataFrame:
    """name, spans (maximal runs of the wide ones) and n_repeated (bytes in any) of spans (name, low, high, wide).

    A name's spans are sorted as Spark's windows sort, so that only its maximal runs are ever gathered in one row.
    """
    order = Window.partitionBy("name").orderBy("low", "high", "wide")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide_high = F.when(F.col("wide"), F.col("high"))
    own = spans.withColumn("past", F.max("high").over(before)).withColumn("wide_past", F.max(wide_high).over(before))
    new = F.col("wide") & (F.col("wide_past").isNull() | (F.col("low") > F.col("wide_past")))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("high") - F.greatest("low", F.coalesce("past", "low")))
    own = own.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("fresh", fresh)
    runs = own.groupBy("name", "run").agg(F.min(F.when(F.col("wide"), F.col("low"))).alias("low"), F.max(wide_high).alias("high"), F.sum("fresh").alias("fresh"))
    one = F.when(F.col("low").isNotNull(), F.struct("low", "high"))
    return runs.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("spans"), F.sum("fresh").alias("n_repeated"))


def _cut(spans_column: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, removed, runs_ = [], [], []
            for text, spans in zip(b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), b.column(spans_column).to_pylist()):
                raw, out, at = text or b"", [], 0
                for s in spans or []:
                    out.append(raw[at : s["low"]])
                    at = s["high"]
                out.append(raw[at:])
                kept.append(b"".join(out)), removed.append(len(raw) - len(kept[-1])), runs_.append(len(spans or []))
            b = b.remove_column(b.schema.get_field_index(spans_column))
            whole = [x.decode(errors="ignore") for x in kept]
            for name, values in (("kept", pa.array(kept, pa.binary())), ("kept_text", pa.array(whole, pa.string())), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(runs_, pa.int64()))):
                b = b.append_column(name, values)
            yield b

    return task


def remove_repeats(docs: DataFrame, min_bytes: int = 400, report_bytes: int | None = None) -> DataFrame:
    """docs plus n_repeated, kept (the text's bytes that stay, binary), kept_text (the same without cut characters), n_removed and n_spans (maximal runs that went).

    A byte goes if a string of min_bytes over it also starts anywhere else in docs, the same text included. All
    occurrences go. n_repeated counts the bytes in strings of report_bytes (by default min_bytes) that start anywhere
    else; those under min_bytes are reported and stay. Null texts are empty and stay null in text; texts under
    min_bytes stay whole. Of copies of a whole text one takes part in the search; that there are others is counted.
    Columns of docs that have a new column's name come back as aside() names them.
    """
    low = report_bytes or min_bytes
    docs, _ = aside(docs, *COLUMNS)
    key, cut = unused(docs, "text_name"), unused(docs, "spans")
    name = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(docs, min_bytes, report_bytes)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    own = docs.select(name.alias("name"), size.alias("size")).where(F.col("size") >= low)
    copies = own.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    found = spans.join(copies, "name", "full")
    found = found.select("name", F.when(F.col("size") >= min_bytes, whole).otherwise(F.col("spans")).alias("spans"), F.coalesce("size", "n_repeated").alias("n_repeated"))
    found = keep(found.select(F.col("name").alias(key), F.col("spans").alias(cut), "n_repeated"))
    met = docs.withColumn(key, name).join(found, key, "left").drop(key).withColumn("n_repeated", F.coalesce("n_repeated", F.lit(0).cast("long")))
    met = met.select(*docs.columns, "n_repeated", cut)
    new = [T.StructField("n_repeated", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
    return met.mapInArrow(_cut(cut), T.StructType([*docs.schema.fields, *new]))


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; n_repeated reports passages from PASSAGE bytes on, which are 50 words of four letters or so."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, 400, PASSAGE)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
