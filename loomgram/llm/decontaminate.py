"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.llm.text import unused
from loomgram.tables import keep

#: Words of a shingle; items of fewer words are one shingle.
SHINGLE = 5
#: Differing bits up to which every fingerprint is found: 4 blocks of 16 bits, of which one differs in at most 4.
RADIUS = 19
#: Shingles of the benchmark up to which they are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Documents with a shared shingle up to which their ids are broadcast, to read their texts again; beyond it texts are
#: shuffled to meet their windows.
BROADCAST_IDS = 1_000_000
#: Hashes that a 16-bit lane can count.
LANE_MAX = 32_767
#: Windows that are rolled in a row, at least; a quarter of the item's words, if that is more.
ROLLED = 64
_LANE = 0x0001000100010001
_HALVES = 0x0000000100000001


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(w: Column, size: int) -> Column:
    """64-bit hashes of all shingles of size words of the word array w; none if it has fewer words."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    return let(w, lambda w: F.when(F.size(w) >= size, hashed(w)).otherwise(F.array().cast("array<long>")))


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of 64-bit hashes, repeats included: a bit is 1 if set in over half of them.

    16 numbers of four 16-bit lanes each count all 64 bits at once, for up to LANE_MAX hashes; of longer arrays each bit
    is counted by itself.
    """

    def sums(hashes: Column) -> Column:
        zero = F.array(*[F.lit(0).cast("long")] * 16)
        lane = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANE))
        return F.aggregate(hashes, zero, lambda s, h: F.array(*(F.get(s, F.lit(k)) + lane(h, k) for k in range(16))))

    def bits(s: Column, n: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(16):
            for j in range(4):
                bit = 16 * j + k
                times = F.shiftrightunsigned(F.get(s, F.lit(k)), 16 * j).bitwiseAND(F.lit(0xFFFF))
                one = F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0)).cast("long")
                out = out.bitwiseOR(F.when(times * 2 > n, one).otherwise(F.lit(0).cast("long")))
        return out

    def long_bits(h: Column, n: Column) -> Column:
        often = lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1).cast("long"))) * 2 > n
        out = F.lit(0).cast("long")
        for k in range(64):
            one = F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long")
            out = out.bitwiseOR(F.when(often(k), one).otherwise(F.lit(0).cast("long")))
        return out

    short = lambda h, n: let(sums(h), lambda s: bits(s, n))
    return let(hashes, lambda h: let(F.size(h), lambda n: F.when(n <= LANE_MAX, short(h, n)).otherwise(long_bits(h, n))))


def rolled(hashes: Column, m: Column, starts: Column) -> Column:
    """SimHashes of the windows of m hashes that begin at the first `starts` places of an array of 64-bit hashes.

    The first window is summed, every other one is the one before without its first hash and with one more. 32 numbers
    of two 32-bit lanes count all bits.
    """
    one = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_HALVES))
    zero = F.array(*[F.lit(0).cast("long")] * 32)
    first = F.aggregate(F.slice(hashes, 1, m), zero, lambda s, h: F.array(*(F.get(s, F.lit(k)) + one(h, k) for k in range(32))))

    def bits(s: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            both = (F.get(s, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(F.get(s, F.lit(k)), 32), k + 32)
            for times, bit in both:
                value = F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0)).cast("long")
                out = out.bitwiseOR(F.when(times * 2 > m, value).otherwise(F.lit(0).cast("long")))
        return out

    def step(state: Column, i: Column) -> Column:
        moved = lambda old, new: F.array(*(F.get(state["s"], F.lit(k)) + one(new, k) - one(old, k) for k in range(32)))
        sums = let(F.get(hashes, i - 1), lambda old: let(F.get(hashes, i + m - 1), lambda new: moved(old, new)))
        return let(sums, lambda s: F.struct(s.alias("s"), F.concat(state["out"], F.array(bits(s))).alias("out")))

    begin = let(first, lambda s: F.struct(s.alias("s"), F.array(bits(s)).alias("out")))
    return F.aggregate(F.slice(F.sequence(F.lit(0), starts), 2, starts - 1), begin, step, lambda state: state["out"])


def _blocks(fp: Column) -> Column:
    return F.array(*(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)))


def _flips(most: int) -> Column:
    """All 16-bit masks of up to `most` bits."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit(0xFFFF).cast("long")), lambda m: F.bit_count(m) <= most)


def _shares(items: int, windows: int) -> tuple[int, int]:
    """How many of a block's RADIUS / 4 bits are flipped on the items' side and on the windows': all on the smaller side.

    With some flipped on each, two equal blocks would meet once for every mask.
    """
    return (RADIUS // 4, 0) if items <= windows else (0, RADIUS // 4)


def contaminated(docs: DataFrame, bench: DataFrame, at_least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words of each document and benchmark item (item_id, text) that it holds.

    A window is as many words as the item has (the whole text, if shorter), and is reported where its weighted
    shingle similarity to the item is at_least; of several windows the most similar, then the first. Windows without
    any of the item's shingles have similarity 0, so only windows over a shared shingle are fingerprinted. Blocks of
    the fingerprints meet in a join with all blocks within RADIUS / 4 bits of an item's, which finds every
    fingerprint within RADIUS; the exact similarity decides. At similarity 0.8 the distance is 10 bits on average. The
    bits are flipped on the items' side or on the windows', whichever has fewer fingerprints.

    Null and empty texts and items have no words and take no part. Rows with one doc_id count as one document; of rows
    without doc_id each text is one. Items with equal texts are reported each.
    """
    return _found(docs, bench, at_least).drop("own")


def _own() -> Column:
    """Tells rows without doc_id apart, by their text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def _found(docs: DataFrame, bench: DataFrame, at_least: float) -> DataFrame:
    # 128 bits tell texts apart; rows that are there twice share a key, and are then one text
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit("key"), "doc_id").alias("b"))
    docs = docs.select("doc_id", "text", _own().alias("own"), key.alias("key"))
    b = bench.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    b = keep(b.withColumn("n", F.size("w")).withColumn("s", F.least(F.size("w"), F.lit(SHINGLE))))
    sizes = [r["s"] for r in b.select("s").distinct().orderBy("s").collect()]
    if not sizes:
        kinds = f"own long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {bench.schema['item_id'].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, similarity double, start int, n_words int")
    hashes = F.coalesce(*(F.when(F.col("s") == s, shingles(F.col("w"), s)) for s in sizes))
    items = keep(keep(b.select("item_id", "n", "s", hashes.alias("hashes"))).withColumn("fp", fingerprint(F.col("hashes"))))
    known = keep(items.select("n", "s", F.explode("hashes").alias("h")).groupBy("s", "h").agg(F.collect_set("n").alias("ns")))
    few = known.count() <= BROADCAST_SHINGLES

    # shared shingles
    found, texts = None, docs
    for s in sizes:
        at = texts.select("key", F.posexplode(shingles(words(F.col("text")), s)).alias("p", "h"))
        own = known.where(F.col("s") == s).select("h", "ns")
        hit = at.join(F.broadcast(own) if few else own, "h").select("key", F.lit(s).alias("s"), "p", "h", "ns")
        found = hit if found is None else found.union(hit)
    found = keep(found)

    # the words at which windows of the item's size over them begin, in ranges that don't overlap; past the end is cut later
    spots = found.select("key", "s", "p", F.explode("ns").alias("n"))
    spots = spots.withColumn("low", F.greatest(F.lit(0), F.col("p") - F.col("n") + F.col("s")))
    by = Window.partitionBy("key", "s", "n").orderBy("p")
    fresh = F.coalesce((F.col("low") > F.lag("p").over(by) + 1).cast("int"), F.lit(1))
    ranges = spots.withColumn("fresh", fresh).withColumn("range", F.sum("fresh").over(by))
    ranges = ranges.groupBy("key", "s", "n", "range").agg(F.min("low").alias("low"), F.max("p").alias("high"))
    ranges = ranges.withColumn("step", F.greatest(F.lit(ROLLED), F.floor(F.col("n") / 4).cast("int")))
    runs = ranges.select("key", "s", "n", "high", "step", F.explode(F.sequence("low", "high", "step")).alias("low"))
    run = F.struct("n", "low", F.least(F.col("low") + F.col("step") - 1, "high").alias("high"))
    starts = keep(runs.groupBy("key", "s").agg(F.collect_list(run).alias("runs")))

    def cut_runs(s: int) -> Column:
        """The hashes under each run of windows; m of them are a window."""

        def cut(h: Column, x: Column) -> Column:
            last, m = F.greatest(F.lit(0), F.size(h) + (s - 1) - x["n"]), F.least(x["n"] - (s - 1), F.size(h))
            low, high = F.least(x["low"], last), F.least(x["high"], last)
            return F.struct(x["n"].alias("n"), low.alias("low"), (high - low + 1).alias("starts"), m.alias("m"), F.slice(h, low + 1, high - low + m).alias("hashes"))

        return let(shingles(words(F.col("text")), s), lambda h: F.transform("runs", lambda x: cut(h, x)))

    # the fingerprints of those windows, where the text is
    cut = None
    ids = starts.select("key").distinct()
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "key", "left_semi")
    for s in sizes:
        own = texts.join(starts.where(F.col("s") == s).drop("s"), "key").select("doc_id", "own", "key", F.lit(s).alias("s"), F.explode(cut_runs(s)).alias("x"))
        cut = own if cut is None else cut.union(own)
    cut = cut.select("doc_id", "own", "key", "s", "x.*").where("m > 0")
    cut = cut.select("doc_id", "own", "key", "s", "n", "m", "low", F.posexplode(rolled(F.col("hashes"), F.col("m"), F.col("starts"))).alias("k", "window_fp"))
    cut = keep(cut.withColumn("start", F.col("low") + F.col("k")).drop("low", "k"))

    # distinct fingerprints, and blocks of their bits with up to RADIUS / 4 bits flipped
    ours, theirs = keep(items.select("n", "fp").distinct()), keep(cut.select("n", "window_fp").distinct())
    here, there = _shares(ours.count(), theirs.count())

    def blocks(rows: DataFrame, fp: str, flips: int) -> DataFrame:
        rows = rows.select("n", fp, F.posexplode(_blocks(F.col(fp))).alias("k", "v"))
        return rows.select("n", fp, "k", F.explode(F.transform(_flips(flips), lambda m: F.col("v").bitwiseXOR(m))).alias("v")) if flips else rows

    near = blocks(theirs, "window_fp", there).join(blocks(ours, "fp", here).hint("shuffle_merge"), ["n", "k", "v"])
    near = keep(near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("window_fp"))) <= RADIUS).select("n", "window_fp", "fp").distinct())
    met = cut.join(near, ["n", "window_fp"]).join(items.select("n", "fp", "item_id", F.size("hashes").alias("size")), ["n", "fp"])
    both = _similarities(keep(met.drop("window_fp", "fp")), items, found).where(F.col("similarity") >= at_least)
    best = both.groupBy("doc_id", "own", "item_id").agg(F.max_by(F.struct("similarity", "start", F.col("n").alias("n_words")), F.struct("similarity", -F.col("start"))).alias("x"))
    return best.select("own", "doc_id", "item_id", "x.*")


def _similarities(windows: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """windows (key, s, n, m, start, item_id, size) plus similarity: weighted Jaccard of the m shingles from start and the
    item's size ones, each weighing as often as it occurs: sum of minima by sum of maxima.

    Of a shingle that the item has c times, an occurrence counts in the windows that hold it, but not the one c before:
    these are a range of starts, so that all windows of a text and an item are running sums over the ends of such ranges.
    """
    on = ["key", "s", "item_id"]
    pairs = windows.select(*on, "m").distinct()
    times = items.select("item_id", "s", F.explode("hashes").alias("h")).groupBy("item_id", "s", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    spots = pairs.join(times, ["item_id", "s"]).join(found.select("key", "s", "h", "p"), ["key", "s", "h"])
    spots = spots.groupBy(*on, "m", "h", "c").agg(F.array_sort(F.collect_set("p")).alias("at"))
    ranges = F.transform("at", lambda p, j: F.struct(F.greatest(F.lit(0), p - F.col("m") + 1, F.coalesce(F.get("at", j - F.col("c")) + 1, F.lit(0))).alias("low"), (p + 1).alias("end")))
    ranges = spots.select(*on, F.explode(ranges).alias("r"))
    ends = ranges.select(*on, F.explode(F.array(F.struct(F.col("r.low").alias("start"), F.lit(1).alias("d")), F.struct(F.col("r.end").alias("start"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy(*on, "e.start").agg(F.sum("e.d").alias("d"))
    rows = windows.withColumn("d", F.lit(0).cast("long")).unionByName(ends, allowMissingColumns=True)
    shared = F.sum("d").over(Window.partitionBy(*on).orderBy("start"))
    rows = rows.withColumn("shared", shared).where("n is not null")
    return rows.withColumn("similarity", F.col("shared") / (F.col("m") + F.col("size") - F.col("shared"))).drop("shared", "d")


def remove_contaminated(docs: DataFrame, bench: DataFrame, at_least: float = 0.8) -> DataFrame:
    """docs without those that hold a benchmark item, all columns as they are; rows without doc_id go by their text."""
    id_, own = unused(docs, "found_id"), unused(docs, "found_own")
    found = _found(docs, bench, at_least).select(F.col("doc_id").alias(id_), F.col("own").alias(own)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (_own() == F.col(own)), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() of the tables documents and benchmark; null and empty texts hold no item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
