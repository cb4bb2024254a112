"""Interval series: bins to intervals and back, run lengths, gap filling, liftover.

A binned series is rows (*keys, bin, flag) with a row for each bin; intervals are rows (*keys, start, end).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.operators import kmers


def merge_bins(flagged: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Intervals of adjacent flagged bins (rows with start); end is inclusive: start + n * bin - 1."""
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce(F.col("start") != F.lag("start").over(order) + bin_size, F.lit(True)).cast("int")
    island = flagged.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), (F.max("start") + bin_size - 1).alias("end")).drop("island")


def to_bins(intervals: DataFrame, bin_size: int) -> DataFrame:
    """Bins of each interval: both ends go to the nearest bin, halves to the even one; a short interval has its start's
    bin if it is as long as a quarter of a bin."""
    near = lambda c: (F.rint(F.col(c) / bin_size) * bin_size).cast("long")
    rows = intervals.withColumn("a", near("start")).withColumn("b", near("end"))
    some = F.sequence(F.col("a"), F.greatest(F.col("a"), F.col("b") - bin_size), F.lit(bin_size).cast("long"))
    one = F.when(F.col("end") - F.col("start") >= bin_size / 4, F.array("a")).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("bin", F.explode(F.when(F.col("a") < F.col("b"), some).otherwise(one))).drop("a", "b")


def _by_key(marked: DataFrame, spans: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """keys, size and bins, the marked ones of spans (*keys, size), in a row for each key.

    Both sides meet in one grouping by key. A join with all bins of all spans would be planned from the size of spans, and so
    might send those bins to each task through the driver. The number of partitions is fixed, as rows are few here and many
    once bins are made of them.
    """
    hit = marked.select(*keys, F.lit(None).cast("long").alias("size"), F.col("bin").cast("long").alias("bin")).dropna(subset=keys)
    both = spans.where("size > 0").select(*keys, F.col("size").cast("long").alias("size"), F.lit(None).cast("long").alias("bin")).unionByName(hit)
    parts = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * spans.sparkSession.sparkContext.defaultParallelism)
    rows = both.repartition(parts, *keys).groupBy(*keys).agg(F.max("size").alias("size"), F.collect_set("bin").alias("bins")).where("size is not null")
    inside = lambda b: (b >= 0) & (b < F.col("size")) & (b % bin_size == 0)
    return rows.withColumn("bins", F.filter("bins", inside))


def flagged(marked: DataFrame, spans: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """keys, bin, flag of the rows of dense() whose flag is 1, without the others being made."""
    return _by_key(marked, spans, keys, bin_size).select(*keys, F.explode("bins").alias("bin"), F.lit(1).alias("flag"))


def dense(marked: DataFrame, spans: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """keys, bin, flag for each bin of spans (*keys, size), a row for each key; labels past the last bin are left out."""
    all_ = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(bin_size).cast("long"))
    of = lambda bins, x: F.transform(bins, lambda b: F.struct(b.alias("bin"), F.lit(x).alias("flag")))
    both = F.concat(of(F.col("bins"), 1), of(F.array_except(all_, F.col("bins")), 0))
    return _by_key(marked, spans, keys, bin_size).select(*keys, F.inline(both))


def runs(series: DataFrame, keys: list[str]) -> DataFrame:
    """series plus run (number), length of its run, and before, after: the flags of the runs next to it (or null)."""
    order = Window.partitionBy(*keys).orderBy("bin")
    change = F.coalesce((F.col("flag") != F.lag("flag").over(order)).cast("int"), F.lit(1))
    out = series.withColumn("run", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    out = out.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))).withColumn("last", F.max("run").over(whole))
    other = 1 - F.col("flag")
    return out.withColumn("before", F.when(F.col("run") > 1, other)).withColumn("after", F.when(F.col("run") < F.col("last"), other)).drop("last")


def fill_gaps(series: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Zero runs of at most gap bins after a run of ones become ones, at the end too, at the start never."""
    fill = (F.col("flag") == 0) & (F.col("length") <= gap) & (F.col("before") == 1)
    return runs(series, keys).withColumn("flag", F.when(fill, 1).otherwise(F.col("flag"))).select(*keys, "bin", "flag")


def remove_small(series: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs of ones of under `least` bins become zeros."""
    short = (F.col("flag") == 1) & (F.col("length") < least)
    return runs(series, keys).withColumn("flag", F.when(short, 0).otherwise(F.col("flag"))).select(*keys, "bin", "flag")


def fill_exact(series: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Zero runs of exactly gap bins between ones become ones, and so do the first and last gap bins if all zero."""
    out = runs(series, keys)
    up, down = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys).orderBy(F.desc("bin"))
    out = out.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down))
    inner = (F.col("flag") == 0) & (F.col("length") == gap) & (F.col("before") == 1) & (F.col("after") == 1)
    edge = lambda c, side: (F.col("flag") == 0) & (F.col(c) <= gap) & F.col(side).isNull() & (F.col("length") >= gap)
    fill = inner | edge("i", "before") | edge("j", "after")
    return out.withColumn("flag", F.when(fill, 1).otherwise(F.col("flag"))).select(*keys, "bin", "flag")


def rescale(series: DataFrame, keys: list[str], spans: DataFrame, old: int, new: int) -> DataFrame:
    """A 0/1 series of bins of old size as one of new size: to intervals, and to bins again."""
    ones = series.where("flag = 1").select(*keys, F.col("bin").alias("start"))
    return dense(to_bins(merge_bins(ones, keys, old), new), spans, keys, new)


def n_runs(sequences: DataFrame, base: str = "N", least: int = 50, tile: int = 1 << 16) -> DataFrame:
    """gid, chr, start, end of runs of at least `least` of a base: runs in tiles, merged where tiles meet."""
    tiles = kmers.tiles(sequences, 0, tile)
    part = F.split(F.regexp_replace("tile", f"({base}+)", ",$1,"), ",")
    rows = tiles.select("gid", "chr", "at", F.posexplode(part).alias("i", "text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("gid", "chr", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.col("at") + F.coalesce(before, F.lit(0))).where(F.col("text").startswith(base))
    rows = rows.select("gid", "chr", "start", (F.col("start") + F.length("text")).alias("end"))
    order = Window.partitionBy("gid", "chr").orderBy("start")
    new = F.coalesce((F.col("start") != F.lag("end").over(order)).cast("int"), F.lit(1))
    joined = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("gid", "chr", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    return out.where(F.col("end") - F.col("start") >= least)


def merge_over_gaps(intervals: DataFrame, gaps: DataFrame, keys: list[str], bin_size: int, exclusive_end: bool = True, bins: int = 2) -> DataFrame:
    """Intervals whose distance is `bins` bins with a gap row (*keys, g_start, g_end) inside become one.

    Chains of such intervals are one interval. exclusive_end=False measures from the inclusive end. Intervals and gaps
    are sorted together by place; no interval meets all gaps of its key.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    none = F.lit(None).cast("long")
    places = intervals.select(*keys, F.col("start").alias("at"), F.lit(1).alias("kind"), "start", "end", none.alias("g_start"))
    places = places.unionByName(gaps.select(*keys, F.col("g_end").alias("at"), F.lit(0).alias("kind"), none.alias("start"), none.alias("end"), "g_start"))
    # of the gaps that end before an interval starts, the one that starts last lies after the interval before or none does
    last = F.max("g_start").over(Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = places.withColumn("last_gap", last).where("kind = 1").withColumn("prev", F.lag("end").over(order))
    far = F.col("start") - F.col("prev") - (1 if exclusive_end else 0)
    new = F.when(F.coalesce((far == bins * bin_size) & (F.col("last_gap") >= F.col("prev")), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def alignment_blocks(paf: DataFrame) -> DataFrame:
    """query, target, strand, qs, qe, ts, te of the match runs (M, = and X) of each alignment's CIGAR, and its number aln.

    Query places count along the query; on the minus strand they fall as target places rise. An alignment that is listed
    more than once counts once.
    """
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHX=])"), 1)
    rows = paf.distinct().withColumn("aln", F.xxhash64(*paf.columns)).select("aln", "query", "target", "strand", "q_start", "q_end", "t_start", F.posexplode(ops).alias("i", "op"))
    rows = rows.withColumn("n", F.expr("cast(substr(op, 1, length(op) - 1) as bigint)")).withColumn("kind", F.expr("right(op, 1)"))
    before = Window.partitionBy("aln").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    walk = lambda kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(kinds), F.col("n")).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("dq", walk(["M", "=", "X", "I", "S"])).withColumn("dt", walk(["M", "=", "X", "D", "N"])).where(F.col("kind").isin("M", "=", "X"))
    plus = F.col("strand") == "+"
    q = F.when(plus, F.col("q_start") + F.col("dq")).otherwise(F.col("q_end") - F.col("dq") - F.col("n"))
    return rows.select("aln", "query", "target", "strand", q.alias("qs"), (q + F.col("n")).alias("qe"), (F.col("t_start") + F.col("dt")).alias("ts"), (F.col("t_start") + F.col("dt") + F.col("n")).alias("te"))


def _hits(intervals: DataFrame, blocks: DataFrame, cell: int) -> DataFrame:
    """intervals by the blocks that they overlap, with low and high, the place of the overlap in the target.

    Both are dealt to cells of the query, and meet once, in the first cell that they share.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))).alias("cell")
    left = intervals.where("end > start").select("*", cells(F.col("start"), F.col("end")))
    right = blocks.select("*", cells(F.col("qs"), F.col("qe")))
    met = left.join(right, ["query", "cell"]).where((F.col("start") < F.col("qe")) & (F.col("end") > F.col("qs")))
    a, b = F.greatest("start", "qs"), F.least("end", "qe")
    met = met.where(F.floor(a / cell) == F.col("cell"))
    plus = F.col("strand") == "+"
    low = F.when(plus, F.col("ts") + a - F.col("qs")).otherwise(F.col("te") - (b - F.col("qs")))
    return met.withColumn("low", low).withColumn("high", low + b - a)


def liftover(intervals: DataFrame, blocks: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """intervals (query, start, end, ..) through alignment blocks: target, new_start, new_end, the hull of what is hit."""
    met = _hits(intervals, blocks, cell)
    return met.groupBy(*intervals.columns, "target").agg(F.min("low").alias("new_start"), F.max("high").alias("new_end"))


def _chained(t: pa.Table, max_gap: int) -> pa.Table:
    """aln, chain, score of alignments of one query and target on one strand, by dynamic programming over their order in the query."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("qs", "qe", "ts", "te", "n", "aln"))))
    minus = t.column("strand")[0].as_py() == "-"
    score, back, first = [], [], 0
    for i, (qs, _, ts, te, n, _) in enumerate(rows):
        best, at = 0, -1
        while rows[first][0] < qs - t.column("span")[0].as_py():  # none from there on back ends within max_gap
            first += 1
        for j in range(first, i):
            q_gap = qs - rows[j][1]
            t_gap = rows[j][2] - te if minus else ts - rows[j][3]
            if 0 <= q_gap <= max_gap and 0 <= t_gap <= max_gap and score[j] - abs(q_gap - t_gap) > best:
                best, at = score[j] - abs(q_gap - t_gap), j
        score.append(n + best)
        back.append(at)
    chain: dict[int, tuple[int, int]] = {}
    for i in sorted(range(len(rows)), key=lambda i: (-score[i], i)):
        path, at = [], i
        while at >= 0 and at not in chain:
            path.append(at)
            at = back[at]
        whole = score[i] - (score[at] if at >= 0 else 0)  # an alignment is in one chain; a path that meets a better one ends there
        chain |= {k: (rows[path[-1]][5], whole) for k in path}
    cols = [[r[5] for r in rows], [chain[i][0] for i in range(len(rows))], [chain[i][1] for i in range(len(rows))]]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["aln", "chain", "score"])


def chains(blocks: DataFrame, max_gap: int = 10_000) -> DataFrame:
    """aln, chain, score: alignments (see alignment_blocks()) in chains, each named by its first alignment.

    Two alignments of a query and a target follow each other if they have one strand and one order in both, and at most max_gap
    bases between them in each. A chain's score is its matching bases less the differences of its gaps; the best chain is
    taken first, and each alignment is in one. Alignments are one row each here, and only those without a gap of max_gap in the
    query between them meet in a task.
    """
    rows = blocks.groupBy("aln", "query", "target", "strand").agg(F.min("qs").alias("qs"), F.max("qe").alias("qe"), F.min("ts").alias("ts"), F.max("te").alias("te"), F.sum(F.col("qe") - F.col("qs")).alias("n"))
    order = Window.partitionBy("query", "target", "strand").orderBy("qs", "aln")
    so_far = F.max("qe").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("qs") - so_far <= max_gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(order)).drop("new")
    island = ["query", "target", "strand", "island"]
    rows = rows.withColumn("span", F.max(F.col("qe") - F.col("qs")).over(Window.partitionBy(*island)) + max_gap)
    return rows.groupBy(*island).applyInArrow(lambda t: _chained(t, max_gap), "aln long, chain long, score long")


def chained_liftover(intervals: DataFrame, blocks: DataFrame, max_gap: int = 10_000, cell: int = 1 << 16) -> DataFrame:
    """intervals (query, start, end, ..) through one chain of alignments each: target, chain, covered, new_start, new_end.

    Of the chains that an interval hits the one that covers most of its bases is taken, of equal ones that of higher score, and
    then the one that begins first in the target. So the result is one locus, where liftover() gives the hull of all that is hit.
    """
    named = chains(blocks, max_gap)
    hit = _hits(intervals, blocks.join(named, "aln"), cell)
    keys = [*intervals.columns, "target", "chain"]
    found = hit.groupBy(*keys).agg(F.min("low").alias("new_start"), F.max("high").alias("new_end"), F.sum(F.col("high") - F.col("low")).alias("covered"), F.max("score").alias("score"))
    best = F.min_by(F.struct("target", "chain", "covered", "new_start", "new_end"), F.struct((-F.col("covered")).alias("c"), (-F.col("score")).alias("s"), "target", "new_start", "chain"))
    return found.groupBy(*intervals.columns).agg(best.alias("b")).select(*intervals.columns, "b.*")


def ordered(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """intervals plus place: their order by start, then end, within the keys."""
    rest = [c for c in intervals.columns if c not in (*keys, start, end)]
    return intervals.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(start, end, *rest)))


def longest_prefix(names: DataFrame, accessions: DataFrame) -> DataFrame:
    """stem, accession: the longest accession that is the stem or begins it before an underscore.

    Stems are cut at each underscore, so that the join is on equal keys.
    """
    parts = F.split("stem", "_")
    heads = names.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))).alias("accession"))
    met = heads.join(accessions.select("accession").distinct(), "accession")
    return names.join(met.groupBy("stem").agg(F.max_by("accession", F.length("accession")).alias("accession")), "stem", "left")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.when(condition, 1).otherwise(0)
