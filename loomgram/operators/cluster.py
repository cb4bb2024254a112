"""Embedding and clustering of bins, and trees of genomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgram.operators.distance import column_distance
from loomgram.operators.graph import connected_components
from loomgram.operators.summary import mask_counts
from loomgram.tables import keep


def features(sim: DataFrame) -> DataFrame:
    """gid, chr, start, features: a bin's similarities to all genomes in their order, nulls as 0. Rows may hold them as sims."""
    if "sims" in sim.columns:
        return sim.select("gid", "chr", "start", F.transform("sims", lambda x: F.coalesce(x, F.lit(0.0))).alias("features"))
    rows = sim.groupBy("gid", "chr", "start").agg(F.array_sort(F.collect_list(F.struct("other", F.coalesce("sim", F.lit(0.0)).alias("sim")))).alias("s"))
    return rows.select("gid", "chr", "start", F.col("s.sim").alias("features"))


def embed(rows: DataFrame, keys: list[str], dims: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with pc1.. of their centred features, explained shares); the largest loading of each axis is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # read by each of the passes below
    vectors = keep(rows.select(*keys, "features")).select(*keys, array_to_vector("features").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="v").fit(vectors).transform(vectors)
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[np.argmax(np.abs(axes[:, i])), i] >= 0 else -1.0 for i in range(dims)]
    out = model.transform(centred).withColumn("a", vector_to_array("p"))
    return out.select(*keys, *(F.col("a")[i].__mul__(signs[i]).alias(f"pc{i + 1}") for i in range(dims))), model.explainedVariance.toArray().tolist()


def density_clusters(points: DataFrame, eps: float, x: str = "x", y: str = "y") -> DataFrame:
    """points (id, x, y) plus cluster: connected components of points at most eps apart, numbered by smallest id.

    Points are dealt to square cells of which no two points are more than eps apart: a cell is one node, however many
    points it has. Cells meet those around them; each pair of cells with a pair of near points is one edge, and points
    that are farther than eps from the other cell take no part.
    """
    side = eps / 2**0.5 * (1 - 1e-9)  # a cell's diagonal stays under eps
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    spots = keep(points.groupBy(x, y).agg(F.min("id").alias("low")).withColumn("cx", cell(x)).withColumn("cy", cell(y)))
    cells = keep(spots.groupBy("cx", "cy").agg(F.min("low").alias("node"), *(f(c).alias(f"{n}_{k}") for c, k in ((x, "x"), (y, "y")) for f, n in ((F.min, "low"), (F.max, "high")))))
    ways = [(a, b) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0) and abs(a) + abs(b) < 4]
    ways = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ways))).alias("w")
    own = lambda side_: [F.col(c).alias(f"{c}_{side_}") for c in ("node", "cx", "cy", "low_x", "high_x", "low_y", "high_y")]
    left = cells.select(*own("a"), ways).withColumn("cx_b", F.col("cx_a") + F.col("w.dx")).withColumn("cy_b", F.col("cy_a") + F.col("w.dy")).drop("w")
    pairs = keep(left.join(cells.select(*own("b")), ["cx_b", "cy_b"]))

    def near(me: str, other: str) -> DataFrame:
        """Points of one cell of each pair that are within eps of the other cell's box."""
        rows = pairs.withColumnsRenamed({f"cx_{me}": "cx", f"cy_{me}": "cy"}).join(spots.select("cx", "cy", F.col(x).alias("px"), F.col(y).alias("py")), ["cx", "cy"])
        gap = lambda p, k: F.greatest(F.lit(0.0), F.col(f"low_{k}_{other}") - F.col(p), F.col(p) - F.col(f"high_{k}_{other}"))
        far = gap("px", "x") * gap("px", "x") + gap("py", "y") * gap("py", "y")
        mid = lambda p, k: F.col(p) - (F.col(f"low_{k}_{other}") + F.col(f"high_{k}_{other}")) / 2
        off = (mid("px", "x") * mid("px", "x") + mid("py", "y") * mid("py", "y")).alias(f"off_{me}")
        return rows.where(far <= eps * eps * (1 + 1e-9)).select("node_a", "node_b", F.col("px").alias(f"x_{me}"), F.col("py").alias(f"y_{me}"), off)

    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    on, close = ["node_a", "node_b"], dx * dx + dy * dy <= eps * eps
    one, two = keep(near("a", "b")), keep(near("b", "a"))
    # the point nearest to the other cell's middle settles most pairs; only the rest compare all their points
    best = one.groupBy(*on).agg(F.min_by(F.struct("x_a", "y_a"), "off_a").alias("p")).select(*on, "p.x_a", "p.y_a")
    linked = keep(two.join(best, on).where(close).select(*on).distinct())
    met = one.join(linked, on, "left_anti").join(two, on).where(close).select(*on).distinct()
    roots = connected_components(linked.union(met), "node_a", "node_b")
    named = cells.select("cx", "cy", "node").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    number = numbered(named.select("root").distinct(), "root", "cluster")
    spots = spots.join(named.select("cx", "cy", "root"), ["cx", "cy"]).join(number, "root")
    return points.join(spots.select(x, y, "cluster"), [x, y])


def core_clusters(points: DataFrame, eps: float, samples: int, x: str = "x", y: str = "y") -> DataFrame:
    """points (id, x, y) plus cluster and core: density clusters whose cores have at least `samples` points, themselves included,
    at most eps away.

    Clusters are the density_clusters() of the core points, numbered by their smallest core's id. A point that is no core goes
    to the first cluster with a core at most eps away; one without such a core, or without coordinates, is noise: -1.

    A cell that holds `samples` points has only cores, as its diagonal stays under eps. So only the points of emptier cells are
    counted and placed: under `samples` of them a cell, each met by the points of the 25 cells around it. The work on a point is
    thus bounded, however dense the data.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    spots = keep(placed.groupBy(x, y).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("cx", cell(x)).withColumn("cy", cell(y)))
    full = spots.groupBy("cx", "cy").agg(F.sum("n").alias("total"))
    spots = keep(spots.join(full, ["cx", "cy"]))
    ways = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3)))).alias("w")
    thin = spots.where(F.col("total") < samples)

    def around(few: DataFrame, others: DataFrame) -> DataFrame:
        """Each of few (px, py) with those of others at most eps away."""
        few = few.select(F.col(x).alias("px"), F.col(y).alias("py"), "cx", "cy", ways)
        few = few.select("px", "py", (F.col("cx") + F.col("w.dx")).alias("cx"), (F.col("cy") + F.col("w.dy")).alias("cy"))
        dx, dy = F.col("px") - F.col(x), F.col("py") - F.col(y)
        return few.join(others, ["cx", "cy"]).where(dx * dx + dy * dy <= eps * eps)

    met = around(thin, spots).groupBy("px", "py").agg((F.sum("n") >= samples).alias("core")).withColumnsRenamed({"px": x, "py": y})
    thin = keep(thin.join(met, [x, y]))
    cores = spots.where(F.col("total") >= samples).select("id", x, y).union(thin.where("core").select("id", x, y))
    cores = keep(density_clusters(cores, eps, x, y).select(x, y, "cluster"))
    edges = around(thin.where("not core"), cores.withColumn("cx", cell(x)).withColumn("cy", cell(y)))
    edges = edges.groupBy("px", "py").agg(F.min("cluster").alias("cluster")).withColumnsRenamed({"px": x, "py": y})
    found = cores.withColumn("core", F.lit(True)).unionByName(edges.withColumn("core", F.lit(False)))
    return points.join(found, [x, y], "left").withColumns({"cluster": F.coalesce("cluster", F.lit(-1)), "core": F.coalesce("core", F.lit(False))})


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows plus name: their places 0, 1, .. in the order of by, which has no equal values.

    Rows are sorted in ranges, and each range is numbered by itself from where the ones before it end; only the
    ranges' sizes come together.
    """
    parts = keep(rows.repartitionByRange(by).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("range").agg(F.count(F.lit(1)).alias("size")).withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return parts.withColumn("own", own).join(first.select("range", "first"), "range").withColumn(name, F.col("first") + F.col("own")).drop("range", "own", "first")


def tree(distances: DataFrame, keys: list[str], method: str = "ward") -> DataFrame:
    """keys, step, left, right, height, size, members: merges of an agglomerative tree for each key (a, b, dist of all pairs).

    Lance-Williams updates (ward, average or complete) in one task for each key: a key holds a number of genomes, not
    of positions. Leaves are 0..n-1 in the order of their ids, merges n and on; ties go to the smaller pair. members are
    the ids of the leaves under a merge.
    """
    kinds = {f.name: f.dataType for f in distances.schema.fields}
    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", step int, left int, right int, height double, size int, members array<int>"

    def grow(t: pa.Table) -> pa.Table:
        a, b, d = (t.column(c).to_numpy() for c in ("a", "b", "dist"))
        ids = np.unique(np.concatenate([a, b]))
        n = len(ids)
        m = np.full((2 * n, 2 * n), np.inf)
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        m[i, j] = m[j, i] = d
        np.fill_diagonal(m, np.inf)
        size, live, out = np.r_[np.ones(n), np.zeros(n)], list(range(n)), []
        under = [[int(x)] for x in ids]
        for step in range(n - 1):
            sub = m[np.ix_(live, live)]
            p, q = divmod(int(np.argmin(sub)), len(live))
            x, y = sorted((live[p], live[q]))
            h, new = m[x, y], n + step
            for z in live:
                if z not in (x, y):
                    u, v = m[x, z], m[y, z]
                    if method == "ward":
                        s = size[x] + size[y] + size[z]
                        w = np.sqrt(max(0.0, ((size[x] + size[z]) * u * u + (size[y] + size[z]) * v * v - size[z] * h * h) / s))
                    elif method == "average":
                        w = (size[x] * u + size[y] * v) / (size[x] + size[y])
                    else:
                        w = max(u, v)
                    m[new, z] = m[z, new] = w
            size[new] = size[x] + size[y]
            live = [z for z in live if z not in (x, y)] + [new]
            under.append(sorted(under[x] + under[y]))
            out.append((step, x, y, float(h), int(size[new]), under[new]))
        cols = [pa.array([t.column(k)[0].as_py()] * len(out), t.schema.field(k).type) for k in keys]
        kind = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int32()))
        cols += [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kind)]
        return pa.Table.from_arrays(cols, [*keys, "step", "left", "right", "height", "size", "members"])

    return distances.groupBy(*keys).applyInArrow(grow, schema)


def region_counts(bits: DataFrame, region: tuple[int, int], chr_: object = None) -> DataFrame:
    """gid, mask, n: positions with each mask from region[0] up to region[1] of one chromosome (None: of each). The range
    reaches the scan."""
    near = bits.where((F.col("pos") >= region[0]) & (F.col("pos") < region[1]))
    return mask_counts(near if chr_ is None else near.where(F.col("chr") == F.lit(chr_)), "gid")


def region_trees(bits: DataFrame, region: tuple[int, int], n: int, chr_: object = None, method: str = "ward") -> DataFrame:
    """gid, step, left, right, height, size: each genome's tree over region_counts(), as tree() grows it from the distances
    of the bitmap's columns there. A genome without a position in the region has no tree."""
    return tree(column_distance(region_counts(bits, region, chr_), ["gid"], n), ["gid"], method).drop("members")


def joined_tree(distances: DataFrame, keys: list[str], method: str = "ward") -> DataFrame:
    """keys, step, left, right, height, size: the merges of tree(), for any number of leaves (a, b, dist of all pairs).

    Each round merges all pairs of clusters that are each other's nearest at once, which for these linkages (ward, average,
    complete) gives the tree that merging the nearest pair of all gives; distances to what was merged are sums or maxima of
    those to its parts (Lance-Williams), taken in a join and two aggregations. No task holds a matrix. Leaves are 0..n-1 in
    the order of their ids; merges are numbered by height. With equal distances the order among equals may differ from tree()'s.
    """
    ids = distances.select(*keys, "a").union(distances.select(*keys, F.col("b"))).distinct()
    ids = keep(ids.withColumn("leaf", F.row_number().over(Window.partitionBy(*keys).orderBy("a")) - 1))
    leaf = lambda c: ids.select(*keys, F.col("a").alias(c), F.col("leaf").alias(f"leaf_{c}"))
    e = distances.join(leaf("a"), [*keys, "a"]).join(leaf("b"), [*keys, "b"]).select(*keys, F.col("leaf_a").alias("a"), F.col("leaf_b").alias("b"), F.col("dist").alias("d"))
    one = F.lit(1).cast("long")
    e = keep(e.select(*keys, "a", "b", "d", one.alias("sa"), one.alias("sb")).union(e.select(*keys, "b", "a", "d", one, one)))

    def halved(edges: DataFrame, pairs: DataFrame, side: str, other: str) -> DataFrame:
        """Edges whose end on one side is part of a merged pair become one, of the pair's smaller name."""
        into = pairs.select(*keys, F.col("part").alias(side), "name", "h")
        d, own, far = F.col("d"), F.col(f"s{side}"), F.col(f"s{other}")
        rows = edges.join(into, [*keys, side], "left").withColumn(side, F.coalesce("name", side))
        size = F.sum(own)
        if method == "ward":
            square = (F.sum((own + far) * d * d) - F.first(far) * F.coalesce(F.first("h"), F.lit(0.0)) * F.coalesce(F.first("h"), F.lit(0.0))) / (size + F.first(far))
            new = F.when(F.count(F.lit(1)) == 1, F.first(d)).otherwise(F.sqrt(F.greatest(F.lit(0.0), square)))
        elif method == "average":
            new = F.when(F.count(F.lit(1)) == 1, F.first(d)).otherwise(F.sum(own * d) / size)
        else:
            new = F.max(d)
        out = rows.groupBy(*keys, side, other).agg(new.alias("d"), size.alias(f"s{side}"), F.first(far).alias(f"s{other}"))
        return out.select(*keys, "a", "b", "d", "sa", "sb")

    merges = None
    while not e.isEmpty():
        near = e.groupBy(*keys, "a").agg(F.min_by(F.struct("b", "d", "sa", "sb"), F.struct("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("n")).select(*keys, "a", "n.*")
        near = keep(near)
        back = near.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"))
        pairs = keep(near.where("a < b").join(back, [*keys, "a", "b"]).select(*keys, "a", "b", F.col("d").alias("h"), (F.col("sa") + F.col("sb")).alias("size")))
        merges = pairs if merges is None else merges.union(pairs)
        parts = pairs.select(*keys, F.explode(F.array("a", "b")).alias("part"), F.col("a").alias("name"), "h")
        inner = e.join(pairs.select(*keys, "a", "b"), [*keys, "a", "b"], "left_anti").join(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")), [*keys, "a", "b"], "left_anti")
        e = keep(halved(halved(inner, parts, "a", "b"), parts, "b", "a"))
    if merges is None:
        merges = e.select(*keys, "a", "b", F.col("d").alias("h"), F.col("sa").alias("size"))
    n = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("leaves"))
    steps = keep(merges.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "size", "a", "b")) - 1))
    # a cluster has its smallest leaf's name: before a merge its left part is that name's merge before, its right part that of its own name
    before = F.lag("step").over(Window.partitionBy(*keys, "a").orderBy("step"))
    last = steps.groupBy(*keys, F.col("a").alias("b")).agg(F.max("step").alias("right_step"))
    met = steps.withColumn("left_step", before).join(last, [*keys, "b"], "left").join(n, keys)
    number = lambda step, leaf_: F.coalesce(F.col("leaves") + F.col(step), F.col(leaf_)).cast("int")
    x, y = number("left_step", "a"), number("right_step", "b")
    return met.select(*keys, F.col("step").cast("int").alias("step"), F.least(x, y).alias("left"), F.greatest(x, y).alias("right"), F.col("h").alias("height"), F.col("size").cast("int").alias("size"))


def dominant(trees: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, other, value: the leaf of largest value under each merge; values has keys, other, value. Ties go to
    the smaller leaf; a merge whose leaves have no value has nulls."""
    rows = trees.select(*keys, "step", F.explode("members").alias("other")).join(values, [*keys, "other"], "left")
    best = F.max_by(F.struct("other", "value"), F.struct("value", -F.col("other")))
    best = rows.where("value is not null").groupBy(*keys, "step").agg(best.alias("b")).select(*keys, "step", "b.other", "b.value")
    return trees.select(*keys, "step").join(best, [*keys, "step"], "left")


def cluster_sizes(clusters: DataFrame, bin_size: int) -> DataFrame:
    return clusters.groupBy("gid", "cluster").agg((F.count(F.lit(1)) * bin_size).alias("bases"))


def lookup(track: DataFrame, chr_: object, start: int, end: int) -> DataFrame:
    """start, end, cluster of the bins of a track that overlap [start, end) of a chromosome; chr_ None: of any."""
    near = (F.col("start") < end) & (F.col("end") >= start)
    return track.where(near if chr_ is None else near & (F.col("chr") == F.lit(chr_)))


def cluster_track(clusters: DataFrame, bin_size: int) -> DataFrame:
    """chr, start, inclusive end, cluster of each bin."""
    return clusters.select("gid", "chr", "start", (F.col("start") + bin_size - 1).alias("end"), "cluster")
