"""FASTA as tiles: byte ranges of files become pieces of sequences, and no row holds a whole record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgram.tables import keep

#: Letters outside ASCII that lower() turns into ones of a to z: the dotted I and the sign of kelvin.
_LOWERED = (("\u0130".encode(), b"i"), ("\u212a".encode(), b"k"))


def mapped(text: Column | str, letters: str, bases: str) -> Column:
    """translate(regexp_replace(lower(text), '[^a-z]', ''), letters, bases), for letters a to z, in one look at each byte."""
    table = bytes.maketrans((letters + letters.upper()).encode(), (bases + bases).encode())
    other = bytes(set(range(256)) - set((letters + letters.upper()).encode()))

    @F.arrow_udf("string")
    def to_bases(x: pa.Array) -> pa.Array:
        whole = x.cast(pa.large_binary())
        out = []
        for v in whole:
            data = v.as_buffer().to_pybytes() if v.is_valid else None
            if data is not None:
                for a, b in _LOWERED:
                    data = data.replace(a, b)
                data = data.translate(table, other)
            out.append(data)
        return pa.array(out, pa.binary()).cast(pa.string())

    return to_bases(F.col(text) if isinstance(text, str) else text)


_PIECE = "path string, block long, record long, name string, at long, last boolean, tile string"


def _pieces(size: int, overlap: int):
    """A task over lines (path, block, value) in file order: tiles of each record within a block, counted from the block's start or
    the record's header. Record 0 is what stands before the block's first header."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, key, record, name, at = bytearray(), None, 0, None, 0

        def cut(last: bool, whole: bool) -> None:
            """Tiles off the held bases; at the end of a record or block all of them."""
            nonlocal held, at
            start = 0
            while len(held) - start > size + overlap:
                out.append((*key, record, name, at, False, bytes(held[start : start + size + overlap])))
                start, at = start + size, at + size
            held = held[start:]
            if whole:
                out.append((*key, record, name, at, last, bytes(held)))
                held = bytearray()

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            tile = pa.array(cols[6], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), tile], [x.split()[0] for x in _PIECE.split(", ")])

        for b in batches:
            paths, blocks = b.column("path").to_pylist(), b.column("block").to_numpy()
            lines = b.column("value").fill_null("").cast(pa.large_binary())
            _, off, data = lines.buffers()
            off = np.frombuffer(off, np.int64)[lines.offset : lines.offset + len(lines) + 1]
            text = memoryview(data) if data else memoryview(b"")
            heads = {i for i in np.flatnonzero(off[1:] > off[:-1]).tolist() if text[off[i]] == 62}
            edges = sorted({0, *heads, *(i + 1 for i in heads), *(np.flatnonzero((blocks[1:] != blocks[:-1]) | np.array([x != y for x, y in zip(paths, paths[1:])], bool)) + 1).tolist()})
            for x, y in zip(edges, [*edges[1:], b.num_rows]):
                if x >= b.num_rows:
                    break
                if key != (paths[x], int(blocks[x])):
                    if key is not None:
                        cut(True, True)
                    key, record, name, at = (paths[x], int(blocks[x])), 0, None, 0
                if x in heads:
                    cut(False, True)
                    words = bytes(text[off[x] + 1 : off[x + 1]]).decode().split(None, 1)
                    record, name, at = record + 1, words[0] if words else "", 0
                else:
                    held += bytes(text[off[x] : off[y]]).translate(None, b" \t\r\n")
                    cut(False, False)
                if len(out) >= 64:
                    yield ready()
        if key is not None:
            cut(True, True)
        if out:
            yield ready()

    return task


def fasta_tiles(spark: SparkSession, *paths: str, overlap: int = 20, size: int = 1 << 16) -> DataFrame:
    """path, chr, at, tile of FASTA files: `size` bases of a record from base `at` on, and `overlap` more from what follows.

    Files are read in the byte ranges that Spark deals them in, line by line; a gzipped file is one range. A task holds one tile
    and one batch of lines, whatever a record's length; a record on a single line is held as that line. A range begins in the
    middle of a record: its tiles are counted from its own start first, and one row for each range then tells which record is open
    there, at which base, and which bases follow its end. Records without any base have no tile. Bases are as in the file;
    what stands before a file's first header is left out.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = keep(lines.mapInArrow(_pieces(size, overlap), _PIECE))
    # what a tile has of its own, without what the next tile repeats: the last one of a record in a range all, others `size`
    order = Window.partitionBy("path", "block", "record").orderBy("at")
    pieces = pieces.withColumn("final", F.lead("at").over(order).isNull())
    ends = pieces.where("final").select("path", "block", "record", "name", "last", (F.col("at") + F.length("tile")).alias("size"))
    heads = pieces.where("record = 0 and at = 0").select("path", "block", F.substring("tile", 1, overlap).alias("head"))
    ranges = ends.groupBy("path", "block").agg(F.max_by("record", "record").alias("records"), F.max_by("name", "record").alias("open"), F.max_by("size", "record").alias("rest"), F.max_by("size", -F.col("record")).alias("lead"))
    ranges = ranges.join(heads, ["path", "block"], "left")
    in_file = Window.partitionBy("path").orderBy("block")
    before, after = in_file.rowsBetween(Window.unboundedPreceding, -1), in_file.rowsBetween(1, max(1, overlap))
    closed = F.col("records") > 0
    # bases of the open record up to each range: since the last range with a header, that range's rest and all of those after it
    group = F.sum(closed.cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("group", F.coalesce(group, F.lit(0))).withColumn("grown", F.when(closed, F.col("rest")).otherwise(F.col("lead")))
    ranges = ranges.withColumn("own_group", F.col("group") + closed.cast("int"))
    total = F.sum("grown").over(Window.partitionBy("path", "own_group").orderBy("block"))
    ranges = ranges.withColumn("total", total)
    following = F.collect_list(F.struct(F.coalesce("head", F.lit("")).alias("head"), closed.alias("closed"))).over(after)
    told = F.aggregate(following, F.struct(F.lit("").alias("text"), F.lit(False).alias("done")), lambda s, x: F.struct(F.when(s["done"], s["text"]).otherwise(F.concat(s["text"], x["head"])).alias("text"), (s["done"] | x["closed"]).alias("done")))
    ranges = ranges.select("path", "block", F.last("total").over(before).alias("from"), F.last(F.when(closed, F.col("open")), True).over(before).alias("carried"), F.substring(told["text"], 1, overlap).alias("next"))
    met = pieces.join(keep(ranges), ["path", "block"])
    first = F.col("record") == 0
    tile = F.when(F.col("final") & F.col("last"), F.concat("tile", F.coalesce("next", F.lit("")))).otherwise(F.col("tile"))
    at = F.when(first, F.coalesce("from", F.lit(0)) + F.col("at")).otherwise(F.col("at"))
    out = met.select("path", F.when(first, F.col("carried")).otherwise(F.col("name")).alias("chr"), at.alias("at"), F.length("tile").alias("own"), tile.alias("tile"))
    return out.where("chr is not null and own > 0").drop("own")
