"""Sharding by jump consistent hashing, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgram.llm.text import aside, unused

#: Multiplier of the generator that jump consistent hashing steps with (Lamping and Veach, 2014). Fixed value.
MULTIPLIER = 2862933555777941757
#: Rows that get their slots in one group.
GROUP_ROWS = 1000
_LOW32, _LOW16 = (1 << 32) - 1, (1 << 16) - 1


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2**32, for x and c under 2**32, without overflow of a bigint."""
    return x * F.lit(c & _LOW16) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(_LOW16)), 16)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64, in halves of 32 bits."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    upper = lo * F.lit(c_lo >> 16)
    low = lo * F.lit(c_lo & _LOW16) + F.shiftleft(upper.bitwiseAND(F.lit(_LOW16)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    return (carry + _times(hi, c_lo) + _times(lo, c_hi)).bitwiseAND(F.lit(_LOW32)), low.bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit key: with one shard more, a key stays or goes to the new shard.

    A jump goes at least one shard on, so that as many steps as shards always suffice; later ones change nothing.
    """
    key = key.cast("long")
    start = F.struct(
        F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW32)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        far = F.floor((s["j"] + F.lit(1)).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))
        moved = F.struct(s["j"].alias("b"), far.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs plus shard, grown_shard (with one shard more) and slot (gapless from 0 in each shard).

    The shard depends on the key and on the number of shards alone. Slots: rows are dealt to groups of about
    GROUP_ROWS by a hash of the whole row, so that the rows of a hot key are spread, the groups of a shard get
    consecutive ranges, and each group numbers its own rows by key; no task orders a whole shard. A null key is a key
    like any other; rows with equal keys get the same shard and different slots, in an order of their own choosing.
    Columns of docs that have a new column's name come back as aside() names them.
    """
    docs, moved = aside(docs, "shard", "grown_shard", "slot")
    key = moved.get(key, key)
    own_group, n_, offset_ = unused(docs, "own_group"), unused(docs, "group_rows"), unused(docs, "group_offset")
    h = F.xxhash64(F.col(key))
    hashed = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    groups = max(1, docs.count() // (GROUP_ROWS * shards))
    spot = docs.withColumn("shard", jump_hash(h, shards)).withColumn(own_group, F.pmod(F.xxhash64(F.lit(7), *hashed), F.lit(groups)))
    count = spot.select("shard", own_group).groupBy("shard", own_group).agg(F.count(F.lit(1)).alias(n_))
    before = Window.partitionBy("shard").orderBy(own_group).rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("shard", own_group, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(offset_))
    own = Window.partitionBy("shard", own_group).orderBy(key)
    out = spot.withColumn("grown_shard", jump_hash(h, shards + 1)).join(offset, ["shard", own_group])
    return out.withColumn("slot", F.col(offset_) + F.row_number().over(own) - 1).drop(own_group, offset_)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(rows, 8).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
