"""All columns of the sharding query against a plain version."""

import random
import struct
import zlib

import xxhash

from loomgram.llm import sharding

MASK = 2**64 - 1


def jump(doc_id, shards):
    """The shard of a doc_id, by the published loop over its XXH64."""
    key = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    last, at = 0, 0
    while at < shards:
        last = at
        key = (key * 2862933555777941757 + 1) & MASK
        at = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_every_column(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, r.choice([None, "", "a", "é漢\U0001f600", "x y" * r.randrange(2000), f"text {i}"]), f"src{i % 3}") for i in range(3000)]
    rows += [(17, "again", "src0")] * 2 + [(-5, "negative", None), (2**62, "far", None), (None, "no id", None)]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(folder)
    got = sharding.op2_sharding(spark, str(tmp_path)).collect()

    def plain(doc_id, text):
        raw = (text or "").encode()
        return doc_id, len(raw) + 1, zlib.crc32(raw), "key", jump(doc_id, 8), jump(doc_id, 9)

    order = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
    want = sorted((plain(i, t) for i, t, _ in rows), key=order)
    assert sorted(((g.doc_id, g["size"], g.text_crc32, g.law, g.shard, g.grown_shard) for g in got), key=order) == want
    for s in range(8):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 200
    assert all(g.grown_shard in (g.shard, 8) for g in got)
    moved = sum(g.grown_shard == 8 for g in got) / len(got)
    assert 0.08 < moved < 0.15  # about a ninth
