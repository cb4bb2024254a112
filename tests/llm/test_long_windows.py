"""Windows of long items are rolled along the text; long words are walked along their bytes."""

import collections
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgram.llm import decontaminate, lattice

R = random.Random(31)


def word():
    return "".join(R.choice("abcdefghij") for _ in range(6))


@pytest.mark.parametrize(("m", "starts"), [(1, 1), (1, 5), (3, 7), (50, 40), (40_000, 9)])
def test_rolled_fingerprints(spark, m, starts):
    few = [R.getrandbits(64) - (1 << 63) for _ in range(30)]
    h = [few[R.randrange(R.randrange(1, 30))] for _ in range(m + starts - 1)]
    df = spark.createDataFrame([(h, m, starts)], "h array<long>, m int, starts int")
    got = df.select(decontaminate.rolled(F.col("h"), F.col("m"), F.col("starts")).alias("f")).first().f
    assert len(got) == starts
    for a, f in enumerate(got):
        own = h[a : a + m]
        assert f & (2**64 - 1) == sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in own) * 2 > m)


def brute(texts, items):
    """(doc, item): (similarity, first start) of the best window, 0.8 or more."""
    out = {}
    for d, t in texts:
        w = t.lower().split()
        for i, item in items:
            v = item.lower().split()
            s = min(5, len(v))
            grams = lambda x, s=s: collections.Counter(tuple(x[k : k + s]) for k in range(len(x) - s + 1))
            a, best = grams(v), (0, 0)
            for at in range(max(1, len(w) - len(v) + 1)):
                b = grams(w[at : at + len(v)])
                both = sum((a & b).values())
                best = max(best, (both / max(1, sum(a.values()) + sum(b.values()) - both), -at))
            if best[0] >= 0.8:
                out[d, i] = (best[0], -best[1])
    return out


def test_rolled_similarities_are_exact(spark):
    """Repeats of words, in the item and the text, and texts shorter than the item or ending inside a window."""
    loop = [word() for _ in range(7)]
    items = [(0, " ".join(loop * 12)), (1, " ".join(word() for _ in range(90))), (2, " ".join([loop[0]] * 30)), (3, "two words"), (4, " ".join(word() for _ in range(300)))]
    noise = lambda n: " ".join(word() for _ in range(n))
    cut = items[4][1].split()
    texts = [
        (0, noise(20) + " " + items[0][1] + " " + " ".join(loop * 3)), (1, items[1][1] + " " + noise(200) + " " + items[1][1]), (2, " ".join([loop[0]] * 200)), (3, noise(40) + " Two  WORDS"),
        (4, " ".join(cut[:280])), (5, noise(30) + " " + " ".join(cut[20:])), (6, " ".join(cut[30:]) + " " + noise(10)), (7, noise(100)), (1, noise(5) + " " + items[2][1]),
    ]
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = collections.defaultdict(lambda: (0, 0))
    for t in texts:
        for k, x in brute([t], items).items():
            want[k] = max(want[k], x, key=lambda x: (x[0], -x[1]))
    assert len(got) == len(want) > 5
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx({k: x[0] for k, x in want.items()})
    assert {(r.doc_id, r.item_id): r.start for r in got} == {k: x[1] for k, x in want.items()}


def test_a_long_item_in_a_long_text(spark):
    item = [word() for _ in range(20_000)]
    text = [word() for _ in range(9_000)] + item + [word() for _ in range(21_000)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:20_000]))], "doc_id long, text string")
    began = time.time()
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.start, r.n_words) for r in got] == [(1, 7, 1.0, 9_000, 20_000)]
    print("seconds", time.time() - began)


def toy_pieces():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"abc", b"ca", b"bca", b" abcab"]
    return lattice.Pieces(pieces, np.log(np.r_[np.full(256, 0.001), 0.2, 0.1, 0.05, 0.1, 0.02, 0.01]))


@pytest.mark.parametrize("along", [7, 64, 1 << 16])
def test_words_along_their_bytes_as_in_the_matrix(monkeypatch, along):
    """Of one length: few words are walked along their bytes, many are rows of a matrix; both give the same."""
    pieces, words = toy_pieces(), pa.array(["".join(R.choice("abcd") for _ in range(90)) for _ in range(20)])
    times = np.array([R.randrange(5) for _ in range(20)], float)
    monkeypatch.setattr(lattice, "ALONG", along)
    monkeypatch.setattr(lattice, "FEW", 0)
    want = lattice.log_probability(pieces, words), lattice.expected_counts(pieces, words, times)
    monkeypatch.setattr(lattice, "FEW", 21)
    got = lattice.log_probability(pieces, words), lattice.expected_counts(pieces, words, times)
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert pytest.approx(sum(times) * 91, rel=1e-9) == sum(len(p) * n for p, n in zip([b" "] * 256 + [b"ab", b" a", b"abc", b"ca", b"bca", b" abcab"], want[1]))


def test_a_word_of_a_megabyte():
    import public_tokenizers

    vocab, weight = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces, word = lattice.Pieces(vocab, weight), "".join(R.choice("abcdefghiklmnoprstuv") for _ in range(1 << 20))
    began = time.time()
    assert -2e7 < lattice.log_probability(pieces, pa.array([word]))[0] < -2e6
    assert lattice.expected_counts(pieces, pa.array([word]), np.ones(1)).sum() > 1e5
    assert time.time() - began < 60
