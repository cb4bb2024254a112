"""Spelling variants: words one edit apart, found by products of blocks of letter counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgram.tables import keep, table

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased. Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Words of a block, and of those that it meets in one task; larger ones are split.
HOME, GUESTS = 8192, 32768
#: Rows of a product: 2048 x 4096 distances are 32 MB.
ROWS, COLUMNS = 2048, 4096
_CODE = np.zeros(256, np.int64)
_CODE[list(map(ord, LETTERS))] = np.arange(len(LETTERS))


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, typo: int = 31) -> DataFrame:
    """word: each maximal run of letters in the texts, A-Z lower-cased, that has `least` code points or more.

    Where `typo` divides the crc32 of key:run, the run has lost its code point number crc32 % length; typo = 0 leaves runs as
    they are. Null texts have no runs; a null key counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run")
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), run)
    if not typo:
        return rows.select(F.col("run").alias("word"))
    h, size = F.crc32(F.concat("key", F.lit(":"), "run")), F.char_length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    return rows.select(F.when(h % typo == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def classes(words: DataFrame) -> list[str]:
    """The letters, dealt to classes of about equal use in the words: two classes up to 10,000 words or so, and one more with
    every tenfold number, so that blocks stay small."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()  # at most as many rows as letters
    n = words.count()
    out, load = [""] * max(2, min(12, len(str(n)) - 2)), [0] * max(2, min(12, len(str(n)) - 2))
    times = {r["c"]: r["count"] for r in used}
    for c in sorted(LETTERS, key=lambda c: (-times.get(c, 0), c)):
        i = load.index(min(load))
        out[i], load[i] = out[i] + c, load[i] + times.get(c, 0) + 1
    return out


def _homes(count: list[Column]) -> Column:
    """Blocks that a word meets, given its number of letters of each class: its own, those of words with a letter less, and half
    of those with one letter of another class."""
    name = lambda c: F.concat_ws(",", *(x.cast("string") for x in c))
    less = lambda i, j=None: name([x - int(k == i) + int(k == j) for k, x in enumerate(count)])
    own = [F.struct(name(count).alias("home"), F.lit(True).alias("own"))]
    pairs = [(i, None) for i in range(len(count))] + [(i, j) for i in range(len(count)) for j in range(i + 1, len(count))]
    rest = [F.when(count[i] > 0, F.struct(less(i, j).alias("home"), F.lit(False).alias("own"))) for i, j in pairs]
    return F.filter(F.array(*own, *rest), lambda x: x.isNotNull())


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, letter counts) of words of one length."""
    chars = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    spot = _CODE[chars] + np.arange(len(words))[:, None] * len(LETTERS)
    return chars, np.bincount(spot.ravel(), minlength=len(words) * len(LETTERS)).reshape(len(words), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, as long or one longer, differ by one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    other = a != b[:, :-1]
    first = np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])
    later = np.arange(a.shape[1]) >= first[:, None]
    return ~((a != b[:, 1:]) & later).any(axis=1)


def near_pairs(home: list[str], guests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): home[i] and guests[j] are one edit apart. All of home have one length, all guests the same or one letter more.

    Blocks of letter counts are multiplied: |a|^2 + |b|^2 - 2ab is 1 after an insertion and 2 after a replacement, so that
    pairs over 2 are no variants; the rest are compared letter by letter.
    """
    if not home or not guests:
        return (np.zeros(0, np.int64),) * 2
    (ca, a), (cb, b) = _matrix(home), _matrix(guests)
    kind = np.float32 if max(ca.shape[1], cb.shape[1]) < 2000 else np.float64  # squares that a float holds exactly
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    one, two = np.ones((len(a), 1)), np.ones((len(b), 1))
    left, right = np.hstack([a, sa[:, None], one]).astype(kind), np.hstack([-2 * b, two, sb[:, None]]).astype(kind)
    found = []
    step = max(1, (1 << 22) // max(1, cb.shape[1]))
    for i in range(0, len(a), ROWS):
        for j in range(0, len(b), COLUMNS):
            near = np.flatnonzero((left[i : i + ROWS] @ right[j : j + COLUMNS].T <= 2).ravel())
            width = len(right[j : j + COLUMNS])
            for at in range(0, len(near), step):
                x, y = i + near[at : at + step] // width, j + near[at : at + step] % width
                ok = _one_edit(ca[x], cb[y])
                found.append((x[ok], y[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _meet(t: pa.Table) -> pa.Table:
    """word, n_near, best_n, best of each word of a group that has near words in it."""
    words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
    is_home, is_guest, own = (t.column(c).to_numpy() for c in ("is_home", "is_guest", "own"))
    home, length = np.flatnonzero(is_home), np.array([len(w) for w in words])
    found = []
    for size in np.unique(length[is_guest]):
        guests = np.flatnonzero(is_guest & (length == size))
        i, j = near_pairs([words[k] for k in home], [words[k] for k in guests])
        i, j = home[i], guests[j]
        # two words of one block meet both ways; the pair counts where the first is the home
        first = np.array([not own[y] or words[x] < words[y] for x, y in zip(i, j)], bool)
        found.append((i[first], j[first]))
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    i, j = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    order = np.lexsort((rank[j], i))
    i, j = i[order], j[order]
    at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    cols = [pa.array([words[k] for k in i[at]], pa.string()), pa.array(np.diff(np.r_[at, len(i)])), pa.array(n[j[at]]), pa.array([words[k] for k in j[at]], pa.string())]
    return pa.Table.from_arrays(cols, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of each of the distinct words (word, n) that has words one edit apart; best is the one of
    largest n, of equal ones the first in code-point order.

    A word's block is its number of letters of each class (see classes()); the sum of these is its length. One edit changes one number by 1, or
    two, so that a block meets its neighbours alone: it is joined by the words of a letter more and by half of those of its own
    length, and each pair meets once. The products are taken in tasks of HOME by GUESTS words at most: larger blocks are split by
    hashes, and all parts of a block meet all parts of its guests. A task hands on one row for each word, however many pairs.
    """
    parts = classes(words)
    keys = [f"c{i}" for i in range(len(parts))]
    count = [(F.char_length("word") - F.char_length(F.translate("word", p, ""))).alias(k) for p, k in zip(parts, keys)]
    block = F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("block")
    words = words.select("word", "n", *count).select("word", "n", block, *keys)
    sizes = keep(words.groupBy("block", *keys).agg(F.count(F.lit(1)).alias("rows")))
    sent = keep(sizes.select("block", "rows", F.explode(_homes([F.col(k) for k in keys])).alias("h")).select("block", "rows", "h.home", "h.own"))
    split = lambda x, most: F.ceil(F.sum(x) / most).cast("int")
    stats = sent.groupBy("home").agg(split(F.when(F.col("own"), F.col("rows")), HOME).alias("homes"), split("rows", GUESTS).alias("guests")).where("homes is not null")
    where = sent.join(stats, "home").groupBy("block").agg(F.collect_list(F.struct("home", "own", "homes", "guests")).alias("to"))
    rows = words.select("word", "n", "block").join(keep(where), "block").select("word", "n", F.explode("to").alias("h"))
    # a home word stands in one part of its block and meets all parts of the guests; a guest meets all parts of the home
    own, i, j = F.col("h.own"), F.pmod(F.xxhash64("word"), F.col("h.homes")).cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("h.guests")).cast("int")
    rows = rows.select("word", "n", F.col("h.home").alias("home"), own.alias("own"), i.alias("i"), j.alias("j"), F.col("h.homes").alias("homes"), F.col("h.guests").alias("guests"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("homes") * F.col("guests") - 1)))
    rows = rows.withColumns({"is_home": F.col("own") & (F.floor(F.col("part") / F.col("guests")) == F.col("i")), "is_guest": F.col("part") % F.col("guests") == F.col("j")})
    rows = rows.where("is_home or is_guest").select("home", "part", "word", "n", "own", "is_home", "is_guest")
    met = rows.groupBy("home", "part").applyInArrow(_meet, "word string, n_near long, best_n long, best string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words (word, n).

    form is the near word of largest n (ties: first in code-point order) if it has `times` times the word's n at least, else
    null; root is where the forms lead. A form is more common than its word, so that chains end; they are
    followed by doubling, in rounds logarithmic in the longest.
    """
    words = keep(words.select("word", "n"))
    rows = words.join(keep(near_words(words)), "word", "left")
    ok = F.col("best_n") >= F.col("n") * times
    rows = keep(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n")))
    links = keep(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = keep(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, times: int = 10, typo: int = 0) -> DataFrame:
    """variants() of the words of docs that have `least` letters and occur twice at least; see occurrences() for what a word is."""
    found = occurrences(docs, text, key, least, typo)
    return variants(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), times)


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents, one in 31 of which has lost a letter."""
    return group_variants(table(spark, sf_dir, "documents"), typo=31)
