"""Spelling variants, whitening and URL filters against brute force, and on nulls, empty tables, long texts, ties, repeated rows and
clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgram.llm import spelling, urls, whitening

R = random.Random(11)
LETTERS = "abcdeghilmnorstuéßñ"


# spelling


def variants_by_hand(docs, typo):
    """word: (form, root, n, n_near, form_n), by comparing each word with all that share a deletion with it."""
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: x for w, x in n.items() if len(w) >= 7 and x >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long_ = sorted((a, b), key=len)
        return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))

    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(by[w]), n.get(form[w]))
    return out


@pytest.fixture(scope="module")
def misspelt():
    base = ["".join(R.choice(LETTERS) for _ in range(R.randint(6, 12))) for _ in range(25)]
    words = []
    for i, w in enumerate(base):
        words += [w] * (3 + 40 * (i % 4))
        for _ in range(6):
            j = R.randrange(len(w))
            words += [R.choice([w[:j] + w[j + 1 :], w[:j] + R.choice(LETTERS) + w[j:], w[:j] + R.choice(LETTERS) + w[j + 1 :]])] * R.randint(1, 3)
    words += ["Straßen×÷", "STRAßEN×÷", "straßen×÷", "mmmmmmno"] * 2 + ["mmmmmmnp"] * 40 + ["mmmmmmqp"] * 500 + ["x" * 5000, "x" * 4999] * 2
    R.shuffle(words)
    docs = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return [*docs, docs[3], docs[3], (None, "without an id, misspelt"), (90, None), (91, ""), (92, "12 34 -- 东京 " + "trennung" * 20000)]


@pytest.mark.parametrize("typo", [0, 5, 31])
def test_variants(spark, misspelt, typo):
    docs = spark.createDataFrame([(*r, 1, "x") for r in misspelt], "doc_id long, text string, n int, word string")
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.group_variants(docs, typo=typo).collect()}
    assert got == variants_by_hand(misspelt, typo)
    assert any(v[0] for v in got.values()) and any(v[0] and v[0] != v[1] for v in got.values())


def test_split_blocks(spark, misspelt, monkeypatch):
    """Blocks over the limits are split, and lose no pair and count none twice."""
    docs = spark.createDataFrame(misspelt, "doc_id long, text string")
    words = spelling.occurrences(docs, typo=0).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    want = sorted(map(tuple, spelling.near_words(words).collect()))
    monkeypatch.setattr(spelling, "HOME", 3)
    monkeypatch.setattr(spelling, "GUESTS", 5)
    monkeypatch.setattr(spelling, "classes", lambda w: [spelling.LETTERS])
    assert sorted(map(tuple, spelling.near_words(words).collect())) == want


def test_products_find_all_pairs(monkeypatch):
    words = sorted({"".join(R.choice("abc") for _ in range(8)) for _ in range(400)})
    longer = sorted({"".join(R.choice("abc") for _ in range(9)) for _ in range(400)})
    monkeypatch.setattr(spelling, "ROWS", 37)
    monkeypatch.setattr(spelling, "COLUMNS", 41)
    got = {(words[i], longer[j]) for i, j in zip(*spelling.near_pairs(words, longer))}
    assert got == {(a, b) for b in longer for a in {b[:i] + b[i + 1 :] for i in range(9)} & set(words)}
    got = {(words[i], words[j]) for i, j in zip(*spelling.near_pairs(words, words))}
    assert got == {(a, b) for a in words for b in words if sum(x != y for x, y in zip(a, b)) == 1}


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, "short words, once misspelt")], docs.schema)).collect() == []


# whitening


def whiten_by_hand(vectors, k=4):
    x = np.array([np.floor(256 * np.array(v, float)) for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening(spark, monkeypatch, tmp_path):
    g = np.random.default_rng(3)
    v = (g.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    good = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (500, v[9].tolist()), (None, v[11].tolist())] + [(600 + i, v[0].tolist()) for i in range(150)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [3e38] * 6)]
    monkeypatch.setattr(whitening, "BLOCK", 16)  # several blocks, and several splits of the product
    spark.createDataFrame([*good, *bad], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12_whitening(spark, str(tmp_path)).collect()
    n, deviation, whitened, explained = whiten_by_hand([x for _, x in good])
    assert len(out) == 4 * len(good) and {r["n"] for r in out} == {n} == {300} and max(r["identity_error"] for r in out) < 1e-10
    key = lambda i: -1 if i is None else i
    got = sorted((key(r["vec_id"]), r["component"], r["deviation"], r["whitened"]) for r in out)
    want = sorted((key(i), c + 1, int(d), w[c]) for (i, _), d, w in zip(good, deviation, whitened) for c in range(4))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for c in range(1, 5):
        a, b = (np.array([x[3] for x in rows if x[1] == c]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r["explained"] - explained[c - 1]) < 1e-12 for r in out if r["component"] == c)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>, x string, index int"
    rows, facts = whitening.whiten(spark.createDataFrame([], schema))
    assert rows.collect() == [] and facts["n"] == 0
    rows, facts = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], "a", 3), (2, [0.5, 2.0], "b", 4)], schema))
    assert [(r["vec_id"], r["deviation"], r["whitened"], r["x_in"], r["index_in"]) for r in rows.orderBy("vec_id").collect()] == [(1, 0, [], "a", 3), (2, 0, [], "b", 4)]
    rows, facts = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "a", 3) for i in range(5)], schema))
    assert facts["n"] == 5 and all(len(r["whitened"]) == 1 for r in rows.collect())  # rank one
    big = [(1, [2e13, 0.0], "a", 1), (2, [-2e13, 1.0], "a", 1), (3, [1e-3, 5.0], "a", 1)]
    rows, _ = whitening.whiten(spark.createDataFrame(big, schema))
    assert all(r["deviation"] is None for r in rows.where("vec_id < 3").collect())  # past a long


# urls


def parts_by_hand(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_by_hand(host, path, rules):
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, None, None))[1:]


URLS = [
    "http://example.org/es/1", "HTTPS://WWW.Example.ORG/en/12?x=/es/", "http://a.example.org/en/2", "https://example.com/fr/3#/de/", "http://x.y.com/de/4", "http://com/de/5", "http://telecom/de/6", "http://notexample.org/en/1",
    "http://org", "http://org?/", "http://b.co.uk:80/en/9", "ftp://user@c.co.uk/9", "http://10.1.2.3/x/7", "no scheme", "", None, "://", "http://é.net/en/1/", "a://b://c.org/q", "http://" + "a." * 30000 + "org/" + "p/" * 30000, "http://x.net/en/\n5", "http://dot.com./fr/1",
]


def test_hosts_and_rules(spark):
    rules = [*urls.RULES, ("net", "/en/", "allow"), ("net", "/en/", "block"), ("co.uk", "", "block")]
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    h, p = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    got = rows.select("url", h.alias("h"), p.alias("p")).withColumn("r", urls.best_rule(F.col("h"), F.col("p"), rules)).collect()
    for r in got:
        assert (r["h"], r["p"]) == parts_by_hand(r["url"])
        assert (r["r"] and (r["r"]["rule"], r["r"]["verdict"])) == (rule_by_hand(r["h"], r["p"], rules) if rule_by_hand(r["h"], r["p"], rules)[0] else None)


def shrunk_by_hand(rows, prior):
    seen = [(n, g, m) for (n, g), m in zip(rows, prior) if n]
    top = sum((g / n - m) ** 2 * n - m * (1 - m) for n, g, m in seen)
    low = sum(m * (1 - m) * (n - 1) for n, g, m in seen)
    k = 1 / min(urls.MOST, max(urls.LEAST, top / low if low else urls.LEAST)) - 1
    return [(g + k * m) / (n + k) for (n, g), m in zip(rows, prior)], k


def test_reputation(spark):
    hosts = {}
    for d in range(12):
        for h in range(8):
            n = R.choice([0, 1, 5, 60, 400])
            hosts[f"h{h}.d{d}.{'net' if d % 3 else 'co.uk'}"] = (n, sum(R.random() < (0.1 if d % 4 == 0 else 0.85) for _ in range(n)))
    pages = [(i, f"https://{h}/p/{i}") for i, h in enumerate(x for x in hosts for _ in range(3))] + [(-i, f"http://h1.d1.net/{i}") for i in range(900)] + [(None, None), (5, "nothing")]
    names = sorted({parts_by_hand(u)[0] for _, u in pages})
    count = [hosts.get(h, (0, 0)) for h in names]
    suffix = ["co.uk" if h.endswith(".co.uk") else h.split(".")[-1] for h in names]
    domain = [".".join(h.split(".")[1:]) if h else "" for h in names]

    def total(keys):
        out = collections.defaultdict(lambda: [0, 0])
        for k, (n, g) in zip(keys, count):
            out[k][0] += n
            out[k][1] += g
        return {k: tuple(v) for k, v in out.items()}

    ends, domains = total(suffix), total(domain)
    overall = (sum(g for _, g in count) + 1) / (sum(n for n, _ in count) + 2)
    of_end = dict(zip(ends, shrunk_by_hand(list(ends.values()), [overall] * len(ends))[0]))
    end_of = dict(zip(domain, suffix))
    of_domain = dict(zip(domains, shrunk_by_hand(list(domains.values()), [of_end[end_of[d]] for d in domains])[0]))
    mean, k = shrunk_by_hand(count, [of_domain[d] for d in domain])
    upper = [min(1.0, m + math.sqrt(19 * m * (1 - m) / (n + k + 1))) for m, (n, _) in zip(mean, count)]
    want = dict(zip(names, zip(mean, upper)))
    table = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, host string, labelled string")
    outcomes = spark.createDataFrame([(h, n, g) for h, (n, g) in hosts.items() if n], "host string, n long, good long")
    got = urls.judge(table, outcomes, rules=[]).collect()
    assert len(got) == len(pages) and {r["host_in"] for r in got} == {"a"} and {r["labelled_in"] for r in got} == {"b"}
    for r in got:
        m, u = want[r["host"]]
        assert abs(r["good_share"] - m) < 1e-9 and abs(r["good_at_most"] - u) < 1e-9
        assert r["labelled"] == hosts.get(r["host"], (0, 0))[0] and r["rule"] is None and r["verdict"] == ("block" if u < 0.5 else "allow")
    assert {r["verdict"] for r in got} == {"block", "allow"}


def test_hot_hosts_stay(spark, monkeypatch):
    """With no key hot and with every key hot the rows are the same ones."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7 if i % 3 else 0}.a.net/{i}") for i in range(300)], "page_id long, url string")
    outcomes = spark.createDataFrame([(f"h{i}.a.net", 10, i) for i in range(7)], "host string, n long, good long")
    found = []
    for hot in (1, 10**9):
        monkeypatch.setattr(urls, "HOT", hot)
        found.append(sorted(map(str, urls.judge(pages, outcomes).collect())))
    assert found[0] == found[1] and len(found[0]) == 300


def test_urls_without_rows(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, urls.page_outcomes(pages, labels)).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/en/4?x"), (2, "http://a.net/en/4/"), (3, "http://b.net/en/x")], pages.schema)
    marks = spark.createDataFrame([(4, 1, 0), (4, 1, None), (5, None, 1), (None, 1, 0)], labels.schema)
    assert sorted(map(tuple, urls.page_outcomes(one, marks).collect())) == [("a.net", 2, 2)]
    assert {r["verdict"] for r in urls.judge(one, urls.page_outcomes(one, labels)).collect()} == {"allow"}
