"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM over a page's sequence of leaf blocks."""

from __future__ import annotations

import html
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgram.llm.text import aside, prefix_sums, slices, span_hash, text_bytes, words

#: Cells of a block's tag-path vector and of its hashed-word vector, other features, and units of each direction.
PATH, WORDS, OTHER, HIDDEN = 128, 32, 6, 24
#: Pages that the labeller is fitted on, about; a stated bound, see train().
MAX_TRAIN = 400

#: HTML element names. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())

#: Elements whose content is no text, up to their end tag: the first ones to the end of the page if there is none.
RAW, HIDDEN_PARTS = {"script", "style"}, {"noscript", "template", "svg", "iframe", "object", "title"}
#: Elements that may stand in a head; any other one ends it.
IN_HEAD = set("base basefont bgsound link meta title script style noscript template".split())
#: Elements that are kept as open ones, at most: browsers have such a limit too. Text under deeper ones is kept.
DEPTH = 512
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

Block = tuple[tuple[str, ...], str, float]


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, end tags with / before their name; comments and content that is no text
    come as one, without a name. In linear time: what has been looked for in vain is not looked for again.

    A quote opens a value only after =, and only if it is closed; without a > to end it, < is text.
    """
    gone: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in gone:
            return -1
        spot = page.find(what, at)
        if spot < 0:
            gone.add(what)
        return spot

    def end_of_tag(at: int) -> int:
        """Place after the tag's >, or -1."""
        while m := _EDGE.search(page, at):
            at = m.end()
            if m[0] == ">":
                return at
            if page[max(0, at - 65) : at - 1].rstrip().endswith("=") and (close := find(m[0], at)) >= 0:
                at = close + 1
        gone.add(">")
        return -1

    def end_of_element(name: str, at: int) -> int:
        """Place after the element's end tag, or -1."""
        if "</" + name in gone:
            return -1
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
        if not m:
            gone.add("</" + name)
            return -1
        close = find(">", m.end())
        return close + 1 if close >= 0 else len(page)

    at = 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            close = find("-->", start + 4)
            at = close + 3 if close >= 0 else len(page)
            yield start, at, "", ""
        elif page.startswith(("<!", "<?"), start):
            close = find(">", start)
            if close < 0:
                at = start + 1
                continue
            at = close + 1
            yield start, at, "", ""
        elif ">" not in gone and (m := _NAME.match(page, start + 1)) and (end := end_of_tag(m.end())) >= 0:
            name, at = m[0].lower(), end
            if name in RAW:
                close = end_of_element(name, end)
                at = close if close >= 0 else len(page)
                yield start, at, name + "/", ""
            elif name in HIDDEN_PARTS and page[end - 2] != "/" and (close := end_of_element(name, end)) >= 0:
                at = close
                yield start, at, name + "/", ""
            else:
                yield start, at, name, page[m.end() : end - 1]
        else:
            at = start + 1


def blocks(page: str) -> list[Block]:
    """(tag path, text, share of its characters in links) of each leaf block of a page, in order.

    A path has an entry for each open element that isn't inline, DEPTH at most: its name and the words of its class, id and role.
    Scripts, styles, comments, titles and what noscript, template, svg, iframe and object elements hold are no text; one of the
    latter five that is never closed hides nothing. A head ends with its end tag, or without one where something begins that can't
    stand in it. White space in a block is one space; br is white space. Unclosed elements end with what holds them, a
    paragraph also where another block begins.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    in_link, linked, at, in_head = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((tuple(e for _, e in stack), whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal in_head, linked
        if in_head and not piece.strip():
            return
        in_head = False
        piece = html.unescape(piece)
        text.append(piece)
        if in_link:
            linked += len(piece)

    for start, end, name, attributes in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        closing = name.startswith("/")
        name = name.lstrip("/")
        if not name:
            continue
        if in_head and name.rstrip("/") in IN_HEAD:
            continue
        in_head = in_head and name == "head" and not closing
        if name.endswith("/"):
            continue
        if name == "head":
            in_head = not closing
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in INLINE:
            continue
        elif closing:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = 0
        else:
            flush()
            in_link = 0
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                stack.pop()
            if name not in VOID and len(stack) < DEPTH:
                parts = [w for a in _ATTR.findall(attributes) for w in _PART.findall("".join(a).lower())]
                stack.append((name, " ".join([name, *parts])))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names, class words and parent-child pairs of a tag path; the leaf's own weigh more."""
    out = np.zeros(PATH, np.float32)
    for k, e in enumerate(path):
        name, *parts = e.split(" ")
        near = 1.0 if k < len(path) - 1 else 1.5
        out[zlib.crc32(name.encode()) % PATH] += near
        for p in parts:
            out[zlib.crc32(b"." + p.encode()) % PATH] += near
        if k:
            out[zlib.crc32((path[k - 1].split(" ")[0] + ">" + name).encode()) % PATH] += 0.5
    return out


def text_vectors(page_blocks: list[Block]) -> np.ndarray:
    """Hashed-word vectors of unit length, with length, link share, signs, digits and upper case of each block."""
    text = pa.array([b[1] for b in page_blocks], pa.large_string())
    n = len(page_blocks)
    data, off = text_bytes(text)
    start, end, row = words(data, off)
    h = span_hash(prefix_sums(data), start, end)
    bag = np.bincount(row * WORDS + (h >> np.uint64(59)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1)
    size = np.maximum(np.diff(off), 1)
    share = lambda hit: np.add.reduceat(hit.astype(np.int64), off[:-1]) / size if n else np.zeros(0)
    other = np.stack([
        np.log1p(size) / 5, np.log1p(np.bincount(row, minlength=n)) / 4, np.array([b[2] for b in page_blocks]),
        share((data == 46) | (data == 44)) * 10, share((data >= 48) & (data <= 57)) * 5, share((data >= 65) & (data <= 90)) * 3,
    ], axis=1)
    return np.hstack([bag, other.astype(np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM of HIDDEN units a direction, and a logistic unit on both of its states."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d = PATH + WORDS + OTHER
        self.p: dict[str, np.ndarray] = {}
        for k in "fb":
            self.p["w" + k] = r.normal(0, 0.15, (d, 4 * HIDDEN)).astype(np.float32)
            self.p["u" + k] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + k] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.p["v"] = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, k: str, tape: list | None = None) -> np.ndarray:
        """States (steps x pages x HIDDEN) of one direction over projected inputs (steps x pages x 4 HIDDEN)."""
        n, h, c = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], n), np.float32)
        for t in range(len(x)) if k == "f" else range(len(x) - 1, -1, -1):
            z = x[t] + h @ self.p["u" + k]
            g, a = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
            m = mask[t][:, None]
            new = f * c + i * a
            s = np.tanh(new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, a, s))
            h, c = np.where(m, o * s, h), np.where(m, new, c)
            out[t] = h
        return out

    def scores(self, x: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        return _sigmoid(np.concatenate([self.run(x[k], mask, k) for k in "fb"], axis=2) @ self.p["v"] + self.p["o"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) for inputs (steps x pages x features), by back-propagation through time."""
        tape: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(x @ self.p["w" + k] + self.p["c" + k], mask, k, tape[k]) for k in "fb"], axis=2)
        p = _sigmoid(states @ self.p["v"] + self.p["o"])
        total = mask.sum()
        loss = -(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / total
        d = ((p - y) * mask / total).astype(np.float32)
        g = {"v": np.einsum("tb,tbh->h", d, states), "o": np.array([d.sum()], np.float32)}
        n = HIDDEN
        for j, k in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            du = np.zeros_like(self.p["u" + k])
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            own = self.p["v"][j * n : (j + 1) * n]
            for t, h, c, i, f, o, a, s in reversed(tape[k]):
                m = mask[t][:, None]
                dh = dh + d[t][:, None] * own
                dn = np.where(m, dh * o * (1 - s * s) + dc, 0)
                dz = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * s, 0) * o * (1 - o), dn * i * (1 - a * a)], axis=1)
                dz_all[t] = dz
                du += h.T @ dz
                dh = np.where(m, dz @ self.p["u" + k].T, dh)
                dc = np.where(m, dn * f, dc)
            g["w" + k] = np.einsum("tbd,tbz->dz", x, dz_all, optimize=True)
            g["u" + k], g["c" + k] = du, dz_all.sum(axis=(0, 1))
        return float(loss), g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 1) -> None:
        """Adam over (features, labels) of pages, in batches of like length."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for j in r.permutation(len(chunks)):
                x, y, mask = _pad([pages[i][0] for i in chunks[j]], [pages[i][1] for i in chunks[j]])
                _, g = self.gradients(x, mask, y)
                step += 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k in self.p:
                    a = g[k] * min(1.0, 5.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.p)
        return f.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Labeller:
        out = cls()
        out.p = dict(np.load(io.BytesIO(raw)))
        return out


def _pad(features: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, t = len(features), max(map(len, features))
    x = np.zeros((t, n, features[0].shape[1]), np.float32)
    y, mask = np.zeros((t, n), np.float32), np.zeros((t, n), bool)
    for i, f in enumerate(features):
        x[: len(f), i], mask[: len(f), i] = f, True
        if labels is not None:
            y[: len(f), i] = labels[i]
    return x, y, mask


#: Names and class words by which the examples are labelled; the labeller itself sees them as hashed cells only.
MAIN = set("article main content post entry story body text".split())
ASIDE = set(
    "nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsored sponsor cookie consent notice alert form button label fieldset select comments "
    "comment reply respond related share social breadcrumb breadcrumbs pagination pager newsletter subscribe login search widget masthead toolbar copyright disqus popup modal".split()
)


def teach(page_blocks: list[Block]) -> np.ndarray:
    """Labels from the page's structure: 1 in an article or the like, 0 outside and in what isn't its text."""
    named = [[set(e.split(" ")) for e in path] for path, _, _ in page_blocks]
    aside = np.array([any(s & ASIDE for s in p) for p in named], bool)
    inside = np.array([any(("article" in s or "main" in s or ("div" in s or "section" in s) and s & MAIN) for s in p) for p in named], bool)
    if not (inside & ~aside).any():
        inside = np.array([b[2] < 0.5 and len(b[1]) > 40 for b in page_blocks], bool)
    return (inside & ~aside).astype(np.float32)


_CONTAINERS = ["article", "main", "div content", "div post content", "section article body", "div entry content", "div main", "div article text", "div story", "article post", "div main content role main"]
_EXTRAS = [
    ("nav", "ul", "li"), ("nav menu", "ul", "li"), ("ul menu", "li"), ("div menu", "ul", "li"), ("header", "div"), ("header", "p"), ("header site header", "h"), ("div header",), ("footer", "p"), ("footer",),
    ("div footer", "p"), ("aside", "p"), ("aside", "h"), ("aside sidebar", "ul", "li"), ("div sidebar", "p"), ("div sidebar", "div", "p"), ("div notice",), ("div cookie notice", "p"), ("div cookie banner", "p"),
    ("div alert", "p"), ("div ad",), ("div ads", "p"), ("div advert", "p"), ("div advertisement",), ("div promo", "p"), ("div sponsored", "p"), ("form", "label"), ("form", "p"), ("form search", "button"),
    ("form", "div"), ("section comments", "p"), ("section comments", "div comment", "p"), ("div comments", "div comment", "p"), ("div comments", "ul", "li comment", "p"), ("ol comments", "li comment", "p"),
    ("div comment", "p"), ("section comments", "article comment", "p"), ("div related", "ul", "li"), ("div share",), ("div breadcrumbs",), ("div newsletter", "p"), ("div widget", "p"),
]


def variants(page_blocks: list[Block], others: list[str], r: np.random.Generator, times: int = 3) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Examples made of one page: its article in other containers, with other pages' sentences as what surrounds it."""
    label = teach(page_blocks)
    own = [b for b, y in zip(page_blocks, label) if y]
    yield page_blocks, label
    for _ in range(times):
        box = ("html", "body", *["div" for _ in range(r.integers(0, 3))], _CONTAINERS[r.integers(len(_CONTAINERS))], *["div" for _ in range(r.integers(0, 2))])
        out: list[tuple[Block, int]] = []

        def extra(parents: tuple[str, ...], most: int, out=out) -> None:
            for _ in range(r.integers(0, most + 1)):
                e = _EXTRAS[r.integers(len(_EXTRAS))]
                e = tuple(x if x != "h" else f"h{r.integers(2, 5)}" for x in e)
                line = "li" in e[-1] or r.random() < 0.3
                for _ in range(r.integers(2, 8) if line else r.integers(1, 4)):
                    t = others[r.integers(len(others))]
                    t = " ".join(t.split(" ")[: r.integers(1, 4)]) if line else t[: r.integers(30, 600)]
                    out.append(((parents + e, t, 1.0 if line and r.random() < 0.8 else 0.0), 0))

        extra(("html", "body"), 4)
        for k, (path, text, link) in enumerate(own):
            leaf = path[-1].split(" ")[0] if path else "p"
            out.append(((box + (leaf if leaf in ("p", "li", "h1", "h2", "h3", "h4", "blockquote", "pre", "td") else "p",), text, link), 1))
            if r.random() < 0.08:
                extra(box, 1)
        if r.random() < 0.4:
            extra(box, 2)
        extra(("html", "body"), 4)
        if out:
            yield [b for b, _ in out], np.array([y for _, y in out], np.float32)


def features(page_blocks: list[Block]) -> np.ndarray:
    return np.hstack([np.stack([path_vector(b[0]) for b in page_blocks]), text_vectors(page_blocks)])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = [p for b in batches for p in (blocks(x) for x in b.column("html").to_pylist()) if p]
    if pages:
        r = np.random.default_rng(3)
        others = [b[1] for p in pages for b in p]
        made = [(features(p), y) for page in pages for p, y in variants(page, others, r)]
        model = Labeller()
        model.fit(made)
        yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.binary())], ["model"])


def train(pages: DataFrame, max_train: int = MAX_TRAIN) -> bytes:
    """A labeller fitted on about max_train pages (html), chosen by a hash of page_id, in one task.

    Their blocks are labelled by the page's structure (teach), and rearranged in other structures (variants), so that
    the labeller goes by tags, class words, words and neighbours together. No page: an unfitted labeller.
    """
    share = min(1.0, max_train / max(1, pages.count()))
    rows = pages.where(F.col("html").isNotNull()).where(F.pmod(F.xxhash64("page_id", F.lit(10)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    got = rows.select("page_id", "html").repartition(1).sortWithinPartitions(F.xxhash64("page_id"), F.xxhash64("html")).select("html").mapInArrow(_train, "model binary").first()
    return got[0] if got else Labeller().dumps()


def label(model: Labeller, pages: list[list[Block]], together: int = 64) -> list[np.ndarray]:
    """Scores of all blocks of each page; pages of like length run together, and each path is projected once."""
    out = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    flat = [b for i in order for b in pages[i]]
    if not flat:
        return out
    paths: dict[tuple[str, ...], int] = {}
    number = np.array([paths.setdefault(b[0], len(paths)) for b in flat])
    vectors, text = np.stack([path_vector(p) for p in paths]), text_vectors(flat)
    x = {k: (vectors @ model.p["w" + k][:PATH])[number] + text @ model.p["w" + k][PATH:] + model.p["c" + k] for k in "fb"}
    at = np.cumsum([0, *(len(pages[i]) for i in order)])
    for j in range(0, len(order), together):
        own = range(j, min(j + together, len(order)))
        padded = {k: _pad([x[k][at[i] : at[i + 1]] for i in own]) for k in "fb"}
        score = model.scores({k: v[0] for k, v in padded.items()}, padded["f"][2])
        for n, i in enumerate(own):
            out[order[i]] = score[: len(pages[order[i]]), n]
    return out


def extract(pages: DataFrame, model: bytes, at_least: float = 0.5) -> DataFrame:
    """pages (html, other columns) plus text: the blocks that the labeller takes for the article's, joined by line feeds.

    Null and empty pages, and pages without such a block, have an empty text. A column text of pages comes back as
    aside() names it.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.loads(shared.value)
        for b in slices(batches, "html"):
            split = [blocks(x or "") for x in b.column("html").to_pylist()]
            text = ["\n".join(x[1] for x, s in zip(p, score) if s >= at_least) for p, score in zip(split, label(labeller, split))]
            yield b.append_column("text", pa.array(text, pa.string()))

    clean, _ = aside(pages, "text")
    return clean.mapInArrow(task, T.StructType([*clean.schema.fields, T.StructField("text", T.StringType())]))


def op10_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, train(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
