"""The scanner of pages: against the standard library's parser on well-formed pages, and on broken ones, which must neither lose text
nor take long."""

import random
import time
from html.parser import HTMLParser

import pytest

from loomgram.llm import html

R = random.Random(12)
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title"}


class Plain(HTMLParser):
    """Texts between block tags, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.hidden = [], [], []

    def cut(self):
        whole = " ".join("".join(self.text).split())
        self.out += [whole] if whole else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag == "br":
            self.text.append(" ")
        elif tag not in html.INLINE and not self.hidden:
            self.cut()

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag not in html.INLINE and not self.hidden:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def made(depth=0):
    if depth > 4 or R.random() < 0.3:
        return R.choice(["words &amp; more", "1 &lt; 2", "a\n b", "<b>bold</b> plain", "x<br>y", "<a href='/?a=1&b=\">\"'>link</a>", "it's \"quoted\"", "<!-- not > this -->seen", "5 < 6 > 4"])
    name = R.choice(["div", "p", "section", "li", "td", "article", "span", "em", "svg", "script", "style", "noscript", "iframe", "svg-icon", "header", "object"])
    inside = "no text" if name in HIDDEN else "".join(made(depth + 1) for _ in range(R.randint(1, 4)))
    return f"<{name} class=\"a > b\" data-x='<i>' id=c>{inside}</{name}>"


@pytest.mark.parametrize("n", range(40))
def test_same_texts_as_another_parser(n):
    page = "<!DOCTYPE html><html><head><title>no</title><meta charset=utf-8><script>var t = '<p>';</script></head><body>" + "".join(made() for _ in range(12)) + "</body></html>"
    plain = Plain()
    plain.feed(page)
    plain.close()
    plain.cut()
    assert [b[1] for b in html.blocks(page)] == plain.out


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><body><p>all of it<p>and this", ["all of it", "and this"]),
        ("<html><head><meta charset=x><title>t</title><p>first<p>second", ["first", "second"]),
        ("<head><title>t</title>plain text", ["plain text"]),
        ("<title>t</title><p>no head", ["no head"]),
        ("<header>top</header><p>body</p>", ["top", "body"]),
        ("<p>a</p><svg/><p>b</p><svg-icon>c</svg-icon><p>d", ["a", "b", "c", "d"]),
        ("<p>a<svg><path d='M'><p>b", ["a", "b"]),
        ("<p>a</p><noscript><p>b", ["a", "b"]),
        ("<p>a</p><iframe src=x><p>b</p><object><p>c", ["a", "b", "c"]),
        ("<p>a</p><noscript>x</noscript><template>y</template><iframe>z</iframe><p>b", ["a", "b"]),
        ("<p>a</p><script>x<p>y</script ><p>b<STYLE>p{}</STYLE><p>c", ["a", "b", "c"]),
        ("<p title=it's>a</p><p>don't<p>b", ["a", "don't", "b"]),
        ("<p title=\"open>a</p><p>b</p>", ["a", "b"]),
        ("a < b and c <3", ["a < b and c <3"]),
        ("<p>x <b never closed", ["x <b never closed"]),
        ("<p>a<!-- never closed <p>b", ["a"]),
        ("", []),
        ("<", ["<"]),
    ],
)
def test_broken_pages_lose_no_text(page, texts):
    assert [b[1] for b in html.blocks(page)] == texts


@pytest.mark.parametrize("part", ["<b ", "<", "<svg>", "<b a=\"", "<b a='\"", "<!x ", "</svg ", "<noscript>", "<p class=", "<div>a", "<!--", "<script", "</p>"])
def test_time_is_linear(part):
    start = time.time()
    html.blocks(part * ((1 << 20) // len(part)))
    assert time.time() - start < 30
