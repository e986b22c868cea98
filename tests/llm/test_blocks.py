from __future__ import annotations

import random
import time
from html import escape
from html.parser import HTMLParser

import numpy as np
import pytest

from tidemark.llm import blocks

SKIPPED = {"nav", "footer", "aside", "form", "script", "style", "title", "header"}


class Reader(HTMLParser):
    """A plain second reading: text of the article element by block, without elements of SKIPPED and of class ad or comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.out = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if self.skip:
            self.skip += tag == self.skipping
        elif (tag in SKIPPED and not (tag == "header" and self.inside)) or dict(attrs).get("class") in ("ad", "comments"):
            self.skip, self.skipping = 1, tag
            self.out.append("")
        elif tag == "article":
            self.inside += 1
        elif tag == "br":
            self.out[-1] += " "
        if tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.out.append("")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag == self.skipping
            return
        self.inside -= tag == "article"
        if tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.out.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.out[-1] += data


def second(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(y for x in reader.out if (y := " ".join(x.split())))


def page(rng):
    words = lambda n: escape(" ".join(rng.choice(("ab", "c&d", "<e>", "é", "ü\n x", "long word", "q;")) for _ in range(n)))
    body = [f"<h1>{words(rng.randrange(1, 5))}</h1>"]
    for _ in range(rng.randrange(8)):
        body.append(rng.choice((f"<p>{words(rng.randrange(40))}</p>", f"<p><b>{words(3)}</b> <a href='x>y'>{words(2)}</a>", f"<p><b>{words(9)}<br><p>{words(1)}</p>", f'<div class="ad">{words(20)}</div>', f"<ul><li>{words(2)}<li>{words(3)}</ul>", f'<!-- {words(2)} --><script>if (a<b) "</p>"</script>', f"<form><p>{words(30)}</p></form>", f"<aside><p>{words(50)}</p></aside>")))
    tail = f'<section class="comments"><article class="comment"><p>{words(60)}</p></article></section>'
    return (
        f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body><header><h1>{words(3)}</h1></header><nav><ul><li><a href=/x>{words(2)}</a></li></ul></nav>"
        f"<div class='notice'>{words(30)}</div><article>{''.join(body)}</article>{tail if rng.random() < 0.5 else ''}<footer>&copy; {words(9)}</footer>{'</body></html>' if rng.random() < 0.8 else ''}"
    )


def test_extraction_equals_a_second_reading():
    rng = random.Random(2)
    for _ in range(500):
        html = page(rng)
        assert blocks.main_text(html)[0] == second(html), html


LONG = "word " * 30


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("   <!-- x", ""),
        ("just text &amp; more", "just text & more"),
        ("<article><h1>A</h1>one<br>two<p>three &lt;x&gt;  \n four</article>", "A\none two\nthree <x> four"),
        ("<article>a < b <3 and 1<2 </article>", "a < b <3 and 1<2"),
        ("<article><p>x</p><script>var t='</article>';</script><p>y</p></article>", "x\ny"),
        ("<article><p>x<p>y<nav>menu<p>deep</nav><div class='sidebarLeft'>no</div>z</article>", "x\ny\nz"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\nx"),
        ("<form id=all><div class=menu>m</div><article>x</article></form>", "x"),
        ("<div class='sidebar-left content'><article><p>x</p></article><p>out</p></div>", "x"),
        ("<article>short</article><article><p>longer text</article><article class='teaser big'><p>a teaser that is much longer</article>", "longer text"),
        ("<main><p>x</p><section id=comments><p>c</p></section></main><p>out</p>", "x"),
        ("<article><p title=\"a>b\">x</p><p data-x='<p>'>y</p><img alt=z><input value=v></article>", "x\ny"),
        ("<article><p>x</p><p hidden>h</p><div role=alert>r</div><textarea>t</textarea><select><option>o</select></article>", "x"),
        ("<article>&#65;&eacute;&nbsp;&copy &unknown; &#xD800;</article>", "Aé © &unknown; �"),
        ("<article></p></div>x</b></article> tail", "x"),
        ("<article><p>never closed <b>bold <i>x", "never closed bold x"),
        ("<article><p>cut <a href='x", "cut"),
        (f"<div><a href=1>Home</a></div><div><a href=2>{LONG}</a></div><h1>T</h1><p>{LONG}</p><p>short</p><p>{LONG}</p><div><a>x</a></div><div><a>y</a></div><div><a>y</a></div><div>All rights</div>", f"T\n{LONG.strip()}\nshort\n{LONG.strip()}"),
        (f"<div class=sidebar><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_cases(html, want):
    assert blocks.main_text(html)[0] == want


def test_surges_and_dives():
    rng = np.random.default_rng(3)
    for _ in range(400):
        lengths = rng.integers(0, 60, 25) * (rng.random(25) < 0.5)
        sums = [int(lengths[i : i + 3].sum()) for i in range(25)]
        assert blocks.window_sums(lengths).tolist() == sums
        want, i = [], 0
        while i < 25:
            if lengths[i] and sums[i] >= 80 and i < 24 and sums[i + 1]:
                j = next((k for k in range(i, 25) if sums[k] == 0), 25)
                want.append((i, j))
                i = j
            else:
                i += 1
        if want:
            assert blocks.stretches(lengths, 80) == want
        texts = [i for a, b in blocks.stretches(lengths, 1) for i in range(a, b) if lengths[i]]
        assert texts == np.flatnonzero(lengths).tolist()


def test_long_and_hostile_pages_take_linear_time():
    for html in ("<b>" * 200_000 + "x" * 10, "<p>a" * 200_000, "<div>" * 100_000 + "</div>" * 100_000, "<!x" * 200_000, "<a =\"" * 200_000, "<" * 500_000, "&" * 500_000, "</b>" * 200_000, "<article>" * 50_000 + "x"):
        began = time.time()
        blocks.main_text(html)
        assert time.time() - began < 20, html[:20]


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, lines int"
    pages = spark.createDataFrame([(1, "u", "<article><p>a&amp;b</p>é</article>", "t", "c", 1), (1, "u", "<article><p>a&amp;b</p>é</article>", "t", "c", 1), (2, None, None, None, None, None), (None, "v", "", "", "", 0), (3, "w", "<article>" + "<p>x y</p>" * 40_000, "", "", 0)], schema)
    got = sorted((tuple(r) for r in blocks.extract(pages).collect()), key=str)
    assert [r[:4] for r in got if r[0] != 3] == [(1, "u", "a&b\né", 5)] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    long = next(r for r in got if r[0] == 3)
    assert long[2] == "\n".join(["x y"] * 40_000) and long[3] == 159_999
    assert blocks.extract(pages.limit(0)).count() == 0
