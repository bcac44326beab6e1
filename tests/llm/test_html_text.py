import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest

from visitorlens.llm import html_text as ht

TREE = ht.fit_tree(*ht.labelled_table())
PROSE = "It was said in the council that no such bridge had ever been built over so wide a river in so short a time."


def test_tree_learns_its_table():
    rows, labels = ht.labelled_table()
    assert [ht.decide(TREE, r) for r in rows.tolist()] == labels.tolist()


def test_every_feature_of_the_neighbours_decides_something():
    def used(tree):
        return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    names = {ht.FEATURES[i] for i in used(TREE)}
    assert {"words", "link_density", "words_before", "density_before", "words_after", "density_after"} <= names


# Pages that the tree has not seen; main text begins with "+".
HELD_OUT = [
    f"<body><div role='navigation'><a href=/>Start</a></div><article><header><h1>+Bridge</h1></header><p>+{PROSE}</p><p>+So.</p>"
    f"<div class='advert'>{PROSE}</div><figure><img src=x><figcaption>+The bridge</figcaption></figure><p>+{PROSE}<footer>Filed under roads</footer></article>"
    f"<div class='newsletter-signup'>{PROSE}</div></body>",
    f"<main id=main><h2>+Bridge</h2><p>+{PROSE}</p><ol><li>+One</li><li>+Two</li></ol><section class='userComments'><p>{PROSE}</p></section></main>"
    f"<aside><p>{PROSE}</p></aside><footer><p>{PROSE}</p></footer>",
    f"<ul class=menu><li><a href=1>A</a><li><a href=2>B</a></ul><div class='entry-content'><p>+{PROSE}</p><p>+No.</p><p>+{PROSE}</p></div><div id=footer>{PROSE}</div>",
    f"<p>+{PROSE}</p><p>+{PROSE}</p><p><a href=1>Next</a></p>",
    f"<div class='page-banner'><article><p>+{PROSE}</p></article></div><div id='cookieConsent'><p>{PROSE}</p></div><p>{PROSE}</p>",
    f"<article><header class='post-header'><h1>+Bridge</h1></header><p class='legal'>+{PROSE}</p><p>+{PROSE}</p><p><a href=1>Share on Y</a></p><p><a href=2>Share by post</a></p><p>+{PROSE}</p></article>",
    f"<div><a href=1>Start</a></div><div><a href=2>Old news</a></div><div>+{PROSE}</div><div>+She agreed.</div><div>+{PROSE}</div><div><a href=3>Later</a></div>",
    f"<article><h1>+Bridge</h1><p>+{PROSE}</p><form><label>{PROSE}</label></form><nav><p>{PROSE}</p></nav><p>+End",
]


def test_held_out_accuracy():
    right = []
    for page in HELD_OUT:
        blocks = ht.blocks_of(page)
        for b, row in zip(blocks, ht.features_of(blocks).tolist(), strict=True):
            right.append(ht.decide(TREE, row) == b.text.startswith("+"))
    assert len(right) > 30 and np.mean(right) >= 0.97


@pytest.mark.parametrize(
    "html, texts",
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<br>d &nbsp;\n e", ["abc d e"]),
        ("<p>a<p>b</i></div></p>c", ["a", "b", "c"]),
        ("<script>var t='</p>'; a<b</script>x<style>p{}</style >y", ["x y"]),
        ("<SCRIPT>x", []),
        ("<!-- <p>no</p> -->a<!-- open", ["a"]),
        ("<p title='a>b' class=x>t</p><p title=it's>u</p>", ["t", "u"]),
        ('<p title="open>v</p>w', ["v", "w"]),
        ("1 < 2 &lt; 3 &#x41;&#66; &copy &unknown;", ["1 < 2 < 3 AB © &unknown;"]),
        ("<li>a<li>b<td>c<td>d", ["a", "b", "c", "d"]),
        ("<head><title>t</title></head><body>x", ["x"]),
        ("a<", ["a<"]),
        ("a<p", ["a"]),
        ("<p>A <svg/> B</p><p>tail</p>", ["A B", "tail"]),
        ("<p>A <svg><text>no</text><svg></svg></svg> B</p>", ["A B"]),
        ("<p>A <button>no</button> B</p><button>no<p>C</p>D<button>no</button>E", ["A B", "C", "D E"]),
        ("<article><p>A <button>no</p><p>B</article>C", ["A", "B", "C"]),
        ("<p>x <math><mi>a</mi></math> y</p>", ["x a y"]),
        ("<select><option>no</select>A<object><p>no</p><object></object>no</object>B", ["A B"]),
    ],
)
def test_blocks(html, texts):
    assert [b.text for b in ht.blocks_of(html)] == texts


class Plain(HTMLParser):
    """Blocks of well-formed pages by another reader: one path of elements per piece of text."""

    def __init__(self):
        super().__init__()
        self.path, self.pieces, self.out, self.skip = [], [], [], 0

    def close_block(self):
        text = " ".join("".join(t for t, _ in self.pieces).split())
        if text:
            self.out.append((text, sum(len(t.split()) for t, in_link in self.pieces if in_link), [p for p in self.path if p[0] in ht.BLOCK_TAGS]))
        self.pieces = []

    def handle_starttag(self, tag, attributes):
        if tag in ht.BLOCK_TAGS:
            self.close_block()
        if tag == "br":
            self.pieces.append((" ", False))
        elif tag not in ht.VOID:
            self.path.append((tag, dict(attributes).get("class", "")))

    def handle_endtag(self, tag):
        if tag in ht.BLOCK_TAGS:
            self.close_block()
        if tag in ("script", "style", "title"):
            self.pieces.append((" ", False))
        assert self.path.pop()[0] == tag

    def handle_data(self, data):
        if not {"script", "style", "title"} & {t for t, _ in self.path}:
            self.pieces.append((data, any(t == "a" for t, _ in self.path)))


def plain_text(page):
    """Features from the paths, one block at a time, and the tree read as nested questions."""
    reader = Plain()
    reader.feed(page)
    reader.close()
    reader.close_block()
    marks = []
    for text, linked, path in reader.out:
        side = doubtful = main = fixed = False
        for tag, names in path:
            words = set(re.findall("[a-z]+", names)) if tag not in ("html", "body") else set()
            if tag in ("article", "main"):
                side, doubtful, main = False, False, True
            fixed |= tag in ht.SIDE_TAGS or (tag == "header" and not main) or bool(words & ht.COMMENT_WORDS)
            side |= bool(words & ht.SIDE_WORDS)
            doubtful |= bool(words & ht.DOUBTFUL_WORDS)
            main |= bool(words & ht.MAIN_WORDS) and not side and not doubtful
        heading = any(tag[0] == "h" and tag[1:].isdigit() for tag, _ in path[-2:])
        words = len(text.split())
        marks.append((side or fixed, doubtful, main, heading, words, 1000 * min(linked, words) // words))
    kept = []
    for i, (text, _, _) in enumerate(reader.out):
        side, doubtful, main, heading, words, density = marks[i]
        before = marks[i - 1][4:] if i else (0, 0)
        after = marks[i + 1][4:] if i + 1 < len(marks) else (0, 0)
        row = [side, doubtful, main, any(m[2] for m in marks), heading, words, density, *before, *after]
        tree = TREE
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        if tree:
            kept.append(text)
    return "\n".join(kept)


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        words = " ".join(rng.choices(["river", "a", "&amp;", "caf\u00e9", "1&lt;2", "the"], k=rng.choice([1, 3, 7, 25])))
        if kind < 0.25 and depth < 4:
            tag = rng.choice(["div", "article", "section", "nav", "aside", "main", "header", "footer", "blockquote"])
            name = rng.choice(["", "ad", "search", "entry-content", "comments", "legal text", "story", "x9"])
            out.append(f'<{tag} class="{name}">{random_page(rng, depth + 1)}</{tag}>')
        elif kind < 0.6:
            out.append(f"<p>{words} <b>{words}</b><br>{words[:4].replace('&', '')}</p>")
        elif kind < 0.7:
            out.append(f"<h2>{words}</h2>")
        elif kind < 0.85:
            out.append(f"<ul><li><a href='/x'>{words}</a></li><li>{words} <a href='/y'>here</a></li></ul>")
        elif kind < 0.9:
            out.append("<script>var a = '<p>no</p>';</script>")
        else:
            out.append(words)
    return "".join(out)


def test_equals_another_reader(spark):
    rng = random.Random(7)
    pages = [random_page(rng) for _ in range(400)]
    assert [ht.extract_text(p, TREE) for p in pages] == [plain_text(p) for p in pages]
    assert len({bool(ht.extract_text(p, TREE)) for p in pages}) == 2


def test_nothing_of_an_article_is_lost_by_its_markup():
    page = (
        f'<article><header class="entry-header"><h1>My Title</h1></header><p class="search">{PROSE}</p><div class="legal">{PROSE}</div>'
        f"<p>{PROSE} <svg/> end</p><p>{PROSE} <button>Share</p><p>tail <math><mi>x</mi></math> of it</p></article>"
    )
    want = ["My Title", PROSE, PROSE, f"{PROSE} end", PROSE, "tail x of it"]
    assert ht.extract_text(page, TREE).split("\n") == want


def test_unmatched_tags_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "</p>" * n, "<button>x" * n, "<svg>x" * n, "<script>" * n, "<p></i>" * n):
            ht.blocks_of(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32_000) < 3


def test_long_pages_take_linear_time():
    page = "<p" * 100_000 + "<div>" * 20_000 + "x" + '="' * 50_000 + "<a href='" * 20_000
    ht.extract_text(page, TREE)
    text = ht.extract_text("<article>" + f"<p>{PROSE}</p>" * 20_000, TREE)
    assert text.count("\n") == 19_999


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for row in ht.extract_main_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", html[row.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text)


def test_table(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", f"<main>{PROSE}", "x"), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract_main_text(pages).collect()
    assert [tuple(r) for r in got] == [(1, None, "", 0), (1, None, "", 0), (None, "u", PROSE, len(PROSE)), (2, "u", "", 0)]
    assert ht.extract_main_text(pages.limit(0)).count() == 0
