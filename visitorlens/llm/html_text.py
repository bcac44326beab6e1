"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at its block-level tags. A block is described by its words
and link density, those of the block before and after it, and by what its enclosing
elements say of themselves. A decision tree tells main text from the rest; it is trained
on the blocks of the labelled pages below, each time an extraction is set up. What elements
say does not settle it: pages without an article, class names that mislead, lists of links
inside articles and short paragraphs are told by words, links and neighbours.

Defined cases: a null html is an empty one, whose text is empty; white space of any kind
inside a block becomes one space; a line break tag is white space; tags that are never
closed end with the page; end tags without a start are left out; scripts, styles, titles
and comments have no text; buttons, drawings and the like have none either, and end with
the block they stand in if they are never closed; repeated rows stay repeated; an empty table gives no rows;
columns other than the kept ones and the html are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitorlens.llm.common import column_types, map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"""(?P<attributes>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"""
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL,
)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements whose content is not markup: all of it up to the end tag is left out.
RAW = set("script style title textarea noscript iframe".split())
# Elements whose text is not shown as text of the page, and those that can hold their own kind.
HIDDEN = set("template select button svg object canvas audio video datalist".split())
NESTED = {"template", "svg", "object"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = set(
    "html head body article aside header footer nav main section div form fieldset dialog menu"
    " p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote"
    " pre figure figcaption address details summary center hr option".split()
)
# Elements that can't hold another block of their kind: a new one ends them.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"html", "head", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog"}
SIDE_WORDS = set(
    "nav navbar navigation menu sidebar aside footer masthead ad ads advert adverts advertisement"
    " sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal"
    " share sharing social comment comments disqus reply replies respond related recommended"
    " breadcrumb breadcrumbs pagination pager newsletter subscribe signup widget contentinfo"
    " complementary outbrain taboola".split()
)
# Words that name page furniture as well as parts of articles.
DOUBTFUL_WORDS = set(
    "header search legal copyright login toolbar form teaser discussion dialog overlay"
    " subscription more links".split()
)
COMMENT_WORDS = set("comment comments disqus reply replies respond discussion".split())
MAIN_WORDS = set("article post entry story content main body text".split())

FEATURES = [
    "side",  # an enclosing element is a menu, footer, advert or the like
    "doubtful",  # an enclosing element within the article may be furniture by its name
    "main",  # an enclosing element is or calls itself the article
    "page_has_main",  # some element of the page does
    "heading",
    "words",
    "link_density",  # in thousandths
    "words_before",
    "density_before",
    "words_after",
    "density_after",
]


@dataclass
class Block:
    text: str
    linked: int
    side: bool
    doubtful: bool
    main: bool
    heading: bool

    @property
    def words(self) -> int:
        return len(self.text.split())


def hint_words(attributes: str) -> set[str]:
    """Words of class, id and role; names like ``has-sidebar`` speak of the page's layout."""
    found = set()
    for groups in _HINTS.findall(attributes):
        for name in "".join(groups).split():
            if not name.lower().startswith(("has-", "no-", "with-", "without-")):
                found.update(p.lower() for p in _PARTS.findall(name))
    return found


@dataclass(frozen=True)
class Place:
    """An open element and what it and those around it say of themselves."""

    tag: str = ""
    side_tag: bool = False  # by a tag, or as comments
    side_word: bool = False
    doubtful: bool = False
    main: bool = False


class _Reader:
    """Open elements, and the block that is being read."""

    def __init__(self):
        self.open: list[Place] = []
        self.counts: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked, self.in_link, self.hidden = 0, False, False

    def text(self, raw: str) -> None:
        if self.hidden:
            return
        text = unescape(raw)
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text.split())

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            place = self.open[-1] if self.open else Place()
            heading = any(o.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for o in self.open[-2:])
            side = place.side_tag or place.side_word
            self.blocks.append(Block(text, self.linked, side, place.doubtful, place.main, heading))
        self.pieces, self.linked, self.hidden = [], 0, False

    def close(self) -> str:
        tag = self.open.pop().tag
        self.counts[tag] -= 1
        return tag

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.in_link = True
        if tag not in BLOCK_TAGS:
            if tag == "br":
                self.pieces.append(" ")
            return
        self.flush()
        self.in_link = False
        while self.open and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.close()
        if tag in VOID:
            return
        outer = self.open[-1] if self.open else Place()
        words = hint_words(attributes) if tag not in ("html", "body") else set()
        side_word, doubtful, main = outer.side_word, outer.doubtful, outer.main
        if tag in MAIN_TAGS:
            # An article inside a layout element is still the article.
            side_word, doubtful, main = False, False, True
        in_header = tag == "header" and not main
        side_tag = outer.side_tag or tag in SIDE_TAGS or in_header or bool(words & COMMENT_WORDS)
        side_word |= bool(words & SIDE_WORDS)
        doubtful |= bool(words & DOUBTFUL_WORDS)
        main |= bool(words & MAIN_WORDS) and not side_word and not doubtful
        self.open.append(Place(tag, side_tag, side_word, doubtful, main))
        self.counts[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in HIDDEN:
            self.hidden = False
        if tag in BLOCK_TAGS:
            self.flush()
            if self.counts[tag]:
                while self.close() != tag:
                    pass


def blocks_of(html: str | None) -> list[Block]:
    """The page's flat text blocks in page order."""
    html, reader, at = html or "", _Reader(), 0
    never_closed: set[str] = set()
    while True:
        found = _TOKEN.search(html, at)
        if not found:
            reader.text(html[at:])
            reader.flush()
            return reader.blocks
        if found.start() > at:
            reader.text(html[at : found.start()])
        at = found.end()
        tag = (found["name"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            reader.end(tag)
        elif tag in RAW:
            # Everything up to its end tag is left out, whatever it looks like.
            end = None if tag in never_closed else _end_of(html, tag, at, nested=False)
            at = len(html) if end is None else end
            reader.pieces.append(" ")
        elif tag in HIDDEN:
            reader.pieces.append(" ")
            if not found["attributes"].endswith("/"):
                end = None if tag in never_closed else _end_of(html, tag, at, tag in NESTED)
                if end is None:
                    never_closed.add(tag)
                if end:
                    at = end
                else:
                    # Not closed: hidden up to the end of the block it stands in.
                    reader.hidden = True
        else:
            reader.start(tag, found["attributes"])


def _end_of(html: str, tag: str, at: int, nested: bool) -> int | None:
    """Where the end tag of an element ends whose content begins at ``at``.

    None if there is no such end tag any more; 0 if an element that can't hold its own kind is
    followed by another start first, so that the end tag belongs to that.
    """
    depth = 1
    for found in _ENDS[tag].finditer(html, at):
        if found[1]:
            depth -= 1
        elif nested and not found[0].endswith("/>"):
            depth += 1
        elif not nested and tag in HIDDEN:
            return 0
        if depth == 0:
            return found.end()
    return None


_ENDS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW | HIDDEN}


def features_of(blocks: Sequence[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the page stand empty blocks."""
    words = np.array([0, *(b.words for b in blocks), 0])
    linked = np.array([0, *(b.linked for b in blocks), 0])
    density = 1000 * np.minimum(linked, words) // np.maximum(words, 1)
    has_main = any(b.main for b in blocks)
    marks = np.array([[b.side, b.doubtful, b.main, has_main, b.heading] for b in blocks], np.int64)
    around = [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]
    return np.column_stack([marks.reshape(-1, 5), *around])


# A tree is a verdict, or (feature, threshold, tree up to it, tree beyond it).
Tree = bool | tuple


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 10) -> Tree:
    """Decision tree by Gini impurity; of equally good splits the first one is taken."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return bool(share >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for low, high in zip(values, values[1:], strict=False):
            left = rows[:, feature] <= (low + high) / 2
            impurity = sum(
                part.sum() * (p := labels[part].mean()) * (1 - p) for part in (left, ~left)
            )
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, (low + high) / 2, left)
    if best is None:
        return bool(share >= 0.5)
    _, feature, threshold, left = best
    return (
        feature,
        float(threshold),
        fit_tree(rows[left], labels[left], depth - 1),
        fit_tree(rows[~left], labels[~left], depth - 1),
    )


def decide(tree: Tree, row: Sequence[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, up_to, beyond = tree
        tree = up_to if row[feature] <= threshold else beyond
    return tree


_LONG = "The river had risen through the night and by the morning most of the lower fields lay under water, so the road was closed."
_MID = "Two of the three bridges were closed to carts until the evening."
_SHORT = "Nobody was hurt."

# Labelled pages: the blocks that begin with "+" are main text.
LABELLED_PAGES = [
    f"""<html><head><title>t</title></head><body class="has-sidebar"><header><a href=/>Daily News</a></header>
    <nav><ul><li><a href=/a>World</a></li><li><a href=/b>Sport</a></li></ul></nav>
    <article><h1>+Floods in the valley</h1><p>+{_LONG}</p><p>+{_SHORT}</p><p>+Yes.</p>
    <p>+{_LONG} <a href=/x>More on the weather</a>.</p>
    <aside>Also read: the great storm of the century and what it left behind in our towns</aside>
    <p>+{_LONG}</p></article>
    <div class="ad">{_LONG}</div><footer>&copy; Daily News. All rights reserved by the paper and its owners.</footer></body></html>""",
    f"""<body><div class="cookie-notice">We use cookies to make this site better for all of its readers. <a href=/c>Accept</a></div>
    <div>{_LONG}</div><main><div class="menu"><a href=/1>One</a> <a href=/2>Two</a></div>
    <h2>+Results</h2><p>+{_LONG}</p><ul><li>+first</li><li>+second one</li></ul><p>+{_SHORT}</p>
    <form><p>Write your name here to get our letter every week without paying anything at all.</p></form>
    <section id="comments"><p>{_LONG}</p><p>I agree.</p></section></main><p>Contact us</p></body>""",
    f"""<body><div class="sidebar"><p>{_LONG}</p><p>Popular today</p></div>
    <div id="content"><h1>+A plain page</h1><p>+{_LONG}</p><blockquote>+{_SHORT}</blockquote><p>+Ok.</p>
    <p>+<a href=/s>Source of the story</a></p><div class="social-share"><a href=/f>Share</a> this story with your friends</div></div>
    <div class="comments"><div>{_LONG}</div></div><div class="footer">{_SHORT}</div></body>""",
    f"""<table><tr><td><a href=/1>Home</a> <a href=/2>About</a> <a href=/3>Help</a></td></tr>
    <tr><td><h1>+Old layout</h1><p>+{_LONG}</p><p>+{_SHORT}</p><p>+{_LONG}</p></td></tr>
    <tr><td><a href=/4>Imprint</a></td></tr><tr><td><a href=/5>Terms of use of this site</a></td></tr></table>""",
    f"""<p>+{_LONG}</p><p>+{_LONG}</p><p>+{_LONG} {_LONG}</p><p><a href=/n>Next page</a> <a href=/p>Previous page</a></p>""",
    f"""<div><a href=/1>One of the links</a></div><div><a href=/2>Another of the many links on top</a></div>
    <div>+{_LONG}</div><div>+{_LONG} <a href=/k>here</a></div><div><a href=/3>Last</a></div><div>Top</div>""",
    f"""<article class="post"><header><h1>+Title of the post</h1></header><p>+{_LONG}</p>
    <article class="comment"><p>{_LONG}</p></article></article><div class="promo"><p>{_LONG}</p></div>
    <article><p>+{_SHORT}</p></article><div><p>{_SHORT}</p><p>{_LONG}</p></div>""",
    f"""<nav><a href=/1>Home</a></nav><p>{_LONG}</p><article><p>+{_LONG}<p>+{_SHORT}""",
    f"""<article><p>+{_SHORT}</article>""",
    f"""<main><h1>+Only a title</h1></main>""",
    f"""<main><p>+{_LONG}</p><p>+<a href=/1>Read the whole report</a></p></main>""",
    f"""<div>Top</div><div>+{_LONG}</div><div>+{_LONG}""",
    f"""<p>{_SHORT}</p><p>{_LONG}</p><article><p>+{_LONG}</p></article><p>{_LONG}</p>""",
    f"""<h2>The Herald</h2><article><h1>+Snow</h1><p>+{_LONG}</p></article><p>{_SHORT}</p><h3>More stories</h3><p>{_SHORT}</p>""",
    f"""<h1>+Snow</h1><p>+{_LONG}</p><p>+{_SHORT}</p><h2>+More snow</h2><p>+{_LONG}</p><h2>+Even more</h2><p>+{_LONG}</p>""",
    # Names that mislead: what stands in an article as prose is the article.
    f"""<article><header class="entry-header"><h1>+My title</h1></header><p class="search">+{_LONG}</p><div class="legal"><p>+{_LONG}</p></div>
    <div class="search">Search this site</div><p>+{_LONG}</p><div class="teaser">+{_LONG} {_LONG}</div><div class="more-links"><a href=/1>One story</a></div><p>+{_SHORT}</p></article>""",
    f"""<article><div class="toolbar">Print page</div><h2 class="header">+Second part</h2><p class="copyright">+{_LONG}</p><div class="login"><a href=/l>Log in now please</a></div><p>+{_LONG}</p></article>""",
    f"""<div class="search">{_SHORT}</div><p>+{_LONG}</p><div class="legal">{_LONG}</div><p>+{_LONG}</p><p>+{_SHORT}</p><p>+{_LONG}</p>""",
    f"""<article><header class="post-header"><h1>+My title</h1></header><p class="search">+{_MID}</p></article>""",
    f"""<article><p class="legal">+{_MID}</p><p>+{_SHORT}</p><div class="teaser">+{_MID}</div><p>+Yes.</p><p class="legal">+{_LONG} {_MID}</p></article>""",
    f"""<article><div class="search">Search here</div><p>+{_MID}</p><p>+{_SHORT}</p><div class="toolbar">Print page</div><p>+{_SHORT}</p><p>+{_MID}</p><div class="login">Sign in</div></article>""",
    f"""<article><h1>+Title</h1><div class="toolbar">Print or save</div><p class="copyright">+{_MID}</p><p class="legal">+{_MID}</p><p>+{_LONG} {_LONG}</p><div class="search">Find a word</div></article>""",
    f"""<article><p>+{_LONG}</p><header class="header"><h2>+A part</h2></header><p>+{_MID}</p><header><h2>+Another part</h2></header><p>+{_SHORT}</p></article>""",
    f"""<article><h1>+Title</h1><p>+{_LONG}</p><h2>+The second part of it</h2><p>+{_LONG} {_MID}</p><h3>+Third</h3><p>+{_MID}</p><h2>+A last word</h2><p>+{_SHORT}</p></article>""",
    f"""<main><p>+{_LONG} {_LONG}</p><h2>+Heading</h2><p>+{_LONG}</p><h2>+Another</h2><ul><li>+one</li><li>+two of them</li></ul><h2>+The end</h2></main>""",
    f"""<article><p>+So.</p><p>+No.</p><p>+{_MID}</p><p>+Yes, all of it.</p><p>+{_MID} <a href=/r>Report</a></p><p>+{_SHORT}</p></article>""",
    # Lists of links inside an article, beside single links that belong to its text.
    f"""<article><p>+{_LONG}</p><ul><li><a href=/1>Read about the last great storm</a></li><li><a href=/2>What the council said of it</a></li><li><a href=/3>The year in pictures and maps</a></li></ul><p>+{_LONG}</p><p>+<a href=/4>Source of the story</a></p><p>+{_LONG}</p></article>""",
    f"""<article><p>+{_LONG}</p><p><a href=/1>Share on X</a></p><p><a href=/2>Share by mail</a></p><p>+{_LONG}</p><p><a href=/3>Buy now</a></p><p>+{_SHORT}</p><p>+{_LONG}</p></article>""",
    f"""<main><h1>+Harvest</h1><p>+{_LONG}</p><p>+<a href=/4>All of the figures of the harvest</a></p><p>+{_SHORT}</p><div><a href=/5>An older story of ours</a></div><div><a href=/6>Another story from the past year</a></div></main>""",
    # A heading that only announces links is no part of the text.
    f"""<article><h1>+Harbour</h1><p>+{_LONG}</p><h3>Also on this site</h3><ul><li><a href=/1>{_LONG}</a></li><li><a href=/2>The keepers of the lighthouse</a></li></ul><h3>+What comes next</h3><p>+{_LONG}</p></article>""",
    f"""<article><h1>+Harbour</h1><p>+{_LONG}</p><h3>Read on</h3><ul><li><a href=/1>{_LONG}</a></li><li><a href=/2>{_LONG}</a></li></ul><p>+{_LONG}</p></article>""",
    f"""<div><a href=/1>Start</a></div><div>Ask for a table</div><div><a href=/2>Book</a></div><div>Open all day</div><div>+{_LONG}</div><div>+We left.</div><div>+{_LONG}</div>""",
    # Pages without any article: short lines belong to the prose around them, or to the frame.
    f"""<div>Welcome to our pages</div><div><a href=/1>Home</a></div><div><a href=/2>News of the day</a></div><p>+{_LONG}</p><p>+Nobody came.</p><p>+{_LONG}</p><p>+It rained.</p><p>+{_LONG}</p><div><a href=/3>Next</a></div><div>Our office is open daily</div><div><a href=/4>Imprint</a></div>""",
    f"""<div>Today in town</div><div>+{_LONG}</div><div>+He laughed out loud.</div><div>+{_LONG} {_LONG}</div><div><a href=/9>Old</a> <a href=/8>New</a></div><div>All rights are reserved</div>""",
    f"""<div><a href=/1>Home</a></div><div>Telephone and office hours</div><div><a href=/2>Map</a></div><div>+{_LONG}</div><div>+{_LONG}</div>""",
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, labels = [], []
    for page in LABELLED_PAGES:
        blocks = blocks_of(page)
        labels += [b.text.startswith("+") for b in blocks]
        rows.append(features_of(blocks))
    return np.concatenate(rows), np.array(labels)


def extract_text(html: str | None, tree: Tree) -> str:
    blocks = blocks_of(html)
    rows = features_of(blocks).tolist()
    return "\n".join(b.text for b, row in zip(blocks, rows, strict=True) if decide(tree, row))


def extract_main_text(
    pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """``(*keep, text, n_chars)`` for every row of ``pages``, from its whole html."""
    tree = fit_tree(*labelled_table())

    def start() -> Callable:
        return lambda *row: [(*row[:-1], extract_text(row[-1], tree))]

    schema = column_types(pages, keep) + ", text string"
    texts = map_rows(pages.select(*keep, html_col), start, schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
