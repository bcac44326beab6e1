"""Expressions over page snapshots (URL and HTML text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitorlens.functions.expr import let
from visitorlens.functions.text import strip

# URL parts and phrases (lower case) of consent, CAPTCHA and block pages.
# The bare word "traffic" is deliberately absent: normal map pages contain it.
INTERSTITIAL_URL_PARTS = ["consent.google.com", "google.com/sorry", "/sorry/"]
INTERSTITIAL_PHRASES = [
    "our systems have detected unusual traffic",
    "detected unusual traffic",
    "before you continue to google",
    "to continue, please",
    "recaptcha",
    "i'm not a robot",
    "verify you are a human",
]

# Fixed value: part of the address of a contributor profile.
PROFILE_URL_PART = "contrib"

# Contributor line patterns, e.g. "Local Guide · 1,234 reviews".
LOCAL_GUIDE = "(?i)local guide"
TOTAL_REVIEWS = r"(?i)(\d[\d,]*)\s+reviews?"

# Fixed value: candidates of this length or more are page furniture, not a review.
MAX_FALLBACK_TEXT = 5000

# Elements without content, elements that end an open paragraph, and elements whose stray
# end tag belongs to something that was opened further out.
VOID = "area base br col embed hr img input link meta source track wbr".split()
BLOCKS = (
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul"
).split()
FRAMES = "article aside body div footer form header html li main nav ol section table tbody td tr ul".split()

# A tag, in which quoted values may hold ">", and a tag with the text up to the next one.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = rf"</?[a-zA-Z]{_REST}"
_TOKEN = rf"{TAG}(?:[^<]++|<(?![/a-zA-Z]))*+"
# Attributes before the one that is looked for, and a value in any quotes or none.
_BEFORE = r"""^<[a-zA-Z][^\s/>]*+(?:[^>"'\s]++|\s|"[^"]*+"|'[^']*+')*?\s"""
_VALUE = r"""\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)"""

# The five basic character references; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def is_interstitial(url: Column, html: Column) -> Column:
    """True for a consent, CAPTCHA or blocked page."""
    address, page = F.lower(url), F.lower(html)
    found = F.lit(False)
    for part in INTERSTITIAL_URL_PARTS:
        found = found | F.coalesce(F.contains(address, F.lit(part)), F.lit(False))
    for phrase in INTERSTITIAL_PHRASES:
        found = found | F.coalesce(F.contains(page, F.lit(phrase)), F.lit(False))
    return found


def is_profile_url(url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(url), F.lit(PROFILE_URL_PART)), F.lit(False))


def contributor_is_guide(blob: Column) -> Column:
    return F.coalesce(blob.rlike(LOCAL_GUIDE), F.lit(False))


def contributor_total(blob: Column) -> Column:
    """First review count of a contributor line as digits, ``''`` if there is none."""
    return F.replace(
        F.regexp_extract(F.coalesce(blob, F.lit("")), TOTAL_REVIEWS, 1), F.lit(","), F.lit("")
    )


def inner_text(html: Column) -> Column:
    """Text of an HTML fragment: tags removed, basic entities decoded, trimmed."""
    text = F.regexp_replace(html, f"(?s)<!--.*?-->|{TAG}|<[!?][^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return strip(text)


def _longest(texts: Column) -> Column:
    ranked = F.transform(
        texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))
    )
    return F.array_max(ranked)["t"]


def longest_text(preferred: Column, fallback: Column | None = None) -> Column:
    """Longest of the candidate texts, the first among equals; ``''`` if there is none.

    Only if every preferred candidate is empty, fallback candidates shorter
    than 5,000 characters are considered.
    """

    def trimmed(texts: Column) -> Column:
        return F.transform(texts, strip)

    best = F.coalesce(_longest(trimmed(preferred)), F.lit(""))
    if fallback is None:
        return best
    short = F.filter(trimmed(fallback), lambda t: F.length(t) < MAX_FALLBACK_TEXT)
    return let(
        best,
        lambda b: F.when(b != "", b).otherwise(F.coalesce(_longest(short), F.lit(""))),
    )


def markup_tokens(html: Column) -> Column:
    """Tags with the text behind them: ``array<struct<name, is_end, is_void, at, markup>>``."""

    def token(markup: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(markup, r"^</?([a-zA-Z][^\s/>]*+)", 1))
        empty = F.regexp_extract(markup, f"^{TAG}", 0).endswith("/>")
        return F.struct(
            name.alias("name"),
            F.startswith(markup, F.lit("</")).alias("is_end"),
            (name.isin(*VOID) | empty).alias("is_void"),
            at.alias("at"),
            markup.alias("markup"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), token)


def element_spans(tokens: Column) -> Column:
    """``array<struct<begin, end>>``: positions of the start tag and of what ends the element.

    A fold over the tags with a stack of the open elements, the innermost first. An end
    tag closes the innermost open element of its name and all inside it; a block closes an
    open paragraph; a stray end tag of a frame closes all, other stray ones nothing. What
    is still open at the end ends there. Every element with content has one span.
    """
    open_type = "array<struct<name: string, at: int>>"
    spans_type = "array<struct<begin: int, end: int>>"
    nothing = F.struct(
        F.array().cast(open_type).alias("open"), F.array().cast(spans_type).alias("spans")
    )

    def closed(inner: Column, at: Column) -> Column:
        return F.transform(inner, lambda x: F.struct(x["at"].alias("begin"), at.alias("end")))

    def step(done: Column, tag: Column) -> Column:
        ends_paragraph = ~tag["is_end"] & tag["name"].isin(*BLOCKS)
        wanted = F.when(tag["is_end"], tag["name"]).when(ends_paragraph, "p")
        names = F.transform(done["open"], lambda x: x["name"])
        place = F.coalesce(F.array_position(names, wanted), F.lit(0)).cast("int")
        is_stray = tag["is_end"] & tag["name"].isin(*FRAMES)

        def moved(place: Column) -> Column:
            n = F.when((place == 0) & is_stray, F.size(done["open"])).otherwise(place)
            rest = F.slice(done["open"], n + 1, F.size(done["open"]))
            own = F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("at")))
            is_open = ~tag["is_end"] & ~tag["is_void"]
            return F.struct(
                F.when(is_open, F.concat(own, rest)).otherwise(rest).alias("open"),
                F.when(n == 0, done["spans"])
                .otherwise(F.concat(done["spans"], closed(F.slice(done["open"], F.lit(1), n), tag["at"])))
                .alias("spans"),
            )

        return let(place, moved)

    return F.aggregate(
        tokens,
        nothing,
        step,
        lambda done: F.concat(done["spans"], closed(done["open"], F.size(tokens))),
    )


def markup_inside(tokens: Column, span: Column) -> Column:
    """Markup between the start tag of a span and its end; ``''`` without a span."""
    inside = F.slice(tokens, span["begin"] + 2, F.greatest(span["end"] - span["begin"] - 1, F.lit(0)))
    own = F.regexp_replace(F.get(tokens, span["begin"])["markup"], f"^{TAG}", "")
    return F.coalesce(
        F.concat(own, F.array_join(F.transform(inside, lambda t: t["markup"]), "")), F.lit("")
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the tag that the markup begins with; ``''`` without it."""
    value = F.regexp_extract(tag, f"(?si){_BEFORE}{name}{_VALUE}", 1)
    return inner_text(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?si){_BEFORE}{name}(?=[\s=/>])")


def has_class(tag: Column, names: str) -> Column:
    """Whether the tag that the markup begins with has one of some classes (``a|b``)."""
    return F.concat(F.lit(" "), attribute(tag, "class"), F.lit(" ")).rlike(rf"\s(?:{names})\s")
