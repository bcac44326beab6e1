"""Page snapshots to raw review records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitorlens.functions.expr import let
from visitorlens.functions.html import (
    TAG,
    attribute,
    contributor_is_guide,
    contributor_total,
    element_spans,
    has_attribute,
    has_class,
    inner_text,
    is_interstitial,
    longest_text,
    markup_inside,
    markup_tokens,
)

# Names in the markup of review cards.
CARD_STARTS = [
    r"<[a-zA-Z][^>]*\sdata-review-id\s*=",
    r"""<div\b[^>]*\sclass\s*=\s*["']?[^"'>]*\bjftiEf\b""",
]
AUTHOR, DATE, RATING = "d4r55", "rsqaWe", "kvMY7b|kvMYJc"
TEXT_CLASS, TEXT_FRAME, TEXT_SECTION = "wiI7pd", "MyEned", "data-expandable-section"
ID_ATTRIBUTE, RATING_ATTRIBUTE = "data-review-id", "aria-label"

# A line that says something of the contributor.
ABOUT_CONTRIBUTOR = r"(?i)local guide|\breviews?\b"
# Fixed value: so many elements of a card are looked at for it.
MAX_ABOUT_ELEMENTS = 80


def open_pages(pages: DataFrame) -> DataFrame:
    """Pages that are not consent, CAPTCHA or block screens."""
    return pages.filter(~is_interstitial(F.col("url"), F.col("html")))


def _pieces(html: Column, start: str) -> Column:
    """The page cut at every card start; what stands before the first is left out.

    A start with the id of the piece before belongs to the same card.
    """
    cut = F.filter(F.split(html, f"(?={start})"), lambda piece: piece.rlike(f"(?s)^{start}"))

    def merged(pieces: Column, ids: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(0), F.size(pieces)),
            lambda i: (i == F.size(pieces))
            | (F.get(ids, i) == "")
            | ~F.get(ids, i).eqNullSafe(F.get(ids, i - 1)),
        )
        return let(
            begins,
            lambda at: F.transform(
                F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))),
                lambda begin, k: F.array_join(
                    F.slice(pieces, begin + 1, F.get(at, k + 1) - begin), ""
                ),
            ),
        )

    def with_ids(pieces: Column) -> Column:
        ids = F.transform(pieces, lambda piece: attribute(piece, ID_ATTRIBUTE))
        return let(ids, lambda known: merged(pieces, known))

    return let(cut, with_ids)


def _first_span(tokens: Column, spans: Column, wanted: Callable[[Column], Column]) -> Column:
    """Span of the first element, in the order of the page, whose start tag is wanted."""
    found = F.filter(spans, lambda s: wanted(F.get(tokens, s["begin"])))
    return F.array_min(found)


def _spaced_text(markup: Column) -> Column:
    return F.regexp_replace(inner_text(F.regexp_replace(markup, "<", " <")), r"\s+", " ")


def extract_cards(
    pages: DataFrame,
    card_starts: Sequence[str] = CARD_STARTS,
    text_patterns: Sequence[str] = (),
) -> DataFrame:
    """``(page_id, url, pos, id, author, rating, date, text, is_local_guide,
    reviewer_total_reviews)`` per card.

    A card is the element that begins at its start, up to the next card; the first pattern
    of ``card_starts`` that finds any decides. Elements end where their markup is balanced,
    so nested elements belong to them. The text is the longest of the text elements, or
    else of the other spans and divisions below 5,000 characters. ``text_patterns`` (with
    one group) are further text elements. What is said in the division around the author's
    name counts before other lines about the contributor. All native: the cards are cut
    out inside the row and exploded; a page without cards gives no rows.
    """
    page = F.regexp_replace(
        F.coalesce("html", F.lit("")), "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->", ""
    )

    def cards_of(html: Column) -> Column:
        chosen = F.lit(None)
        for start in reversed(card_starts):
            chosen = F.when(html.rlike(f"(?s){start}"), _pieces(html, start)).otherwise(chosen)
        return chosen

    cut = pages.select("page_id", "url", F.posexplode(let(page, cards_of)).alias("pos", "_piece"))
    cut = cut.select("page_id", "url", "pos", markup_tokens(F.col("_piece")).alias("_all"))
    cut = cut.withColumn("_spans", element_spans(F.col("_all")))
    # The card's own span begins at 0; the rest of the piece stands outside.
    own = F.coalesce(F.array_min("_spans")["end"], F.lit(0))
    cut = cut.withColumn("_end", own)
    end_tag = F.regexp_extract(F.get("_all", F.col("_end"))["markup"], f"^{TAG}", 0)
    cut = cut.select(
        "page_id",
        "url",
        "pos",
        F.slice("_all", F.lit(1), F.col("_end")).alias("_tokens"),
        F.filter("_spans", lambda s: (s["begin"] < F.col("_end")) & (s["begin"] > 0)).alias("_spans"),
        F.coalesce(end_tag, F.lit("")).alias("_end_tag"),
    )
    tokens, spans = F.col("_tokens"), F.col("_spans")

    def first(wanted: Callable[[Column], Column]) -> Column:
        return _first_span(tokens, spans, wanted)

    def of_class(names: str) -> Callable[[Column], Column]:
        return lambda t: has_class(t["markup"], names)

    def is_name(token: Column, *names: str) -> Column:
        return token["name"].isin(*names)

    def inside(outer: Column, wanted: Callable[[Column], Column]) -> Column:
        within = F.filter(spans, lambda s: (s["begin"] > outer["begin"]) & (s["begin"] < outer["end"]))
        return _first_span(tokens, within, wanted)

    found = cut.withColumns(
        {
            "_author": first(of_class(AUTHOR)),
            "_date": first(of_class(DATE)),
            "_text": first(of_class(TEXT_CLASS)),
            "_frame": first(of_class(TEXT_FRAME)),
            "_section": first(lambda t: has_attribute(t["markup"], TEXT_SECTION)),
        }
    )
    rated = F.filter(tokens, lambda t: ~t["is_end"] & has_class(t["markup"], RATING))
    # The author's element itself if it is a division, else the innermost around it.
    around = F.array_max(
        F.filter(
            spans,
            lambda s: (s["begin"] <= F.col("_author.begin"))
            & (s["end"] >= F.col("_author.end"))
            & is_name(F.get(tokens, s["begin"]), "div"),
        )
    )
    in_order = F.array_sort(spans)
    likely = F.filter(in_order, lambda s: is_name(F.get(tokens, s["begin"]), "button", "span", "div"))
    lines = F.transform(
        F.slice(likely, 1, MAX_ABOUT_ELEMENTS), lambda s: _spaced_text(markup_inside(tokens, s))
    )
    about = F.array_join(F.filter(lines, lambda t: t.rlike(ABOUT_CONTRIBUTOR)), " ")
    others = F.filter(in_order, lambda s: is_name(F.get(tokens, s["begin"]), "span", "div"))
    card = F.concat(F.array_join(F.transform(tokens, lambda t: t["markup"]), ""), "_end_tag")
    shown = [
        markup_inside(tokens, F.col("_text")),
        markup_inside(tokens, inside(F.col("_frame"), lambda t: is_name(t, "span"))),
        markup_inside(tokens, F.col("_section")),
        *[F.regexp_extract(card, p, 1) for p in text_patterns],
    ]
    near = F.coalesce(_spaced_text(markup_inside(tokens, around)), F.lit(""))
    parts = found.select(
        "page_id",
        "url",
        "pos",
        F.coalesce(attribute(F.get(tokens, F.lit(0))["markup"], ID_ATTRIBUTE), F.lit("")).alias("id"),
        inner_text(markup_inside(tokens, F.col("_author"))).alias("author"),
        F.coalesce(attribute(F.get(rated, F.lit(0))["markup"], RATING_ATTRIBUTE), F.lit("")).alias("rating"),
        inner_text(markup_inside(tokens, F.col("_date"))).alias("date"),
        longest_text(
            F.array(*[inner_text(t) for t in shown]),
            F.transform(others, lambda s: inner_text(markup_inside(tokens, s))),
        ).alias("text"),
        F.concat_ws(" ", near, about).alias("_about"),
    )
    return parts.select(
        *parts.columns[:-1],
        contributor_is_guide(F.col("_about")).alias("is_local_guide"),
        contributor_total(F.col("_about")).alias("reviewer_total_reviews"),
    )
