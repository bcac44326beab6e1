"""Identity of a review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitorlens.functions.text import strip

# Fixed value: characters of the text that take part in the fallback key.
KEY_TEXT_CHARS = 80


def review_key(
    review_id: Column, author: Column, rating: Column, date: Column, text: Column
) -> Column:
    """``id:<id>`` when there is an id, else a digest of author, rating, date and text start.

    Parts are length-prefixed before hashing so that no two different tuples
    can produce the same input. Pass *normalised* fields: then new and stored
    rows of the same review agree.
    """
    rid = strip(review_id)
    opening = F.substring(F.coalesce(text, F.lit("")), 1, KEY_TEXT_CHARS)
    pieces: list[Column] = []
    for part in (strip(author), strip(rating), strip(date), opening):
        pieces += [F.length(part).cast("string"), F.lit(":"), part]
    return F.when(rid != "", F.concat(F.lit("id:"), rid)).otherwise(
        F.concat(F.lit("fb:"), F.sha2(F.concat(*pieces), 256))
    )
