"""Raw review records to a clean, deduplicated review table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitorlens.functions.dates import iso_to_date, normalize_review_date
from visitorlens.functions.keys import review_key
from visitorlens.functions.text import fix_mojibake, looks_truncated, stars, strip
from visitorlens.operators.scale import (
    is_small,
    null_safe_anti_join,
    null_safe_join,
    salted_join,
    top_per_group,
)
from visitorlens.schema import RATING_BUCKETS, REVIEW_COLUMNS

# Sample size and least number of non-empty texts of the extraction check.
SAMPLE_SIZE = 20
SAMPLE_MIN_NONEMPTY = 3

KEY = ["review_key"]


def _or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def normalize_reviews(raw: DataFrame, as_of: Column) -> DataFrame:
    """Project raw records onto the review contract.

    ``raw`` holds ``id, author, rating, date, text, is_local_guide,
    reviewer_total_reviews`` as extracted; any other column (venue, arrival
    number) is passed through. Adds ``review_dt`` and ``review_key``. ``as_of``
    is the day relative dates refer to, normally the snapshot date.
    """
    raw_columns = {
        "id",
        "author",
        "rating",
        "date",
        "text",
        "is_local_guide",
        "reviewer_total_reviews",
    }
    carried = [c for c in raw.columns if c not in raw_columns]
    contract = raw.select(
        *carried,
        _or_null(strip(F.col("id"))).alias("review_id"),
        _or_null(fix_mojibake(strip(F.col("author")))).alias("reviewer_name"),
        F.replace(strip(F.col("reviewer_total_reviews")), F.lit(","), F.lit(""))
        .try_cast("int")
        .alias("reviewer_total_reviews"),
        F.coalesce(F.col("is_local_guide"), F.lit(False)).alias("is_local_guide"),
        _or_null(strip(F.col("rating"))).alias("rating"),
        _or_null(normalize_review_date(fix_mojibake(strip(F.col("date"))), as_of)).alias(
            "review_date"
        ),
        _or_null(fix_mojibake(strip(F.col("text")))).alias("review_text"),
    )
    return contract.select(*carried, *REVIEW_COLUMNS, *identity_columns())


def identity_columns() -> list[Column]:
    """``review_dt`` and ``review_key`` computed from the contract columns."""
    return [
        iso_to_date(F.col("review_date")).alias("review_dt"),
        review_key(
            F.col("review_id"),
            F.col("reviewer_name"),
            F.col("rating"),
            F.col("review_date"),
            F.col("review_text"),
        ).alias("review_key"),
    ]


def has_content(author: str = "reviewer_name", text: str = "review_text") -> Column:
    """False for records with neither author nor text."""
    return (F.coalesce(F.col(author), F.lit("")) != "") | (
        F.coalesce(F.col(text), F.lit("")) != ""
    )


def in_range(cutoff: Column, date: str = "review_dt") -> Column:
    """Keep dates from ``cutoff`` on, and rows whose date could not be read."""
    return F.col(date).isNull() | (F.col(date) >= cutoff)


def cutoff_filter(reviews: DataFrame, cutoff: Column) -> DataFrame:
    return reviews.filter(in_range(cutoff))


def first_seen(
    reviews: DataFrame,
    keys: Sequence[str] = KEY,
    order: str = "ingest_seq",
    prefer: str = "first",
) -> DataFrame:
    """One row per key: the first to arrive, or with ``prefer='longest'`` the fullest text.

    An aggregate rather than a window, so copies of a hot key are already
    merged inside each map task and never meet in one sort.
    """
    record = F.struct(*[c for c in reviews.columns if c not in keys])
    if prefer == "longest":
        size = F.length(F.coalesce(F.col("review_text"), F.lit("")))
        chosen = F.min_by(record, F.struct(-size, F.col(order).isNull(), F.col(order)))
    elif prefer == "first":
        # Rows without an arrival order come last.
        chosen = F.min_by(record, F.struct(F.col(order).isNull(), F.col(order)))
    else:
        raise ValueError(f"prefer must be 'first' or 'longest', not {prefer!r}")
    picked = reviews.groupBy(*keys).agg(chosen.alias("_row"))
    return picked.select(*keys, "_row.*").select(*reviews.columns)


def stored_keys(stored: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Distinct keys of what is already stored."""
    return stored.select(*keys).distinct()


def new_reviews(
    incoming: DataFrame,
    stored: DataFrame,
    cutoff: Column,
    keys: Sequence[str] = KEY,
    order: str = "ingest_seq",
    prefer: str = "first",
) -> DataFrame:
    """Rows of ``incoming`` to append: in range, not empty, first of their key, not stored.

    Only keys and arrival orders are aggregated and compared with the stored keys, so
    each side of the anti join holds a key at most once and cannot be skewed. Whole rows
    are fetched for the new keys alone, which after the first run are few. Null keys are
    keys like any other.
    """
    candidates = incoming.filter(has_content() & in_range(cutoff))
    firsts = candidates.groupBy(*keys).agg(F.min(order).alias("_first"))
    fresh = null_safe_anti_join(firsts, stored_keys(stored, keys), keys)
    rows = null_safe_join(candidates, fresh, keys)
    if prefer == "first":
        rows = rows.filter(F.col(order).eqNullSafe(F.col("_first")))
    return first_seen(rows.drop("_first"), keys, order, prefer).select(*incoming.columns)


def union_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Append by column name; columns missing on one side become null."""
    return stored.unionByName(new, allowMissingColumns=True)


def cap_per_venue(
    reviews: DataFrame,
    target: int,
    already: DataFrame | None = None,
    venue: str = "venue",
    order: Sequence[str] = ("ingest_seq", "review_key"),
) -> DataFrame:
    """Keep a venue's rows, in arrival order, until it has ``target`` stored rows.

    ``already(venue, n_stored)`` lowers the allowance of venues with stored rows.
    Only the order columns are ranked; the full rows are then compared with the
    venue's last admitted position and are never sorted or shuffled by venue. Of rows
    with that very position as many are kept as there is room for.
    """
    position = F.struct(*[F.col(c) for c in order])
    ranked = top_per_group(
        reviews.select(venue, *order), [venue], [F.col(c) for c in order], target, "_rank"
    )
    if already is not None:
        ranked = (
            null_safe_join(ranked, already.select(venue, "n_stored"), [venue], "left")
            .filter(F.col("_rank") <= F.lit(target) - F.coalesce("n_stored", F.lit(0)))
            .drop("n_stored")
        )
    counted = ranked.groupBy(venue, position.alias("_last")).agg(F.count(F.lit(1)).alias("_room"))
    last = counted.groupBy(venue).agg(
        F.max("_last").alias("_last"), F.max_by("_room", "_last").alias("_room")
    )
    if is_small(last):
        joined = null_safe_join(reviews, F.broadcast(last), [venue])
    else:
        joined = salted_join(reviews, last, [venue])
    before = joined.filter(position < F.col("_last")).select(*reviews.columns)
    tied = joined.filter(position == F.col("_last"))
    turn = Window.partitionBy(venue).orderBy(F.xxhash64(*reviews.columns))
    fitting = tied.withColumn("_turn", F.row_number().over(turn)).filter("_turn <= _room")
    return before.unionByName(fitting.select(*reviews.columns))


def text_quality(reviews: DataFrame, by: Sequence[str] = ("venue",)) -> DataFrame:
    """Row counters: empty, non-empty and cut texts, unread dates, ratings outside the report."""
    text = strip(F.col("review_text"))
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(text == "").alias("n_empty_text"),
        F.count_if(text != "").alias("n_with_text"),
        F.count_if(looks_truncated(F.col("review_text"))).alias("n_truncated"),
        F.count_if(F.col("review_dt").isNull()).alias("n_unparsed_date"),
        F.count_if(~F.coalesce(F.lower("rating").isin(RATING_BUCKETS), F.lit(False))).alias(
            "n_unbucketed_rating"
        ),
        F.round(F.avg(stars(F.col("rating"))), 6).alias("avg_stars"),
    )


def sample_gate(
    reviews: DataFrame,
    by: Sequence[str] = ("venue",),
    order: str = "ingest_seq",
    min_samples: int = SAMPLE_SIZE,
    min_nonempty: int = SAMPLE_MIN_NONEMPTY,
) -> DataFrame:
    """Health check of an extraction: look at the first records of every venue.

    A venue fails only if the sample is complete and almost no record has text.
    """
    sample = top_per_group(
        reviews.select(*by, order, "review_text"), by, [F.col(order)], min_samples
    )
    counted = sample.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sample"),
        F.count_if(strip(F.col("review_text")) != "").alias("n_nonempty"),
    )
    failed = (F.col("n_sample") >= min_samples) & (F.col("n_nonempty") < min_nonempty)
    return counted.withColumn("passed", ~failed)
