"""Collection progress: counters per pass, running totals, streaks and stop rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitorlens.functions.text import looks_truncated
from visitorlens.operators.reviews import KEY, first_seen, has_content, in_range
from visitorlens.operators.scale import null_safe_join

# Limits of one collection run.
TARGET_REVIEWS = 3000
NO_GROWTH_LIMIT = 35
PAST_CUTOFF_LIMIT = 12
MAX_RUNTIME_SECONDS = 900


def seen_counters(
    reviews: DataFrame,
    cutoff: Column,
    keys: Sequence[str] = KEY,
    venue: str = "venue",
    batch: str = "batch",
) -> DataFrame:
    """One row per venue and pass: rows seen, skipped as too old, empty, cut, oldest date.

    Too-old reviews are counted once per pass and key.
    """
    text = F.coalesce(F.col("review_text"), F.lit(""))
    too_old = F.when(~in_range(cutoff), F.struct(*keys))
    return reviews.groupBy(venue, batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(too_old).alias("n_skipped_old"),
        F.count_if(text == "").alias("n_empty_text"),
        F.count_if(looks_truncated(text)).alias("n_truncated"),
        F.min("review_dt").alias("oldest_date"),
    )


def with_added(
    seen: DataFrame, added: DataFrame, venue: str = "venue", batch: str = "batch"
) -> DataFrame:
    """Adds ``n_added``, the number of rows of ``added`` per venue and pass."""
    counted = added.groupBy(venue, batch).agg(F.count(F.lit(1)).alias("n_added"))
    return null_safe_join(seen, counted, [venue, batch], "left").na.fill(0, ["n_added"])


def batch_counters(
    reviews: DataFrame,
    cutoff: Column,
    keys: Sequence[str] = KEY,
    venue: str = "venue",
    batch: str = "batch",
    order: str = "ingest_seq",
) -> DataFrame:
    """``seen_counters`` plus ``n_added``, for a history whose rows carry their pass.

    A review counts as added in the pass in which its key first arrives in range.
    """
    candidates = reviews.filter(has_content() & in_range(cutoff))
    scope = list(dict.fromkeys([venue, *keys]))
    firsts = first_seen(candidates.select(*scope, batch, order), scope, order)
    return with_added(seen_counters(reviews, cutoff, keys, venue, batch), firsts, venue, batch)


def arrivals(
    events: DataFrame, venue: str, key: str, batch: Column, order: str
) -> DataFrame:
    """``(venue, batch, n_rows, n_added)`` of any keyed arrival stream."""
    tagged = events.select(
        F.col(venue).alias("venue"), F.col(key).alias("_key"), batch.alias("batch"), order
    )
    seen = tagged.groupBy("venue", "batch").agg(F.count(F.lit(1)).alias("n_rows"))
    # The first sighting is an aggregate: it shrinks hot keys before the shuffle.
    first = tagged.groupBy("venue", "_key").agg(F.min_by("batch", order).alias("batch"))
    return with_added(seen, first)


def _passes(venue: str, batch: str):
    # One row per pass: a venue's window is as long as its number of passes.
    return Window.partitionBy(venue).orderBy(batch)


def progress(counters: DataFrame, venue: str = "venue", batch: str = "batch") -> DataFrame:
    """Adds ``total_added`` so far and, if dates are known, the last known ``oldest_seen``."""
    running = _passes(venue, batch).rowsBetween(Window.unboundedPreceding, 0)
    out = counters.withColumn("total_added", F.sum("n_added").over(running))
    if "oldest_date" in counters.columns:
        out = out.withColumn("oldest_seen", F.last("oldest_date", ignorenulls=True).over(running))
    return out


def with_streak(
    passes: DataFrame, hit: Column, name: str, venue: str = "venue", batch: str = "batch"
) -> DataFrame:
    """Adds the number of consecutive passes, up to this one, for which ``hit`` holds."""
    running = _passes(venue, batch).rowsBetween(Window.unboundedPreceding, 0)
    within = (
        Window.partitionBy(venue, "_run")
        .orderBy(batch)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    is_hit = F.coalesce(hit, F.lit(False))
    return (
        passes.withColumn("_run", F.sum(F.when(is_hit, 0).otherwise(1)).over(running))
        .withColumn(name, F.count_if(is_hit).over(within))
        .drop("_run")
    )


def stagnation_streak(
    passes: DataFrame, venue: str = "venue", batch: str = "batch"
) -> DataFrame:
    """Adds ``stagnant``: consecutive passes without a new review; growth resets it."""
    return with_streak(passes, F.col("n_added") == 0, "stagnant", venue, batch)


def stop_reason(
    passes: DataFrame,
    target: int | None = TARGET_REVIEWS,
    no_growth_limit: int = NO_GROWTH_LIMIT,
    cutoff: Column | None = None,
    past_cutoff_limit: int = PAST_CUTOFF_LIMIT,
    max_seconds: int | None = None,
    venue: str = "venue",
    batch: str = "batch",
    already: DataFrame | None = None,
) -> DataFrame:
    """``(venue, batch, total_added, stop_reason)``: the first pass that ends a venue's run.

    Reasons in order of precedence: time, target, cutoff, stagnant. Time needs a
    timestamp ``batch``; the cutoff rule needs ``oldest_seen``. Rows stored before the
    first pass, ``already(venue, n_stored)``, count towards the target. Venues that may
    go on have no row.
    """
    table = stagnation_streak(progress(passes, venue, batch), venue, batch)
    total = F.col("total_added")
    if already is not None:
        table = null_safe_join(table, already.select(venue, "n_stored"), [venue], "left")
        total = total + F.coalesce("n_stored", F.lit(0))
    reason = F.when(F.col("stagnant") >= no_growth_limit, F.lit("stagnant"))
    if cutoff is not None and "oldest_seen" in table.columns:
        beyond = (F.col("oldest_seen") < cutoff) & (F.col("n_added") == 0)
        table = with_streak(table, beyond, "past_cutoff", venue, batch)
        reason = F.when(F.col("past_cutoff") >= past_cutoff_limit, F.lit("cutoff")).otherwise(
            reason
        )
    if target is not None:
        reason = F.when(total >= target, F.lit("target")).otherwise(reason)
    if max_seconds is not None:
        start = F.min(batch).over(Window.partitionBy(venue))
        table = table.withColumn(
            "_elapsed", F.timestamp_diff("SECOND", start, F.col(batch))
        )
        reason = F.when(F.col("_elapsed") > max_seconds, F.lit("time")).otherwise(reason)
    stops = table.withColumn("stop_reason", reason).filter(F.col("stop_reason").isNotNull())
    first = F.min_by(F.struct(batch, "total_added", "stop_reason"), F.col(batch))
    return stops.groupBy(venue).agg(first.alias("_stop")).select(venue, "_stop.*")


def progress_state(
    table: DataFrame, venue: str = "venue", batch: str = "batch"
) -> DataFrame:
    """``(venue, state)``: JSON of the latest pass of every venue."""
    columns = [c for c in table.columns if c != venue]
    latest = table.groupBy(venue).agg(
        F.max_by(F.struct(*columns), F.col(batch)).alias("_latest")
    )
    return latest.select(venue, F.to_json("_latest").alias("state"))
