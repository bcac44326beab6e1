"""Incremental ingestion: each micro-batch adds the reviews the table does not hold yet.

The target table is the deduplication state, so nothing is forgotten and a stopped
run resumes by itself. Appending is idempotent: a batch that is replayed after a
failure finds the rows it already wrote and adds only the missing ones. A null or
empty venue is stored as ``NO_VENUE``, since a partition folder can't tell them apart.

``run_ingestion`` applies the stop rules to the running stream: it ends at the beginning
of the first batch for which every venue seen in the run has a reason to stop. That batch
is not processed, so the next run with the same checkpoint begins with it.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from visitorlens.functions.text import strip
from visitorlens.operators.progress import (
    MAX_RUNTIME_SECONDS,
    NO_GROWTH_LIMIT,
    PAST_CUTOFF_LIMIT,
    TARGET_REVIEWS,
    seen_counters,
    stop_reason,
    with_added,
)
from visitorlens.operators.reviews import cap_per_venue, new_reviews, normalize_reviews
from visitorlens.sources.files import append_reviews, progress_rows, write_progress
from visitorlens.streaming.horizon import first_within

KEYS = ["venue", "review_key"]
NO_VENUE = "(no venue)"
# Up to this many venues of a batch, only their partitions of the target are read.
PRUNED_VENUES = 1_000

STORED_SCHEMA = "review_key string, ingest_batch string, venue string"
PROGRESS_SCHEMA = (
    "venue string, batch long, n_rows long, n_skipped_old long, n_empty_text long, "
    "n_truncated long, oldest_date date, n_added long, run_tag string, run string"
)
TIMING_SCHEMA = "run_tag string, batch long, input_rows long, duration_ms long, updated_at timestamp"


def with_arrival(pages: DataFrame, name: str = "arrival") -> DataFrame:
    """Adds the arrival order of Parquet rows: file time, file path, row position."""
    meta = F.col("_metadata")
    return pages.withColumn(
        name,
        F.struct(
            meta["file_modification_time"].alias("at"),
            meta["file_path"].alias("path"),
            meta["row_index"].alias("row"),
        ),
    )


def checkpoint_location(spark: SparkSession, name: str, default: str | None = None) -> str:
    """Folder ``name`` in the shared checkpoint directory the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or default
    if not root:
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint location")
    return f"{root.rstrip('/')}/{name}"


def stored_rows(spark: SparkSession, target: str) -> DataFrame:
    """Keys of the target table; no rows if it does not exist yet."""
    try:
        # An explicit schema keeps numeric venue names text.
        return spark.read.schema(STORED_SCHEMA).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def with_venue(records: DataFrame) -> DataFrame:
    """``records`` with ``NO_VENUE`` for null, empty and blank venues."""
    named = F.coalesce(F.nullif(strip(F.col("venue")), F.lit("")), F.lit(NO_VENUE))
    return records.withColumn("venue", named)


def _of_same_venues(stored: DataFrame, batch: DataFrame) -> DataFrame:
    venues = [row.venue for row in batch.select("venue").distinct().limit(PRUNED_VENUES + 1).collect()]
    return stored.filter(F.col("venue").isin(venues)) if len(venues) <= PRUNED_VENUES else stored


def ingest_batch(
    batch: DataFrame,
    target: str,
    as_of: Column,
    cutoff: Column,
    tag: str,
    batch_id: int,
    order: str = "ingest_seq",
    prefer: str = "first",
    per_venue: int | None = None,
    progress_path: str | None = None,
    run: str = "",
) -> None:
    """Append the new reviews of one batch of raw records and write its progress rows.

    A batch that is replayed writes its progress again, with the same tag and counts;
    ``progress_rows`` reads the newest of them. A review that is stored stays as it is, so
    ``prefer`` other than ``first`` would only hold within a batch, and is refused.
    """
    if prefer != "first":
        raise ValueError("stored reviews are never replaced: prefer must be 'first' here")
    spark = batch.sparkSession
    # The batch is read and normalised once; everything below works on what is kept.
    reviews = normalize_reviews(with_venue(batch), as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _ingest(spark, reviews, target, cutoff, tag, batch_id, order, per_venue, progress_path, run)
    finally:
        reviews.unpersist()


def _ingest(
    spark: SparkSession,
    reviews: DataFrame,
    target: str,
    cutoff: Column,
    tag: str,
    batch_id: int,
    order: str,
    per_venue: int | None,
    progress_path: str | None,
    run: str,
) -> None:
    stored = _of_same_venues(stored_rows(spark, target), reviews)
    new = new_reviews(reviews, stored, cutoff, KEYS, order)
    if per_venue is not None:
        held = stored.groupBy("venue").agg(F.count(F.lit(1)).alias("n_stored"))
        new = cap_per_venue(new, per_venue, held, order=(order, "review_key"))
    append_reviews(new.withColumn("ingest_batch", F.lit(tag)), target)
    if progress_path is not None:
        # Counted from the table: after the append the batch itself holds nothing new.
        number = F.lit(batch_id).alias("batch")
        written = _of_same_venues(stored_rows(spark, target), reviews)
        added = written.filter(F.col("ingest_batch") == tag).select("venue", number)
        seen = seen_counters(reviews.select("*", number), cutoff, KEYS)
        counted = with_added(seen, added)
        write_progress(counted.withColumns({"run_tag": F.lit(tag), "run": F.lit(run)}), progress_path)


@dataclass(frozen=True)
class StopRules:
    """Limits of one run. Streaks and time begin anew with a run, stored rows count on."""

    target: int | None = TARGET_REVIEWS
    no_growth_limit: int = NO_GROWTH_LIMIT
    past_cutoff_limit: int = PAST_CUTOFF_LIMIT
    max_seconds: float | None = MAX_RUNTIME_SECONDS


class RunStopped(Exception):
    """Raised before a batch is processed, so that it stays for the next run."""


@dataclass
class Run:
    """One run of an ingestion: its name, when it began, and why it was stopped."""

    target: str
    cutoff: Column
    rules: StopRules | None
    progress_path: str | None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    began: float = field(default_factory=time.monotonic)
    reason: str | None = None
    already: DataFrame | None = None

    def stops(self, spark: SparkSession) -> DataFrame:
        """``(venue, batch, total_added, stop_reason)`` of the venues of this run that may stop."""
        schema = spark.createDataFrame([], PROGRESS_SCHEMA).schema
        rows = progress_rows(spark, self.progress_path, schema)
        return stop_reason(
            rows.filter(F.col("run") == self.name),
            self.rules.target,
            self.rules.no_growth_limit,
            self.cutoff,
            self.rules.past_cutoff_limit,
            already=self.already,
        )

    def check(self, spark: SparkSession) -> None:
        """Raises ``RunStopped`` if the run is over; called before each of its batches."""
        if self.rules is None:
            return
        if self.already is None:
            # Rows stored before the run, once; later ones are in its progress.
            held = stored_rows(spark, self.target).groupBy("venue").agg(F.count(F.lit(1)).alias("n_stored"))
            self.already = held.persist(StorageLevel.MEMORY_AND_DISK)
            self.already.count()
            return
        if self.rules.max_seconds is not None and time.monotonic() - self.began > self.rules.max_seconds:
            self.reason = "time"
        else:
            schema = spark.createDataFrame([], PROGRESS_SCHEMA).schema
            rows = progress_rows(spark, self.progress_path, schema).filter(F.col("run") == self.name)
            seen = rows.select("venue").distinct()
            going = seen.join(self.stops(spark), "venue", "left_anti")
            if going.isEmpty() and not seen.isEmpty():
                reasons = self.stops(spark).select("stop_reason").distinct().collect()
                self.reason = ", ".join(sorted(r.stop_reason for r in reasons))
        if self.reason:
            raise RunStopped(self.reason)

    def finish(self) -> None:
        if self.already is not None:
            self.already.unpersist()


class PassTimings(StreamingQueryListener):
    """Input rows and duration of every pass of one query, written as JSON lines.

    The listener only notes what it is told, one entry per pass; the entries are
    written between passes, since a listener must not run jobs of its own.
    """

    def __init__(self, spark: SparkSession, path: str, tag: Callable[[int], str]):
        self.spark, self.path, self.tag = spark, path, tag
        self.query_id: str | None = None
        self.told: dict[int, tuple[int, int]] = {}
        self.written: set[int] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query_id:
            self.note(event.progress)

    def note(self, progress) -> None:
        # A pass without input has no progress rows.
        if progress.numInputRows:
            self.told[progress.batchId] = progress.numInputRows, progress.batchDuration

    def write(self) -> None:
        new = sorted(set(self.told) - self.written)
        if new:
            rows = [(self.tag(batch), batch, *self.told.pop(batch)) for batch in new]
            names = "run_tag string, batch long, input_rows long, duration_ms long"
            write_progress(self.spark.createDataFrame(rows, names), self.path)
            self.written.update(new)

    def complete(self, query: StreamingQuery) -> None:
        """Writes the rest; events come after their pass, so the last may still be missing."""
        for progress in query.recentProgress:
            if progress.batchId not in self.written:
                self.note(progress)
        self.write()


def ingest_stream(
    raw: DataFrame,
    target: str,
    as_of: Column,
    cutoff: Column,
    checkpoint: str | None = None,
    order: str = "ingest_seq",
    prefer: str = "first",
    per_venue: int | None = None,
    progress_path: str | None = None,
    run: Run | None = None,
    horizon: str | None = None,
    timings: PassTimings | None = None,
) -> StreamingQuery:
    """Start ingestion of a stream of raw records (with ``venue`` and an arrival order).

    Runs until the available input is processed. Rows older than ``cutoff`` are
    dropped by a plain filter, not a watermark: the limit is fixed, and rows
    without a readable date are kept.

    With ``horizon`` (such as ``"7 days"``) a state store remembers the keys of so long:
    reviews that arrive again are dropped there and never reach the table. Older ones are
    still found in the table, so the same rows are stored.
    """
    location = checkpoint or checkpoint_location(raw.sparkSession, "ingest")
    tag_of = tagger(location)

    def process(batch: DataFrame, batch_id: int) -> None:
        if timings is not None:
            timings.write()
        if run is not None:
            run.check(batch.sparkSession)
        ingest_batch(
            batch, target, as_of, cutoff, tag_of(batch_id), batch_id, order, prefer, per_venue,
            progress_path, run.name if run is not None else "",
        )

    if horizon is not None:
        raw = first_within(with_venue(raw), as_of, cutoff, horizon, order)
    each: Callable[[DataFrame, int], None] = process
    return (
        raw.writeStream.foreachBatch(each)
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )


def tagger(location: str) -> Callable[[int], str]:
    """Name of a batch: the same if it is replayed, another with another checkpoint."""
    digest = hashlib.sha256(location.encode()).hexdigest()[:12]
    return lambda batch_id: f"{digest}-{batch_id}"


def run_ingestion(
    raw: DataFrame,
    target: str,
    as_of: Column,
    cutoff: Column,
    progress_path: str,
    rules: StopRules | None = None,
    checkpoint: str | None = None,
    timings_path: str | None = None,
    **settings,
) -> str | None:
    """Ingest until the input ends or ``rules`` stop the run; returns the reasons, or None.

    With a target no venue is filled beyond it. Timings of the passes are written beside
    the progress rows, to ``progress_path`` with ``-timings`` behind it unless a path is
    given; ``sources.files.with_timings`` puts them together.
    """
    spark = raw.sparkSession
    location = checkpoint or checkpoint_location(spark, "ingest")
    if rules is not None and rules.target is not None:
        settings.setdefault("per_venue", rules.target)
    run = Run(target, cutoff, rules, progress_path)
    timings = PassTimings(spark, timings_path or f"{progress_path.rstrip('/')}-timings", tagger(location))
    spark.streams.addListener(timings)
    query = None
    try:
        query = ingest_stream(
            raw, target, as_of, cutoff, location, progress_path=progress_path, run=run,
            timings=timings, **settings,
        )
        timings.query_id = str(query.id)
        query.awaitTermination()
    except StreamingQueryException:
        if run.reason is None:
            raise
    finally:
        if query is not None:
            timings.complete(query)
        spark.streams.removeListener(timings)
        run.finish()
    return run.reason
