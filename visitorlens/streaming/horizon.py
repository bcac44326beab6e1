"""Deduplication of a stream by a state store that forgets keys after a bounded time.

The bounded counterpart of the anti join with the whole table, and put in front of it: a
review that arrived within the horizon before is dropped where the stream is shuffled
anyway, and the table is only asked about the others. Time is the time of the micro-batch:
reviews carry no reliable time of their own, and a watermark on one would drop late rows
unseen. So no row is ever late, unless the driver's clock goes back by the whole horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from visitorlens.operators.reviews import has_content, in_range, normalize_reviews

# Rows travel through the state operator as JSON, which keeps every type and null.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _order_columns(raw: DataFrame, order: str) -> list[Column]:
    """The fields of the arrival order; nulls come last."""
    kind = raw.schema[order].dataType
    fields = [F.col(order)[f] for f in kind.names] if isinstance(kind, StructType) else [F.col(order)]
    return [part for f in fields for part in (f.isNull(), f)]


def first_within(
    raw: DataFrame, as_of: Column, cutoff: Column, horizon: str, order: str = "ingest_seq"
) -> DataFrame:
    """Rows of the stream ``raw`` whose review did not arrive within ``horizon`` before.

    Of a review's rows in one micro-batch the first in ``order`` passes. Only rows that can be
    stored (with content, and not older than ``cutoff``) are compared and remembered;
    the others all pass, to be counted. ``horizon`` is a duration such as ``"7 days"``.
    """
    marks = [f"_order_{i}" for i in range(len(_order_columns(raw, order)))]
    carried = raw.withColumns(dict(zip(marks, _order_columns(raw, order), strict=True)))
    carried = carried.withColumn("_json", F.to_json(F.struct(*raw.columns), JSON))
    carried = carried.withColumn("_now", F.current_timestamp()).withWatermark("_now", horizon)
    keyed = normalize_reviews(carried, as_of).select(
        F.coalesce("venue", F.lit("")).alias("_venue"),
        F.coalesce("review_key", F.lit("")).alias("_key"),
        (has_content() & in_range(cutoff)).alias("_fits"),
        "_json",
        *marks,
        "_now",
        F.unix_millis("_now").alias("_time"),
    )

    def passing(
        key: tuple, rows: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if not key[2]:
            for part in rows:
                yield part[["_json"]]
            return
        first, now = None, 0
        for part in rows:
            now = int(part["_time"].iloc[0])
            best = part.sort_values(marks, kind="stable").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(marks, kind="stable").head(1)
        if not state.exists and first is not None:
            yield first[["_json"]]
        state.update((True,))
        # The watermark is a horizon behind the clock: it passes now a horizon later.
        state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs() + 1))

    kept = keyed.groupBy("_venue", "_key", "_fits").applyInPandasWithState(
        passing, "_json string", "seen boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.select(F.from_json("_json", raw.schema, JSON).alias("_row")).select("_row.*")
