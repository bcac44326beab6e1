"""The review table contract shared by every source, operator and sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and order of the stored review table.
REVIEW_COLUMNS = [
    "review_id",
    "reviewer_name",
    "reviewer_total_reviews",
    "is_local_guide",
    "rating",
    "review_date",
    "review_text",
]

# Everything is read as text except the flag: numbers and dates are derived
# with try_cast so that one malformed field never costs the whole row.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField(name, T.BooleanType() if name == "is_local_guide" else T.StringType())
        for name in REVIEW_COLUMNS
    ]
)

# The rating labels that get a column in the keyword report.
RATING_BUCKETS = ["1 star", "2 stars", "3 stars", "4 stars", "5 stars"]


class MissingColumnsError(ValueError):
    """A dataset lacks columns that the review contract requires."""

    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__(f"dataset is missing required columns: {', '.join(missing)}")


def check_columns(df: DataFrame, required: Iterable[str] = REVIEW_COLUMNS) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every required column it lacks.

    Extra columns are accepted and pass through.
    """
    present = set(df.columns)
    missing = [name for name in required if name not in present]
    if missing:
        raise MissingColumnsError(missing)
    return df
