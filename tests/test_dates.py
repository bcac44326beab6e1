import datetime

import pytest
from pyspark.sql import functions as F

from visitorlens.functions.dates import (
    iso_to_date,
    normalize_review_date,
    shift_months,
    shift_years,
)

GOLDEN = [
    ("", "2024-06-15", ""),
    (None, "2024-06-15", ""),
    ("  today ", "2024-06-15", "2024-06-15"),
    ("Yesterday", "2024-03-01", "2024-02-29"),
    ("a year ago", "2024-06-15", "2023-06-15"),
    ("an year ago", "2024-02-29", "2023-02-28"),
    ("2 years ago", "2024-06-15", "2022-06-15"),
    ("a month ago", "2024-03-31", "2024-02-29"),
    ("3 months ago", "2024-05-31", "2024-02-29"),
    ("2 weeks ago", "2024-06-15", "2024-06-01"),
    ("5 days ago", "2024-06-15", "2024-06-10"),
    ("1 days  ago", "2024-06-15", "2024-06-14"),
    ("Jan 2024", "2024-06-15", "2024-01-01"),
    ("January 2024", "2024-06-15", "2024-01-01"),
    ("marvellous 2024", "2024-06-15", "2024-03-01"),
    ("Jan 5, 2024", "2024-06-15", "2024-01-05"),
    ("sept 5,2024", "2024-06-15", "2024-09-05"),
    ("5 Jan 2024", "2024-06-15", "2024-01-05"),
    ("1/5/2024", "2024-06-15", "2024-01-05"),
    ("01/05/2024", "2024-06-15", "2024-01-05"),
    ("13/05/2024", "2024-06-15", "13/05/2024"),
    ("Feb 30, 2024", "2024-06-15", "Feb 30, 2024"),
    ("31 February 2023", "2024-06-15", "31 February 2023"),
    ("Jan 5 2024", "2024-06-15", "Jan 5 2024"),
    ("Xyz 2024", "2024-06-15", "Xyz 2024"),
    ("Jan 0000", "2024-06-15", "Jan 0000"),
    ("2 hours ago", "2024-06-15", "2 hours ago"),
    ("2024-01-05", "2024-06-15", "2024-01-05"),
    ("2023 years ago", "2024-06-15", "0001-06-15"),
    ("2024 years ago", "2024-06-15", "2024 years ago"),
    ("99999999 years ago", "2024-06-15", "99999999 years ago"),
    ("99999999999999 days ago", "2024-06-15", "99999999999999 days ago"),
    ("  odd label ", "2024-06-15", "odd label"),
]


def test_golden(spark):
    rows = [(i, raw, datetime.date.fromisoformat(as_of)) for i, (raw, as_of, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, raw string, as_of date")
    got = {
        r.i: r.o
        for r in df.select(
            "i", normalize_review_date(F.col("raw"), F.col("as_of")).alias("o")
        ).collect()
    }
    assert [(GOLDEN[i][0], got[i]) for i in range(len(GOLDEN))] == [(g[0], g[2]) for g in GOLDEN]


@pytest.mark.parametrize(
    ("day", "months", "expected"),
    [("2024-03-31", -1, "2024-02-29"), ("2024-02-29", -12, "2023-02-28"), ("2024-01-31", 1, "2024-02-29")],
)
def test_shift(spark, day, months, expected):
    d = F.lit(day).cast("date")
    row = spark.range(1).select(
        shift_months(d, months).cast("string").alias("m"), shift_years(d, 1).alias("y")
    )
    assert row.first().m == expected


def test_iso(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("x",), (None,)], "s string")
    got = [r.d for r in df.select(iso_to_date(F.col("s")).alias("d")).collect()]
    assert got == [None, datetime.date(2024, 2, 29), None, None]
