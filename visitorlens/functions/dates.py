"""Review-date normalisation as one column expression with an injected ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitorlens.functions.expr import let
from visitorlens.functions.text import strip

# Month abbreviations in calendar order; only three letters are compared.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# The recognised shapes of a lower-cased, trimmed date string.
RELATIVE = r"^(a|an|\d+)\s+(day|week|month|year)s?\s+ago$"
MONTH_DAY_YEAR = r"^([a-z]+)\s+(\d{1,2}),\s*(\d{4})$"
DAY_MONTH_YEAR = r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})$"
MONTH_YEAR = r"^([a-z]+)\s+(\d{4})$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
ISO = r"^\d{4}-\d{2}-\d{2}$"


def shift_months(day: Column, n: Column | int) -> Column:
    """Calendar shift by whole months, clamped to the end of the month."""
    return F.add_months(day, n if isinstance(n, Column) else F.lit(n))


def shift_years(day: Column, n: Column | int) -> Column:
    """Calendar shift by whole years (29 February becomes the 28th)."""
    return F.add_months(day, (n if isinstance(n, Column) else F.lit(n)) * 12)


def _month_number(word: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(word, 1, 3))
    return F.when(position > 0, position)


def _make_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; impossible dates and year 0 give null instead of an error."""
    text = F.format_string(
        "%s-%s-%s", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")
    )
    return F.when((year != "0000") & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _relative_date(text: Column, as_of: Column) -> Column:
    """``3 months ago`` and the like; null when the shift would leave year 1."""
    amount = F.regexp_extract(text, RELATIVE, 1)
    unit = F.regexp_extract(text, RELATIVE, 2)
    n = F.when(amount.isin("a", "an"), F.lit(1)).otherwise(amount.try_cast("int"))
    days_back = F.datediff(as_of, F.lit("0001-01-01").cast("date"))
    months_back = (F.year(as_of) - 1) * 12 + F.month(as_of) - 1
    # The bound is tested before the arithmetic, which would overflow under ANSI rules.
    return (
        F.when((unit == "day") & (n <= days_back), F.date_sub(as_of, n))
        .when((unit == "week") & (n <= F.floor(days_back / 7)), F.date_sub(as_of, n * 7))
        .when((unit == "month") & (n <= months_back), F.add_months(as_of, -n))
        .when((unit == "year") & (n <= F.floor(months_back / 12)), F.add_months(as_of, n * -12))
    )


def parse_review_date(col: Column, as_of: Column) -> Column:
    """Date meant by a review-date label, or null if it is none of the known shapes."""

    def parse(text: Column) -> Column:
        def dated(pattern: str, year: int, month: int, day: int | None) -> Column:
            def part(group: int) -> Column:
                return F.regexp_extract(text, pattern, group)

            number = part(month) if pattern == SLASHED else _month_number(part(month))
            return _make_date(part(year), number, F.lit("1") if day is None else part(day))

        return (
            F.when(text == "", F.lit(None))
            .when(text == "today", as_of)
            .when(text == "yesterday", F.date_sub(as_of, 1))
            .when(text.rlike(RELATIVE), _relative_date(text, as_of))
            .when(text.rlike(MONTH_DAY_YEAR), dated(MONTH_DAY_YEAR, 3, 1, 2))
            .when(text.rlike(DAY_MONTH_YEAR), dated(DAY_MONTH_YEAR, 3, 2, 1))
            .when(text.rlike(MONTH_YEAR), dated(MONTH_YEAR, 2, 1, None))
            .when(text.rlike(SLASHED), dated(SLASHED, 3, 1, 2))
        )

    # Bound once per row: the label is looked at many times.
    return let(F.lower(strip(col)), parse)


def normalize_review_date(col: Column, as_of: Column) -> Column:
    """``YYYY-MM-DD`` where the label can be read, else the trimmed label itself."""
    return F.coalesce(parse_review_date(col, as_of).cast("string"), strip(col))


def iso_to_date(col: Column) -> Column:
    """Date of an ISO string, else null."""
    return F.when(col.rlike(ISO), F.try_to_date(col, "yyyy-MM-dd"))
