"""Column functions: rounding and the text formats of the reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

#: Tables may be stored in folders by this hash of their programme, so that one programme's rows are in one folder.
BUCKET = "programme_bucket"
BUCKETS = 256


def bucket_of(programme: Column) -> Column:
    return F.pmod(F.xxhash64(programme), F.lit(BUCKETS)).cast("int")


def moment(as_of: datetime | str | Column) -> Column:
    """The report clock as a TIMESTAMP column.  A moment without a zone is in UTC."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    when = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    when = when.replace(tzinfo=UTC) if when.tzinfo is None else when
    return F.lit(when.isoformat(sep=" ")).cast("timestamp")


def rounded(value: Column, places: int = 2) -> Column:
    """Round half away from zero, after settling the value to six decimals.

    The six decimals make the result the same on any engine.  What is not a finite number, or has more than
    32 digits before the point, gives null.
    """
    settled = value.cast("double").try_cast("decimal(38,6)")
    return F.round(settled, places).cast("double")


def floor_div(value: Column, divisor: int) -> Column:
    """Integer division rounding towards minus infinity (plain ``div`` truncates)."""
    divisor = F.lit(divisor)
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def _utc_date(ts: Column) -> Column:
    """The day of a moment in UTC, whatever the session's zone."""
    return F.date_from_unix_date(floor_div(F.unix_micros(ts), MICROS_PER_DAY).cast("int"))


def timestamp_text(ts: Column) -> Column:
    """``2024-01-05 00:00:00+00``; a fraction is shown with 3 or 6 digits only if there is one."""
    micros = F.pmod(F.unix_micros(ts), F.lit(MICROS_PER_DAY))
    seconds = floor_div(micros, 1_000_000)
    fraction = F.pmod(micros, F.lit(1_000_000))

    def digits(n: Column, width: int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    return F.concat(
        _utc_date(ts).cast("string"),
        F.lit(" "),
        digits(floor_div(seconds, 3600), 2),
        F.lit(":"),
        digits(floor_div(F.pmod(seconds, F.lit(3600)), 60), 2),
        F.lit(":"),
        digits(F.pmod(seconds, F.lit(60)), 2),
        F.when(fraction == 0, "")
        .when(fraction % 1000 == 0, F.concat(F.lit("."), digits(floor_div(fraction, 1000), 3)))
        .otherwise(F.concat(F.lit("."), digits(fraction, 6))),
        F.lit("+00"),
    )


def date_text(ts: Column) -> Column:
    """``05 Jan, 2024`` in UTC; null stays null."""
    return F.date_format(_utc_date(ts), "dd MMM, yyyy")


# The spellings of a date, tried in order, with the places of year, month and day among the groups.
# Of two numbers that may both be the month, the first one is, unless it is beyond 12.
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_SPELLINGS = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(0?[1-9]|1[0-2])[-/.](\d{1,2})[-/.](\d{4}|\d{2})", (3, 1, 2)),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", (3, 2, 1)),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?(?: of)?[-/ ,.]*{_MONTH}[-/ ,.]*(\d{{4}}|\d{{2}})", (3, 2, 1)),
    (rf"{_MONTH}[-/ ,.]*(\d{{1,2}})(?:st|nd|rd|th)?[-/ ,.]+(\d{{4}}|\d{{2}})", (3, 1, 2)),
    (rf"(\d{{4}})[-/ ,.]*{_MONTH}[-/ ,.]*(\d{{1,2}})", (1, 2, 3)),
)
_WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[ ,.]+)?"
_HOUR = r"(?:[01]?\d|2[0-3])"
_CLOCK = rf"(?:{_HOUR}:[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|{_HOUR}[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?|(?:0?\d|1[0-2])(?= ?[ap]\.?m))"
_ZONE = r"(?: ?(?:z|[a-z]{3,5}|[+-]\d{1,2}(?::?\d{2})?|(?:utc|gmt)[+-]\d{1,2}))?(?: ?\([a-z ]+\))?"
_REST = rf"(?:(?:t| at | |, ){_CLOCK}(?: ?[ap]\.?m\.?)?{_ZONE})?"

#: Years of two digits lie in the hundred years that begin here.
CENTURY = 1976


def date_of_string(text: Column) -> Column:
    """The day that a text names, null if it can't be read.

    It is the text's own day, whatever its time and zone.  Years first, all digits, months or days first, and names of
    months and weekdays are read, with or without a time; a month without a day is not.
    """
    said = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    found = F.lit(None).cast("date")
    for spelling, (year, month, day) in reversed(_SPELLINGS):
        pattern = f"^{_WEEKDAY}{spelling}{_REST}$"
        parts = [F.regexp_extract(said, pattern, k) for k in (year, month, day)]
        number = F.when(parts[1].rlike("[a-z]"), F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.left(parts[1], F.lit(3))) + 2) / 3))
        number = number.otherwise(parts[1].try_cast("int")).cast("string")
        short = parts[0].try_cast("int")
        whole = F.when(F.length(parts[0]) == 2, F.lit(CENTURY) + F.pmod(short - CENTURY, F.lit(100))).otherwise(short)
        this = F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), number, parts[2]).try_cast("date")
        found = F.when(said.rlike(pattern), this).otherwise(found)
    return found


def date_text_of_string(text: Column) -> Column:
    """:func:`date_text` for a text column, as :func:`date_of_string` reads it; else null."""
    return F.date_format(date_of_string(text), "dd MMM, yyyy")


def time_spent_text(seconds: Column) -> Column:
    """``HH:MM:SS`` with as many hour digits as needed; null counts as no time."""
    seconds = zero_if_null(seconds)
    hours = floor_div(seconds, 3600)

    def padded(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return F.concat_ws(
        ":",
        # Padding would cut longer texts, so only single digits are padded.
        F.when(hours.between(0, 9), padded(hours)).otherwise(hours.cast("string")),
        padded(floor_div(F.pmod(seconds, F.lit(3600)), 60)),
        padded(F.pmod(seconds, F.lit(60))),
    )


def span_text(weeks: Column, days: Column) -> Column:
    """``2 weeks 3 days``; a zero part is left out, and nothing at all reads ``0 weeks``."""

    def counted(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))

    return (
        F.when(days == 0, counted(weeks, "week"))
        .when(weeks == 0, counted(days, "day"))
        .otherwise(F.concat_ws(" ", counted(weeks, "week"), counted(days, "day")))
    )


def schedule(start: Column, end: Column, as_of: datetime | str | Column) -> Column:
    """Duration struct of an offering: dates, percent elapsed at ``as_of`` and time remaining.

    Whole days are floored, so before the start the percentage is negative and the remaining time
    exceeds the total.
    """
    start_us, end_us, now_us = (F.unix_micros(c) for c in (start, end, moment(as_of)))
    ended = now_us > end_us
    total_days = floor_div(end_us - start_us, MICROS_PER_DAY)
    elapsed_days = floor_div(now_us - start_us, MICROS_PER_DAY)
    left_days = F.when(ended, F.lit(0)).otherwise(floor_div(end_us - now_us, MICROS_PER_DAY))

    def in_weeks(days: Column) -> Column:
        return span_text(floor_div(days, 7), F.pmod(days, F.lit(7)))

    elapsed = (
        F.when(ended, F.lit(100.0))
        .when(total_days <= 0, F.lit(0.0))
        .otherwise(rounded(F.try_divide(elapsed_days, total_days) * 100, 1))
    )
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.struct(
            date_text(start).alias("start"),
            date_text(end).alias("end"),
            elapsed.alias("time_elapsed"),
            F.concat(in_weeks(left_days), F.lit(" of total "), in_weeks(total_days)).alias(
                "remaining_time"
            ),
        ),
    )
