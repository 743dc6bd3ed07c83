from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens import functions as X

NOW = datetime(1999, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ts(value):
    return F.lit(value.isoformat(sep=" ") if value else None).cast("timestamp")


@pytest.mark.parametrize(
    "seconds, text",
    [
        (0, "00:00:00"),
        (None, "00:00:00"),
        (59, "00:00:59"),
        (60, "00:01:00"),
        (3600, "01:00:00"),
        (359_999, "99:59:59"),
        (400_000, "111:06:40"),
        (2**31 * 3600, "2147483648:00:00"),
    ],
)
def test_time_spent(spark, seconds, text):
    assert one(spark, X.time_spent_text(F.lit(seconds).cast("bigint"))) == text


def test_dates(spark):
    assert one(spark, X.date_text(ts(datetime(2024, 1, 5, 23)))) == "05 Jan, 2024"
    assert one(spark, X.date_text(ts(None))) is None
    for text, shown in [
        ("2024-01-05 00:00:00+00", "05 Jan, 2024"),
        ("2024-01-05 23:00:00", "05 Jan, 2024"),
        ("", None),
        (None, None),
        ("not a date", None),
    ]:
        assert one(spark, X.date_text_of_string(F.lit(text).cast("string"))) == shown


@pytest.mark.parametrize(
    "micros, text",
    [
        (0, "2024-01-05 00:00:00+00"),
        (250_000, "2024-01-05 00:00:00.250+00"),
        (250_001, "2024-01-05 00:00:00.250001+00"),
    ],
)
def test_timestamp_text(spark, micros, text):
    moment = datetime(2024, 1, 5) + timedelta(microseconds=micros)
    assert one(spark, X.timestamp_text(ts(moment))) == text


@pytest.mark.parametrize(
    "weeks, days, text",
    [
        (0, 0, "0 weeks"),
        (1, 0, "1 week"),
        (2, 0, "2 weeks"),
        (0, 1, "1 day"),
        (0, 3, "3 days"),
        (1, 1, "1 week 1 day"),
        (2, 3, "2 weeks 3 days"),
    ],
)
def test_span(spark, weeks, days, text):
    assert one(spark, X.span_text(F.lit(weeks), F.lit(days))) == text


def days(n):
    return NOW + timedelta(days=n)


@pytest.mark.parametrize(
    "start, end, elapsed, remaining",
    [
        (days(-20), days(-6), 100.0, "0 weeks of total 2 weeks"),
        (days(-10), days(20), 33.3, "2 weeks 6 days of total 4 weeks 2 days"),
        (days(10), days(20), -100.0, "2 weeks 6 days of total 1 week 3 days"),
        (days(5), days(5), 0.0, "5 days of total 0 weeks"),
        (days(-5), days(-5), 100.0, "0 weeks of total 0 weeks"),
        (days(-7), NOW, 100.0, "0 weeks of total 1 week"),
        (NOW - timedelta(hours=1), days(1), 0.0, "1 day of total 1 day"),
        (NOW + timedelta(hours=1), days(2), -100.0, "2 days of total 1 day"),
    ],
)
def test_schedule(spark, start, end, elapsed, remaining):
    found = one(spark, X.schedule(ts(start), ts(end), NOW))
    assert found.asDict() == {
        "start": start.strftime("%d %b, %Y"),
        "end": end.strftime("%d %b, %Y"),
        "time_elapsed": elapsed,
        "remaining_time": remaining,
    }


def test_schedule_needs_both_ends(spark):
    assert one(spark, X.schedule(ts(NOW), ts(None), NOW)) is None
    assert one(spark, X.schedule(ts(None), ts(NOW), NOW)) is None


def test_clock_forms_agree(spark):
    forms = [NOW, "1999-01-01 00:00:00", "1999-01-01T01:00:00+01:00", ts(NOW)]
    assert {one(spark, F.unix_micros(X.moment(f))) for f in forms} == {915148800000000}


def by_decimal(x, places):
    six = Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    return float(six.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=200, max_size=400))
def test_rounding_equals_decimal_rounding(spark, values):
    # Beyond nine digits a double cannot tell the sixth decimal apart, so scale down as well.
    values = values + [v / 1e4 for v in values] + [0.005, -0.005, 2.675, 1.005, 0.0, -0.001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sql = "cast(round(cast(v as decimal(18,6)), 2) as double)"
    got = df.select("v", X.rounded(F.col("v")).alias("r"), F.expr(sql).alias("d")).collect()
    for row in got:
        # -0.0 and 0.0 are the same number but not the same text.
        assert str(row.r) == str(row.d) == str(by_decimal(row.v, 2) + 0.0), row


def test_rounding_next_to_ties(spark):
    df = spark.range(-40_000, 40_000).select((F.col("id") / 100 + 0.0049995).alias("v"))
    want = F.expr("cast(round(cast(v as decimal(18,6)), 2) as double)")
    assert df.where(X.rounded(F.col("v")) != want).count() == 0


def test_rounding_keeps_null(spark):
    assert one(spark, X.rounded(F.lit(None).cast("double"))) is None
    for odd in ("nan", "inf", "-inf"):
        assert one(spark, X.rounded(F.lit(float(odd)))) is None
    assert one(spark, X.rounded(F.lit(9.3e12))) == 9.3e12


def test_texts_do_not_depend_on_the_session_zone(spark):
    stamp = F.timestamp_micros(F.lit(1704412800123000).cast("bigint"))
    forms = [
        X.timestamp_text(stamp),
        X.date_text(stamp),
        X.date_text_of_string(F.lit("2024-01-05 00:00:00+00")),
        X.date_text_of_string(F.lit("2024-01-05 00:00:00")),
        X.date_text_of_string(F.lit("2024-01-05")),
        X.date_text_of_string(F.lit("2024-01-05 03:00:00+05:00")),
        F.unix_micros(X.moment("2024-01-05")).cast("string"),
    ]
    want = ["2024-01-05 00:00:00.123+00", *["05 Jan, 2024"] * 5, "1704412800000000"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [one(spark, f) for f in forms] == want, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


SPELLINGS = [
    "2024-01-05", "2024-1-5", "2024/01/05", "2024.01.05", "20240105", "20240105T101500", "20240105 1015",
    "2024-01-05T10:15:00Z", "2024-01-05T23:59:59.999-11:00", "2024-01-05 00:00:00+00", "2024-01-05 03:00:00+05:00",
    "2024-01-05 03:00 UTC", "2024-01-05, 3:00 pm", "2024-01-05 11PM",
    "01/05/2024", "1/5/24", "13/01/2024", "25.12.1998", "12-25-99", "01/13/2024 08:30",
    "05 Jan 2024", "5 January, 2024", "5th of January 2024", "5-Jan-24", "05Jan2024", "Jan 5, 2024", "january 5th 2024",
    "Sept 3 2021", "2024 Jan 5", "2024-Jan-05", "Friday, January 5, 2024 10:00 PM", "Fri, 05 Jan 2024 10:00:00 GMT",
    "  05   May  2020 ", "29 Feb 2024",
    "30 Feb 2024", "2024-13-05", "2024-01-05 25:00", "hello", "13/13/2024", "2024-01-05 garbage here",
]


def test_dates_are_read_as_the_source_reads_them(spark):
    from dateutil import parser

    def read(text):
        try:
            return parser.parse(text).strftime("%d %b, %Y")
        except (ValueError, TypeError):
            return None

    df = spark.createDataFrame([(t,) for t in [*SPELLINGS, "", None]], "t string")
    got = {r[0]: r[1] for r in df.select("t", X.date_text_of_string(F.col("t"))).collect()}
    assert got.pop("") is None and got.pop(None) is None
    assert got == {t: read(t) for t in SPELLINGS}


def test_floor_div(spark):
    for value in (-8, -7, -1, 0, 6, 7, 250_000_000_000_000_001):
        assert one(spark, X.floor_div(F.lit(value).cast("bigint"), 7)) == value // 7
