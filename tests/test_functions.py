import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedloom.functions import feedback, text, time


def one(spark, column, **values):
    df = spark.range(1)
    for name, (value, kind) in values.items():
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "at, start, end",
    [
        ("2024-01-08 23:59:59", "2024-01-02", "2024-01-07"),  # Monday lies after its own label
        ("2024-01-09 00:00:00", "2024-01-09", "2024-01-14"),
        ("2024-01-14 12:00:00", "2024-01-09", "2024-01-14"),
        ("2024-01-01 00:00:00", "2023-12-26", "2023-12-31"),
    ],
)
def test_week_labels(spark, at, start, end):
    value = {"t": (at, "timestamp")}
    assert one(spark, time.week_start(F.col("t")), **value) == dt.date.fromisoformat(start)
    assert one(spark, time.week_end(F.col("t")), **value) == dt.date.fromisoformat(end)
    window = one(spark, time.weekly_window(F.col("t"))["start"].cast("date"), **value)
    assert window == dt.date.fromisoformat(start)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Beirut", "Pacific/Kiritimati", "UTC"])
def test_weeks_are_the_same_in_every_zone(spark, zone):
    """Batch and window agree, across changes of the clock too, before and after 1970."""
    hours = spark.range(-30 * 366 * 4, 60 * 366 * 4).select(F.timestamp_seconds(F.col("id") * 21_599).alias("t"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        named = hours.select(
            "t", time.week_start(F.col("t")).alias("week"), time.week_end(F.col("t")).alias("end"),
            time.week_bucket(F.col("t")).alias("bucket"), time.weekly_window(F.col("t")).alias("w"),
        )
        day = F.unix_date("week")
        wrong = (
            (time.window_week(F.col("w")) != F.col("week"))
            | (F.unix_seconds("w.start") != day * 86_400)
            | (F.unix_seconds("bucket") != (day - 1) * 86_400)
            | (F.unix_date("end") != day + 5)
            | (F.dayofweek("week") != 3)
        )
        assert named.count() == 131_760 and named.filter(wrong).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "ts, valid",
    [("1704067200.000123", True), ("-5", True), ("12abc", False), ("abc", False), ("", False), (None, False), ("9e13", False)],
)
def test_valid_ts(spark, ts, valid):
    assert one(spark, time.is_valid_ts(F.col("t")), t=(ts, "string")) is valid


def test_ts_keeps_microseconds(spark):
    value = {"t": ("1704067200.000123", "string")}
    assert one(spark, F.unix_micros(time.ts_to_timestamp(F.col("t"))), **value) == 1704067200000123
    assert one(spark, time.iso_text(F.col("t")), **value) == "2024-01-01T00:00:00.000Z"


def test_date_formats(spark):
    value = {"t": ("2024-01-09 15:04:05", "timestamp")}
    assert one(spark, time.fmt_date(F.col("t")), **value) == "Jan 09"
    assert one(spark, time.fmt_date(F.col("t"), "MM-dd-yyyy hh:mma"), **value) == "01-09-2024 03:04PM"
    assert one(spark, time.iso_date(F.col("s")), s=("2024-01-09T00:00:00.000Z", "string")) == "2024-01-09"


def test_prefix_is_stripped_once_and_only_at_the_start(spark):
    def strip(s):
        return one(spark, text.strip_prefix(F.col("s")), s=(s, "string"))

    assert strip("Anonymous feedback: hi") == "hi"
    assert strip("Anonymous feedback: Anonymous feedback: hi") == "Anonymous feedback: hi"
    assert strip(" Anonymous feedback: hi") == " Anonymous feedback: hi"
    assert strip("Anonymous feedback: ") == ""
    assert strip(None) is None


def test_weight_prints_without_rounding_noise(spark):
    weight = feedback.engagement_weight(F.lit(0), F.lit(7)).cast("string")
    assert one(spark, weight) == "1.7"
    assert one(spark, feedback.engagement_weight(F.lit(None), F.lit(None)).cast("string")) == "1.0"
    assert one(spark, feedback.engagement_weight(F.lit(2), F.lit(0), w_reply=Decimal("0.25")).cast("string")) == "1.50"


def test_weighted_text_is_null_if_a_part_is(spark):
    assert one(spark, text.weighted_text(F.lit("a"), F.lit(Decimal("1.5")))) == "a (weight: 1.5)"
    assert one(spark, text.weighted_text(F.lit(None).cast("string"), F.lit(1))) is None


@pytest.mark.parametrize(
    "score, kept, category",
    [(0.10, True, "positive"), (-0.10, True, "negative"), (0.0999, False, "negative"), (-0.0999, False, "negative")],
)
def test_sentiment_band(spark, score, kept, category):
    value = {"s": (score, "double")}
    assert one(spark, feedback.is_opinionated(F.col("s")), **value) is kept
    assert one(spark, feedback.sentiment_category(F.col("s")), **value) == category


def test_capitalise_keeps_the_rest(spark):
    assert one(spark, text.capitalise(F.lit("pOSITIVE news"))) == "POSITIVE news"
    assert one(spark, text.capitalise(F.lit(""))) == ""


def test_thread_id_scope_separates_nulls_and_values(spark):
    plain = one(spark, feedback.thread_id(F.lit("1.0")))
    scoped = {
        one(spark, feedback.thread_id(F.lit("1.0"), F.lit(team).cast("string"))) for team in (None, "", "-", "T1")
    }
    assert plain not in scoped and len(scoped) == 4
    assert one(spark, feedback.thread_id(F.lit(None).cast("string"), F.lit("T1"))) is None
