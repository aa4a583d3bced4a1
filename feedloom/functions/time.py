"""Time columns: shifted weeks, epoch strings and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range of instants a chat client accepts, in seconds either side of 1970.
MAX_EPOCH_SECONDS = 8_640_000_000_000
SECONDS_A_DAY = 86_400


def _monday(time: Column, shift_days: int = 1) -> Column:
    """Number of days from 1970 to the Monday that opens the bucket; day 0 was a Thursday."""
    day = F.floor(F.unix_seconds(time) / F.lit(SECONDS_A_DAY)) - F.lit(shift_days)
    return (day - F.pmod(day + F.lit(3), F.lit(7))).cast("int")


def week_bucket(time: Column, shift_days: int = 1) -> Column:
    """Start of the Monday-based week after moving ``time`` back ``shift_days``.

    With the default shift a bucket holds Tuesday 00:00 to Monday 23:59:59. Weeks are those of UTC
    whatever the time zone of the session, as in :func:`weekly_window`.
    """
    return F.timestamp_seconds(_monday(time, shift_days).cast("long") * F.lit(SECONDS_A_DAY))


def week_start(time: Column) -> Column:
    """Tuesday that opens the feedback week."""
    return F.date_from_unix_date(_monday(time) + F.lit(1))


def week_end(time: Column) -> Column:
    """Sunday shown as the end of the feedback week.

    Monday's rows belong to the bucket although they lie after this label.
    """
    return F.date_from_unix_date(_monday(time) + F.lit(6))


def window_week(window: Column) -> Column:
    """Tuesday that opens a :func:`weekly_window`, as a date."""
    return week_start(window["start"])


def weekly_window(time: Column) -> Column:
    """Tumbling window with the same Tuesday alignment, for streaming state."""
    return F.window(time, "7 days", "7 days", "5 days")


def epoch_seconds(ts: Column) -> Column:
    return ts.try_cast("decimal(20,6)")


def is_valid_ts(ts: Column) -> Column:
    """Numeric text within the range of instants; never NULL."""
    seconds = epoch_seconds(ts)
    return F.coalesce(F.abs(seconds) <= F.lit(MAX_EPOCH_SECONDS), F.lit(False))


def ts_to_timestamp(ts: Column) -> Column:
    """Epoch text to timestamp with its microseconds; NULL when invalid."""
    return F.timestamp_seconds(epoch_seconds(ts))


def iso_text(ts: Column) -> Column:
    """Epoch text as ISO-8601 UTC text with milliseconds."""
    return F.date_format(ts_to_timestamp(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fmt_date(time: Column, pattern: str = "MMM dd") -> Column:
    return F.date_format(time, pattern)


def iso_date(text: Column) -> Column:
    """Date part of ISO date-time text."""
    return F.split_part(text, F.lit("T"), F.lit(1))
