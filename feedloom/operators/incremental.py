"""Incremental loads: high-water marks, keyed merges and closed weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.time import week_start
from feedloom.operators.skew import anti_join, any_null, broadcastable
from feedloom.session import stage


def high_water_mark(df: DataFrame, col: str) -> Column | None:
    """Largest value of ``col`` as a literal, or None for an empty table."""
    kind = df.schema[col].dataType.typeName()
    if kind == "timestamp":  # exact, whatever the time zone of the Python process
        micros = df.agg(F.unix_micros(F.max(col))).first()[0]
        return None if micros is None else F.timestamp_micros(F.lit(micros))
    mark = df.agg(F.max(col)).first()[0]
    return None if mark is None else F.lit(mark)


def newer_than(
    incoming: DataFrame,
    existing: DataFrame | None,
    col: str,
    strict_null_hwm: bool = False,
    inclusive: bool = True,
    keep_null: bool = True,
) -> DataFrame:
    """Incoming rows from the high-water mark of ``existing`` on, and those without a value to compare.

    The mark becomes a literal, so file statistics can prune the scan. Without
    any existing row everything is new; ``strict_null_hwm`` loads nothing then,
    as a comparison with NULL would. Rows tied with the mark and rows without a value may be
    there already and are to be merged by key; without ``inclusive`` and ``keep_null`` they
    are left out, new ones too.
    """
    mark = None if existing is None else high_water_mark(existing, col)
    if mark is None:
        return incoming.filter(F.lit(False)) if strict_null_hwm and existing is not None else incoming
    fresh = F.col(col) >= mark if inclusive else F.col(col) > mark
    return incoming.filter(fresh | F.col(col).isNull() if keep_null else fresh)


def sync_schema(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows in the incoming schema: new columns NULL, dropped ones gone."""
    return existing.select(
        *[
            F.col(f.name) if f.name in existing.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in incoming.schema.fields
        ]
    )


def one_per_key(df: DataFrame, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """One row per key; rows with a NULL key all stay.

    Of repeated rows the latest by ``event_time`` stays, ties by a hash of the row, or by the column ``tie``. Keys are
    counted on their own first, so a table without repeats is not shuffled.
    """
    keys = list(keys)
    repeated = df.filter(~any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not repeated.limit(1).count():
        return df
    order = [c for c in ("event_time",) if c in df.columns and c not in keys]
    marked = df.withColumn("_tie", F.col(tie) if tie else F.xxhash64(*df.columns))
    picked = latest_per_key(marked.filter(~any_null(keys)), keys, [*order, "_tie"])
    return picked.unionByName(marked.filter(any_null(keys))).select(*df.columns)


def replaced_keys(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], partition: str, stored: bool = False
) -> DataFrame:
    """Key and partition of the existing rows whose key arrives again; reads just these columns."""
    keys = list(keys)
    narrow = list(dict.fromkeys([*keys, partition]))
    arriving = incoming.select(*keys).filter(~any_null(keys)).distinct()
    found = existing.select(*narrow).join(arriving, keys, "left_semi")
    return stage(found, "replaced") if stored else found


def merge_incremental(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], replaced: DataFrame | None = None
) -> DataFrame:
    """Replace existing rows whose key arrives again and add the new ones, each key once.

    ``replaced`` is a stored table of :func:`replaced_keys`; if these are few, no existing row is moved.
    """
    incoming = one_per_key(incoming, keys)
    out = (incoming if replaced is None else replaced).select(*keys)
    small = replaced is not None and broadcastable(out, keys)
    return anti_join(sync_schema(existing, incoming), out, keys, small).unionByName(incoming)


def emit_closed_weeks(
    weekly: DataFrame, emitted: DataFrame | None, now: str | None = None, mode: str = "closed"
) -> DataFrame:
    """Weeks newer than the last one emitted.

    ``first_seen`` emits a week as soon as it has a row, and freezes it for all
    teams and classes. ``closed`` waits until the week is over at ``now``.
    """
    if mode not in ("closed", "first_seen"):
        raise ValueError("mode must be 'closed' or 'first_seen'")
    fresh = newer_than(weekly, emitted, "feedback_start_date", inclusive=False, keep_null=False)
    if mode == "first_seen":
        return fresh
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return fresh.filter(F.col("feedback_start_date") < week_start(at))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key, merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)
