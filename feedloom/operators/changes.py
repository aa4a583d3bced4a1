"""Row changes as functions from old rows and changes to new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import ANONYMOUS_MARKER, add_prefix
from feedloom.functions.time import is_valid_ts
from feedloom.operators.flatten import judged_events, parsed_events
from feedloom.operators.skew import BROADCAST_ROWS, HOT_ROWS, any_null, broadcastable, join_unique, small_enough
from feedloom.session import stage

MESSAGE_DELETED = "message_deleted"
REACTION_REMOVED = "reaction_removed"


def anonymise(df: DataFrame, bot_id: str = "B1", text: str = "text", user: str = "user") -> DataFrame:
    """Mark the text and let the bot post it instead of the user."""
    return df.withColumns(
        {
            text: add_prefix(F.col(text), ANONYMOUS_MARKER),
            user: F.lit(None).cast(df.schema[user].dataType),
            "bot_id": F.lit(bot_id),
        }
    )


def _event(name: str) -> Column:
    return F.coalesce(F.col(f"ev.event.{name}"), F.col(f"ev.{name}"))


_RAW = ["id", "event_time", "raw_event"]


def _routing() -> list[Column]:
    """The fields that decide where a row goes."""
    return [
        _event("type").alias("type"),
        _event("subtype").alias("subtype"),
        _event("ts").alias("message_ts"),
        _event("event_ts").alias("event_ts"),
        _event("item.ts").alias("item_ts"),
        _event("reaction").alias("reaction"),
        _event("user").alias("user"),
        _event("previous_message.ts").alias("deleted_ts"),
    ]


def with_routing(raw: DataFrame) -> DataFrame:
    """Raw rows plus the fields that decide where a row goes, from one parse."""
    return parsed_events(raw).select(*_RAW, *_routing())


def _valid() -> Column:
    kind = F.col("type")
    times = F.when(kind == "message", is_valid_ts(F.col("message_ts"))).when(
        kind.isin("reaction_added", REACTION_REMOVED), is_valid_ts(F.col("item_ts")) & is_valid_ts(F.col("event_ts"))
    )
    return F.coalesce(times, F.lit(True))


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with usable timestamps, and the rejected rest."""
    routed = with_routing(raw)
    return routed.filter(_valid()).select(*_RAW), routed.filter(~_valid()).select(*_RAW)


def _is_deletion() -> Column:
    return F.col("type").eqNullSafe(F.lit("message")) & F.col("subtype").eqNullSafe(F.lit(MESSAGE_DELETED))


def _is_removal() -> Column:
    return F.col("type").eqNullSafe(F.lit(REACTION_REMOVED))


def _control_fields() -> list[Column]:
    removal = _is_removal()
    return [
        F.when(removal, REACTION_REMOVED).otherwise(MESSAGE_DELETED).alias("kind"),
        F.col("event_time"),
        F.when(removal, F.col("item_ts")).otherwise(F.col("deleted_ts")).alias("target_ts"),
        F.when(removal, F.col("reaction")).alias("reaction"),
        F.when(removal, F.col("user")).alias("user"),
    ]


def route_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to store, and control rows that delete stored ones.

    Takes valid rows; see :func:`split_valid`.
    """
    routed = with_routing(raw)
    control = _is_deletion() | _is_removal()
    return routed.filter(~control).select(*_RAW), routed.filter(control).select(*_control_fields())


def tagged_events(raw: DataFrame) -> DataFrame:
    """Every raw row with one verdict, from one parse: a ``tag`` and, in ``change``, what a control row deletes.

    Tags are ``store``, ``control``, ``rejected`` (no usable timestamp) and ``malformed`` (no
    JSON). Each row has exactly one, so the four add up to the input. A row without a payload is stored.
    """
    control = _is_deletion() | _is_removal()
    tag = F.when(~F.col("well_formed"), "malformed").when(~_valid(), "rejected").when(control, "control").otherwise("store")
    rows = judged_events(raw).select(*_RAW, "well_formed", *_routing())
    return rows.select(*_RAW, tag.alias("tag"), F.when(tag == "control", F.struct(*_control_fields())).alias("change"))


@dataclass(frozen=True)
class Removals:
    """Latest deletion time per message and per reaction, one row per key."""

    messages: DataFrame
    reactions: DataFrame
    small: bool  # both may be broadcast
    hot_rows: int


def removals(control: DataFrame, match_user: bool = False, hot_rows: int = HOT_ROWS) -> Removals:
    """Merge control rows to the latest per key: earlier ones remove nothing more."""
    is_reaction = F.col("kind") == REACTION_REMOVED
    last = stage(
        control.groupBy(
            "kind",
            F.col("target_ts").alias("_ts"),
            F.when(is_reaction, F.col("reaction")).alias("_reaction"),
            F.when(is_reaction & F.lit(match_user), F.col("user")).alias("_user"),
        ).agg(F.max("event_time").alias("_at")),
        "removals",
    )
    messages = last.filter(F.col("kind") == MESSAGE_DELETED).select("_ts", F.col("_at").alias("_message_removed"))
    user = ["_user"] if match_user else []
    reactions = last.filter(is_reaction).select(
        F.col("_ts").alias("_item_ts"), "_reaction", *user, F.col("_at").alias("_reaction_removed")
    )
    return Removals(messages, reactions, small_enough(last, BROADCAST_ROWS), hot_rows)


def _mark(keyed: DataFrame, gone: DataFrame, known: Removals, narrow: DataFrame | None) -> DataFrame:
    """Add the deletion time of each row's key, NULL if it has none."""
    keys, added = gone.columns[:-1], gone.columns[-1]
    marked = join_unique(keyed, gone, keys, "left", "id", known.hot_rows, known.small, narrow)
    hit = F.coalesce(F.col("event_time") <= F.col(added), F.lit(False))
    return marked.withColumn("_removed", F.col("_removed") | hit).drop(added)


def mark_removed(
    keyed: DataFrame, known: Removals, messages: bool = True, reactions: bool = True
) -> DataFrame:
    """Add ``_removed``: stored no later than the last deletion of its key.

    ``keyed`` has the columns ``_ts``, ``_item_ts``, ``_reaction`` and ``_user``.
    """
    # Hot keys are searched before the joins, on the key columns alone.
    narrow = None if known.small else stage(keyed.select("_ts", "_item_ts", "_reaction", "_user"), "keys")
    marked = keyed.withColumn("_removed", F.lit(False))
    if messages:
        marked = _mark(marked, known.messages, known, narrow)
    if reactions:
        marked = _mark(marked, known.reactions, known, narrow)
    return marked


def _raw_keys(raw: DataFrame) -> DataFrame:
    return parsed_events(raw).select(
        *_RAW,
        _event("ts").alias("_ts"),
        _event("item.ts").alias("_item_ts"),
        _event("reaction").alias("_reaction"),
        _event("user").alias("_user"),
    )


def apply_message_deletes(raw: DataFrame, control: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Remove messages deleted after they were stored."""
    marked = mark_removed(_raw_keys(raw), removals(control, hot_rows=hot_rows), reactions=False)
    return marked.filter(~F.col("_removed")).select(*_RAW)


def apply_reaction_removals(
    raw: DataFrame, control: DataFrame, match_user: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Remove reactions with the same item and name stored before the removal.

    One removal takes the reactions of all users, unless ``match_user``. A
    reaction added again later stays.
    """
    marked = mark_removed(_raw_keys(raw), removals(control, match_user, hot_rows), messages=False)
    return marked.filter(~F.col("_removed")).select(*_RAW)


def apply_changes(
    raw: DataFrame, control: DataFrame, match_user: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Both kinds of deletion on raw rows, from one parse."""
    marked = mark_removed(_raw_keys(raw), removals(control, match_user, hot_rows))
    return marked.filter(~F.col("_removed")).select(*_RAW)


def mark_flattened(rows: DataFrame, known: Removals) -> DataFrame:
    """``_removed`` on flattened rows, where messages carry ``event_ts``."""
    none = F.lit(None).cast("string")
    has_type, has_item = "event_type" in rows.columns, "reaction_item_ts" in rows.columns
    keyed = rows.withColumns(
        {
            "_ts": F.when(F.col("event_type") == "message", F.col("event_ts")) if has_type else none,
            "_item_ts": F.col("reaction_item_ts") if has_item else none,
            "_reaction": F.col("reaction") if has_item else none,
            "_user": F.col("event_user"),
        }
    )
    marked = mark_removed(keyed, known, messages=has_type, reactions=has_item)
    return marked.drop("_ts", "_item_ts", "_reaction", "_user")


def delete_flattened(rows: DataFrame, known: Removals) -> DataFrame:
    """The same deletions on tables that were filled before they arrived."""
    return mark_flattened(rows, known).filter(~F.col("_removed")).drop("_removed")


def _renamed(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys])


def update_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite ``cols`` of matched rows; never inserts. ``source`` is unique on ``keys``.

    Any number of target rows may share a key. The source is broadcast only if it is small by bytes, too.
    """
    changes = _renamed(source.select(*keys, *cols), keys).withColumn("_hit", F.lit(True))
    rows = target.withColumn("_row", F.xxhash64(*target.columns))  # spreads rows of one key
    joined = join_unique(rows, changes, list(keys), "left", "_row", small_right=broadcastable(changes, keys))
    value = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in target.columns])


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None
) -> DataFrame:
    """Merge ``source`` into ``target``; both are unique on ``keys``.

    Matched rows take only ``update_cols`` (default: all columns) from the
    source; unmatched source rows are inserted whole. Rows with a NULL key never
    match and are passed through without a shuffle.
    """
    keys = list(keys)
    others = [c for c in target.columns if c not in keys]
    updated = set(others if update_cols is None else update_cols)
    null_key = any_null(keys)
    old = target.filter(~null_key).withColumn("_old", F.lit(True))
    new = _renamed(source.select(*target.columns).filter(~null_key), keys).withColumn("_new", F.lit(True))
    joined = old.join(new, keys, "full_outer")

    def merged(c: str) -> Column:
        take_new = F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in updated))
        return F.when(take_new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    matched = joined.select(*[F.col(c) if c in keys else merged(c) for c in target.columns])
    loose = target.filter(null_key).unionByName(source.select(*target.columns).filter(null_key))
    return matched.unionByName(loose)
