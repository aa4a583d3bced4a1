"""Thread reconstruction and engagement counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.feedback import engagement_weight, thread_id
from feedloom.operators.skew import HOT_ROWS, join_unique


def _aligned(df: DataFrame, subtype: str, **columns: Column) -> DataFrame:
    """Project onto the common thread columns; those not given keep their name."""
    columns["event_subtype"] = F.lit(subtype)
    return df.select(*[columns.get(c, F.col(c)).alias(c) for c in schemas.THREAD_COLUMNS])


def thread_events(
    posts: DataFrame, replies: DataFrame, reactions: DataFrame, hash_reaction_type: bool = True
) -> DataFrame:
    """Posts, replies and reactions as one table keyed by thread; no shuffle.

    A reaction's type is the hash of its name, or the plain name with
    ``hash_reaction_type=False``.
    """
    no_text, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    post_rows = _aligned(posts, "post", thread_id=thread_id(F.col("event_ts")), parent_user_id=no_text)
    reply_rows = _aligned(
        replies,
        "reply",
        event_type=F.lit("message"),
        is_bot_post=no_flag,
        thread_id=thread_id(F.col("event_thread_ts")),
        parent_user_id=F.col("event_parent_user_id"),
    )
    reaction_type = F.lit("reaction_added")
    reaction_rows = _aligned(
        reactions,
        "reaction",
        event_channel=F.col("reaction_item_channel"),
        event_channel_type=F.col("reaction_item_type"),
        event_client_msg_id=no_text,
        event_text=F.col("reaction"),
        event_type=F.md5(reaction_type) if hash_reaction_type else reaction_type,
        is_bot_post=no_flag,
        thread_id=thread_id(F.col("reaction_item_ts")),
        parent_user_id=F.col("reaction_item_user"),
    )
    return post_rows.unionByName(reply_rows).unionByName(reaction_rows)


def _scoped_key(df: DataFrame, ts: str, scope: Sequence[str]):
    # A reaction names the channel of the item it belongs to.
    alias = {"event_channel": "reaction_item_channel"}
    return thread_id(F.col(ts), *[F.col(c if c in df.columns else alias.get(c, c)) for c in scope])


def _thread_keys(df: DataFrame, ts: str, scope: Sequence[str]) -> DataFrame:
    return df.select(_scoped_key(df, ts, scope).alias("thread_id"))


def thread_reply_counts(replies: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Replies per thread, counted before the shuffle and merged after it."""
    keys = _thread_keys(replies, "event_thread_ts", scope)
    return keys.groupBy("thread_id").agg(F.count(F.lit(1)).alias("num_replies"))


def thread_reaction_counts(reactions: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    keys = _thread_keys(reactions, "reaction_item_ts", scope)
    return keys.groupBy("thread_id").agg(F.count(F.lit(1)).alias("num_reactions"))


def engagement_counts(replies: DataFrame, reactions: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Both counts per thread in one aggregate, so that posts are joined once."""
    reply_keys = _thread_keys(replies, "event_thread_ts", scope).withColumn("is_reply", F.lit(True))
    reaction_keys = _thread_keys(reactions, "reaction_item_ts", scope).withColumn("is_reply", F.lit(False))
    events = reply_keys.unionByName(reaction_keys)
    return events.groupBy("thread_id").agg(
        F.count_if("is_reply").alias("num_replies"), F.count_if(~F.col("is_reply")).alias("num_reactions")
    )


def attach_counts(
    posts: DataFrame, counts: DataFrame, key: str = "thread_id", spread: str = "id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join with counts that hold one row per key, so rows never multiply."""
    return join_unique(posts, counts, [key], "left", spread, hot_rows)


def weigh(
    posts: DataFrame,
    replies: DataFrame,
    reactions: DataFrame,
    scope: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Posts with ``thread_id``, ``num_replies``, ``num_reactions`` and ``weight``.

    ``scope`` keeps threads with equal timestamps in different teams or
    channels apart; by default they share their counts.
    """
    keyed = posts.withColumn("thread_id", _scoped_key(posts, "event_ts", scope))
    joined = attach_counts(keyed, engagement_counts(replies, reactions, scope), hot_rows=hot_rows)
    weight = engagement_weight(F.col("num_replies"), F.col("num_reactions"))
    return joined.withColumn("weight", weight).fillna(0, ["num_replies", "num_reactions"])


def weighted_columns(weighed: DataFrame) -> DataFrame:
    """The weighted-post contract out of :func:`weigh`'s result."""
    fixed = {
        "post_id": F.col("id"),
        "parent_user_id": F.lit(None).cast("string"),
        "event_subtype": F.lit("post"),
    }
    return weighed.select(*[fixed.get(c, F.col(c)).alias(c) for c in schemas.WEIGHTED_COLUMNS])
