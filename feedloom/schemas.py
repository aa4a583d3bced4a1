"""Schemas and column lists of the datasets."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("raw_event", T.StringType()),
    ]
)

CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("target_ts", T.StringType()),
        T.StructField("reaction", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
)


def _struct(strings: str = "", booleans: str = "", **nested: T.DataType) -> T.StructType:
    """Struct of named text fields, flags and nested types."""
    schema = T.StructType()
    for name in strings.split():
        schema.add(name, T.StringType())
    for name in booleans.split():
        schema.add(name, T.BooleanType())
    for name, kind in nested.items():
        schema.add(name, kind)
    return schema


# Fields of one chat event. `blocks` and `event_context` stay JSON text.
EVENT_SCHEMA = _struct(
    """type subtype event_ts ts thread_ts channel channel_type client_msg_id text user parent_user_id
    team bot_id reaction item_user api_app_id context_enterprise_id context_team_id event_context
    event_id token blocks""",
    "is_ext_shared_channel",
    item=_struct("type channel ts"),
    authorizations=T.ArrayType(_struct("enterprise_id team_id user_id", "is_bot is_enterprise_install")),
    bot_profile=_struct("id name team_id updated"),
    previous_message=_struct("ts"),
)
# Deliveries may also arrive in their envelope, with the event under `event`.
PAYLOAD_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("event", EVENT_SCHEMA)])
BLOCKS_SCHEMA = T.ArrayType(
    _struct("block_id", elements=T.ArrayType(_struct(elements=T.ArrayType(_struct("text type")))))
)

# The output contracts, column by column, in order.
BASE_COLUMNS = """
    id event_time api_app_id enterprise_id is_bot is_enterprise_install auth_team_id auth_user_id
    context_enterprise_id context_team_id event_ts event_channel event_channel_type
    event_client_msg_id event_text event_type event_user event_parent_user_id event_thread_ts
    reaction_item_channel reaction_item_ts reaction_item_type reaction_item_user reaction
    event_context event_id is_ext_shared_channel team_id token type bot_id blocks block_id
    block_text block_text_type anonymous_feedback_text bot_profile_id bot_profile_name
    bot_profile_team_id bot_profile_updated
""".split()

ENVELOPE_COLUMNS = """
    api_app_id enterprise_id is_bot is_enterprise_install auth_team_id auth_user_id
    context_enterprise_id context_team_id
""".split()

POST_COLUMNS = (
    ["event_text", "sentiment_score", "id", "event_time"]
    + ENVELOPE_COLUMNS
    + """event_ts event_channel event_channel_type event_client_msg_id event_type event_user
    event_context event_id is_ext_shared_channel team_id token type is_bot_post""".split()
)

REPLY_COLUMNS = (
    ["id", "event_time"]
    + ENVELOPE_COLUMNS
    + """event_ts event_channel event_channel_type event_client_msg_id event_text event_type
    event_user event_parent_user_id event_thread_ts event_context event_id
    is_ext_shared_channel team_id token type""".split()
)

REACTION_COLUMNS = (
    ["id", "event_time", "reaction"]
    + ENVELOPE_COLUMNS
    + """event_ts reaction_item_channel reaction_item_ts reaction_item_type reaction_item_user
    event_user event_context event_id is_ext_shared_channel team_id token type""".split()
)

THREAD_COLUMNS = (
    ["id", "event_time"]
    + ENVELOPE_COLUMNS
    + """event_ts event_channel event_channel_type event_client_msg_id event_text event_type
    event_user event_context event_id is_ext_shared_channel team_id token type is_bot_post
    thread_id parent_user_id event_subtype""".split()
)

WEIGHTED_COLUMNS = (
    ["post_id", "event_text", "event_time"]
    + ENVELOPE_COLUMNS
    + """event_ts event_channel event_channel_type event_client_msg_id event_type event_user
    event_context event_id is_ext_shared_channel team_id token type is_bot_post thread_id
    parent_user_id event_subtype num_replies num_reactions weight""".split()
)

SUMMARY_COLUMNS = """
    team_id sentiment_category avg_sentiment_score feedback_start_date feedback_end_date
    numbered_weighted_posts detailed_summary open_ended_question
""".split()
