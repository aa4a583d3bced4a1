"""Chat events derived from the given tables.

``documents`` become posts, ``conversations`` become replies on the post whose
``doc_id`` is the conversation, click and view ``events`` become reactions on the
post whose ``doc_id`` is the user, and signups become messages without text.
Error and purchase events become deletions. Every row and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import add_prefix
from feedloom.operators.changes import MESSAGE_DELETED, REACTION_REMOVED
from feedloom.session import spread
from feedloom.sources.tables import filesystem

# Fixed values of the derivation, repeated by the SQL it is checked against.
EPOCH_START = 1_704_067_200  # 2024-01-01 00:00:00 UTC
MINUTES = 43_200  # posts lie within 30 days, on whole minutes
MINUTE_STEP = 7_919
USERS = 50
BOT = "B1"
FIRST_NAMED_SOURCE = "src14"  # posts of sources before it, in text order, are anonymous
POSITIVE = "and with for la der on it".split()
NEGATIVE = "of to is de die que".split()


# Schemas of the tables used, so that no job is run to find them.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def stored_bytes(spark: SparkSession, folder: str, names: tuple[str, ...] = ("documents", "conversations", "events")) -> int:
    """Bytes of the files of these tables; lists them and reads none."""
    found = [filesystem(spark, f"{folder}/{name}.parquet") for name in names]
    return sum(files.getContentSummary(location).getLength() for files, location in found)


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(t, 1) for t in POSITIVE] + [(t, -1) for t in NEGATIVE]
    return spark.createDataFrame(rows, "token string, polarity int")


def _text(number: Column | int) -> Column:
    return (F.lit(number) if isinstance(number, int) else number).cast("string")


def _user(number: Column) -> Column:
    return F.concat(F.lit("U"), _text(number % USERS))


def _stamp(seconds: Column, fraction: Column) -> Column:
    return F.concat(_text(seconds), F.lit("."), F.lpad(_text(fraction), 6, "0"))


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("raw_event")


def post_stamps(documents: DataFrame) -> DataFrame:
    """``documents`` with the second and the timestamp text of their post."""
    second = F.lit(EPOCH_START) + (F.col("doc_id") * MINUTE_STEP % MINUTES) * 60
    return documents.withColumn("sec", second).withColumn("ts", _stamp(F.col("sec"), F.col("doc_id") % 1_000_000))


def _posts(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    anonymous = F.col("source") < FIRST_NAMED_SOURCE
    team = F.upper("lang")
    none = F.lit(None).cast("string")
    text = F.when(anonymous, add_prefix(F.col("text"))).otherwise(F.col("text"))
    grant = F.struct(
        none.alias("enterprise_id"),
        F.lit(False).alias("is_bot"),
        F.lit(False).alias("is_enterprise_install"),
        team.alias("team_id"),
        F.concat(F.lit("A"), _text(doc)).alias("user_id"),
    )
    leaf = F.struct(F.lit("text").alias("type"), F.col("source").alias("text"))
    section = F.struct(F.lit("rich_text_section").alias("type"), F.array(leaf).alias("elements"))
    block = F.struct(
        F.lit("rich_text").alias("type"),
        F.concat(F.lit("b"), _text(doc)).alias("block_id"),
        F.array(section).alias("elements"),
    )
    profile = F.struct(
        F.lit(BOT).alias("id"),
        F.lit("feedback").alias("name"),
        team.alias("team_id"),
        F.lit(EPOCH_START).alias("updated"),
    )
    payload = _json(
        F.lit("message").alias("type"),
        F.col("ts").alias("event_ts"),
        F.col("ts"),
        F.col("source").alias("channel"),
        F.lit("channel").alias("channel_type"),
        F.concat(F.lit("m"), _text(doc)).alias("client_msg_id"),
        team.alias("team"),
        _user(doc).alias("user"),
        text.alias("text"),
        F.when(anonymous, BOT).alias("bot_id"),
        none.alias("parent_user_id"),
        F.lit("A1").alias("api_app_id"),
        F.concat(F.lit("Ev"), _text(doc)).alias("event_id"),
        F.concat(F.lit("ctx-"), F.col("source")).alias("event_context"),
        F.lit(False).alias("is_ext_shared_channel"),
        F.array(grant).alias("authorizations"),
        F.array(block).alias("blocks"),
        F.when(anonymous, profile).alias("bot_profile"),
    )
    return post_stamps(documents).select(
        (doc * 4).alias("id"), F.timestamp_seconds("sec").alias("event_time"), payload
    )


def _replies(conversations: DataFrame, roots: DataFrame) -> DataFrame:
    second = F.col("sec") + (F.col("turn") + 1) * 60
    stamp = _stamp(second, F.col("turn"))
    payload = _json(
        F.lit("message").alias("type"),
        stamp.alias("event_ts"),
        stamp.alias("ts"),
        F.col("source").alias("channel"),
        F.upper("lang").alias("team"),
        F.col("role").alias("user"),
        F.col("text"),
        _user(F.col("conv_id")).alias("parent_user_id"),
        F.col("ts").alias("thread_ts"),
    )
    rows = conversations.join(roots, conversations["conv_id"] == roots["doc_id"])
    row_id = (F.col("conv_id") * 1000 + F.col("turn")) * 4 + 1
    return rows.select(row_id.alias("id"), F.timestamp_seconds(second).alias("event_time"), payload)


def _event_seconds() -> Column:
    return F.unix_timestamp(F.col("event_at").cast("timestamp"))


def _on_posts(events: DataFrame, roots: DataFrame) -> DataFrame:
    rows = events.withColumnRenamed("ts", "event_at").join(roots, events["user_id"] == roots["doc_id"])
    return rows.withColumn("sec", _event_seconds())


def _reaction_payload(kind: str, name: Column) -> Column:
    item = F.struct(F.lit("message").alias("type"), F.col("source").alias("channel"), F.col("ts"))
    return _json(
        F.lit(kind).alias("type"),
        _stamp(F.col("sec"), F.lit(0)).alias("event_ts"),
        F.upper("lang").alias("team"),
        F.concat(F.lit("U"), _text(F.col("user_id"))).alias("user"),
        name.alias("reaction"),
        item.alias("item"),
        _user(F.col("doc_id")).alias("item_user"),
    )


def _reactions(events: DataFrame, roots: DataFrame) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "thumbsup").otherwise("eyes")
    rows = _on_posts(events.filter(F.col("event_type").isin("click", "view")), roots)
    return rows.select(
        (F.col("event_id") * 4 + 2).alias("id"),
        F.timestamp_seconds("sec").alias("event_time"),
        _reaction_payload("reaction_added", name),
    )


def _signups(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("event_type") == "signup").withColumnRenamed("ts", "event_at")
    stamped = rows.withColumn("sec", _event_seconds()).withColumn("ts", _stamp(F.col("sec"), F.lit(0)))
    payload = _json(
        F.lit("message").alias("type"),
        F.col("ts").alias("event_ts"),
        F.col("ts"),
        F.concat(F.lit("U"), _text(F.col("user_id"))).alias("user"),
        F.lit(None).cast("string").alias("text"),
    )
    return stamped.select((F.col("event_id") * 4 + 2).alias("id"), F.timestamp_seconds("sec").alias("event_time"), payload)


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    """Posts without their text: all that replies and reactions refer to."""
    stamps = post_stamps(read(spark, folder, "documents").select("doc_id", "lang", "source"))
    return stamps.select("doc_id", "lang", "source", "sec", "ts")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    roots = _roots(spark, folder)
    documents = spread(read(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    events = read(spark, folder, "events")
    return (
        _posts(documents)
        .unionByName(_replies(read(spark, folder, "conversations"), roots))
        .unionByName(_reactions(events, roots.drop("sec")))
        .unionByName(_signups(events))
    )


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw delete events: errors delete the user's post, purchases remove its eyes."""
    rows = _on_posts(read(spark, folder, "events"), _roots(spark, folder).drop("sec"))
    deletion = _json(
        F.lit("message").alias("type"),
        F.lit(MESSAGE_DELETED).alias("subtype"),
        _stamp(F.col("sec"), F.lit(0)).alias("event_ts"),
        _stamp(F.col("sec"), F.lit(0)).alias("ts"),
        F.struct("ts").alias("previous_message"),
    )
    payload = F.when(F.col("event_type") == "error", deletion).otherwise(
        _reaction_payload(REACTION_REMOVED, F.lit("eyes"))
    )
    return rows.filter(F.col("event_type").isin("error", "purchase")).select(
        (F.col("event_id") * 4 + 3).alias("id"), F.timestamp_seconds("sec").alias("event_time"), payload.alias("raw_event")
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct poster of every team."""
    documents = read(spark, folder, "documents")
    return documents.select(F.upper("lang").alias("team_id"), _user(F.col("doc_id")).alias("user_id")).distinct()
