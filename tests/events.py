"""Hand-made events for the unit tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

LEXICON = [("good", 1), ("great", 1), ("bad", -1), ("awful", -1)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, polarity int")


def raw(spark, rows):
    """Rows of (id, time text, payload dict or text)."""
    packed = [(i, at, p if isinstance(p, str) or p is None else json.dumps(p)) for i, at, p in rows]
    df = spark.createDataFrame(packed, "id long, at string, raw_event string")
    return df.select("id", F.col("at").cast("timestamp").alias("event_time"), "raw_event")


def post(ts, text="good", team="T1", **more):
    return {"type": "message", "event_ts": ts, "ts": ts, "text": text, "team": team, "user": "U1", **more}


def reply(ts, thread, text="ok", team="T1", **more):
    return post(ts, text, team, thread_ts=thread, parent_user_id="U1", **more)


def reaction(ts, item, name="eyes", user="U2", team="T1", kind="reaction_added"):
    return {
        "type": kind, "event_ts": ts, "team": team, "user": user, "reaction": name,
        "item": {"type": "message", "channel": "C1", "ts": item}, "item_user": "U1",
    }


def control(spark, rows):
    """Rows of (kind, time text, target timestamp, reaction, user)."""
    df = spark.createDataFrame(rows, "kind string, at string, target_ts string, reaction string, user string")
    at = F.col("at").cast("timestamp").alias("event_time")
    return df.select("kind", at, "target_ts", "reaction", "user")


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is None, str(v)) for v in r])
