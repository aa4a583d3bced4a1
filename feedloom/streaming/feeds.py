"""Streams of raw events: ingest, change log, dedup and weekly state.

Every entry point drains what is available and stops; a scheduler calls it
again, and the checkpoint under the output folder remembers what was read.
Batch outputs go to one folder per batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom import schemas
from feedloom.functions.feedback import is_opinionated, sentiment_category, thread_id
from feedloom.functions.time import week_start, weekly_window, window_week
from feedloom.operators.changes import apply_changes, tagged_events
from feedloom.operators.flatten import base_events
from feedloom.operators.incremental import high_water_mark, latest_per_key
from feedloom.operators.sentiment import posts
from feedloom.sources.raw_events import stream_raw_events
from feedloom.sources.tables import read_table


def _drain(writer, out: str) -> None:
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return write


def _stored(spark: SparkSession, source: str, max_files: int | None) -> DataFrame:
    """Valid events that are to be stored, as a stream. :class:`ChangeLog` keeps the others too."""
    return tagged_events(stream_raw_events(spark, source, max_files=max_files)).filter("tag = 'store'").select(*schemas.RAW_SCHEMA.names)


def stream_base(spark: SparkSession, source: str, out: str, max_files: int | None = None) -> DataFrame:
    """Append the flat form of new events to ``out`` and return the whole table."""
    base = base_events(_stored(spark, source, max_files))
    _drain(base.writeStream.format("parquet").option("path", f"{out}/data"), out)
    return spark.read.schema(base.schema).parquet(f"{out}/data")


def stream_deduplicated(
    spark: SparkSession, source: str, out: str, delay: str = "60 days", max_files: int | None = None
) -> DataFrame:
    """Append each event id once; repeats within ``delay`` are dropped."""
    rows = _stored(spark, source, max_files).withWatermark("event_time", delay)
    unique = rows.dropDuplicatesWithinWatermark(["id"])
    _drain(unique.writeStream.format("parquet").option("path", f"{out}/data"), out)
    return spark.read.schema(unique.schema).parquet(f"{out}/data")


class ChangeLog:
    """Append-only tables, stored events and deletions, merged when read, and dead letters.

    Each event is parsed once and goes to one table: those without a usable timestamp and those
    that are no JSON go to the dead letters, so nothing that arrives is lost. A deletion only touches rows stored no later than itself, so applying all
    deletions at once gives what applying them one by one would. Batches append
    to the log instead of rewriting the events; :meth:`compact` does that when
    it pays.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        tagged = tagged_events(batch).persist()
        raw = schemas.RAW_SCHEMA.names
        parts = {
            "stored": tagged.filter("tag = 'store'").select(*raw),
            "control": tagged.filter("tag = 'control'").select("change.*"),
            "dead": tagged.filter("tag IN ('rejected', 'malformed')").select(*raw, "tag"),
        }
        try:
            for name, rows in parts.items():
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            tagged.unpersist()

    def _read(self, name: str, schema) -> DataFrame:
        rows = read_table(self.spark, f"{self.path}/{name}", schema)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def stored(self) -> DataFrame:
        return self._read("stored", schemas.RAW_SCHEMA)

    def control(self) -> DataFrame:
        return self._read("control", schemas.CONTROL_SCHEMA)

    def dead(self) -> DataFrame:
        """Events that could not be used, with the ``tag`` that says why."""
        return self._read("dead", StructType([*schemas.RAW_SCHEMA.fields]).add("tag", "string"))

    def current(self, match_user: bool = False) -> DataFrame:
        """Stored events that no deletion has removed."""
        return apply_changes(self.stored(), self.control(), match_user)

    def compact(self, path: str) -> ChangeLog:
        """Write the current events, the deletions and the dead letters as a new log."""
        self.current().write.parquet(f"{path}/stored/batch=-1")
        self.control().write.parquet(f"{path}/control/batch=-1")
        self.dead().write.parquet(f"{path}/dead/batch=-1")
        return ChangeLog(self.spark, path)


def stream_apply_changes(log: ChangeLog, source: str, max_files: int | None = None) -> None:
    """Route new events and deletions into the log."""
    rows = stream_raw_events(log.spark, source, max_files=max_files)
    _drain(rows.writeStream.foreachBatch(log.write), log.path)


def _latest_state(spark: SparkSession, out: str, schema, keys: list[str]) -> DataFrame:
    """Last update of every key over all batches."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{out}/data")
    return latest_per_key(rows, keys, ["batch"]).drop("batch")


def _run_state(state: DataFrame, out: str, closed_only: bool) -> None:
    """``closed_only`` emits a window once, when the watermark has passed it."""
    mode = "append" if closed_only else "update"
    _drain(state.writeStream.outputMode(mode).foreachBatch(_batch_writer(out)), out)


def stream_weekly_sentiment(
    spark: SparkSession,
    source: str,
    out: str,
    scorer: Callable[[DataFrame], DataFrame],
    delay: str = "60 days",
    closed_only: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Running average and count per week, team and class of opinionated posts.

    State is one small row per group. Events later than ``delay`` are dropped;
    :func:`stream_weekly_totals` counts them and keeps them on record.
    """
    score = F.col("sentiment_score")
    rows = posts(base_events(_stored(spark, source, max_files)), scorer)
    rows = rows.filter(is_opinionated(score) & F.col("team_id").isNotNull()).withWatermark("event_time", delay)
    keys = ["feedback_start_date", "team_id", "sentiment_category"]
    state = (
        rows.groupBy(
            weekly_window(F.col("event_time")).alias("week"),
            "team_id",
            sentiment_category(score).alias("sentiment_category"),
        )
        .agg(F.avg("sentiment_score").alias("avg_sentiment_score"), F.count(F.lit(1)).alias("number_of_posts"))
        .withColumn("feedback_start_date", window_week(F.col("week")))
        .select(*keys, "avg_sentiment_score", "number_of_posts")
    )
    _run_state(state, out, closed_only)
    return _latest_state(spark, out, state.schema, keys)


class WeeklyTotals:
    """Sums per week, team and class that count every opinionated post, however late, and a log of the late ones.

    Each batch adds what it holds of every group, so no state is kept and none can be too old.
    A row is late if it is more than ``delay`` older than the newest row of the batches
    before its own, which is when a watermark may have dropped it. Late rows are counted and stored whole beside the
    totals. A batch that is repeated replaces itself. Rows without a time form a group of
    their own and are never late.
    """

    def __init__(self, spark: SparkSession, path: str, delay: str = "60 days"):
        self.spark = spark
        self.path = path
        self.delay = delay

    def write(self, batch: DataFrame, batch_id: int) -> None:
        marks = read_table(self.spark, f"{self.path}/marks", StructType().add("newest", "timestamp").add("batch", "long"))
        mark = None if marks is None else high_water_mark(marks.filter(F.col("batch") < batch_id), "newest")
        late = F.lit(False) if mark is None else F.coalesce(F.col("event_time") < mark - F.expr(f"INTERVAL {self.delay}"), F.lit(False))
        rows = batch.withColumn("_late", late).persist()
        score = F.col("sentiment_score")
        totals = rows.groupBy(
            week_start(F.col("event_time")).alias("feedback_start_date"), "team_id", sentiment_category(score).alias("sentiment_category")
        ).agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("posts"), F.count_if("_late").alias("late"))
        parts = {
            "totals": totals,
            "late": rows.filter("_late").select(*schemas.POST_COLUMNS),
            "marks": rows.agg(F.max("event_time").alias("newest")),
        }
        try:
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    def current(self) -> DataFrame:
        """Average score, posts and how many of them were late, per week, team and class."""
        schema = "feedback_start_date date, team_id string, sentiment_category string, score double, posts long, late long"
        rows = read_table(self.spark, f"{self.path}/totals", StructType.fromDDL(schema))
        rows = self.spark.createDataFrame([], schema) if rows is None else rows
        posts_sum = F.sum("posts")
        return rows.groupBy("feedback_start_date", "team_id", "sentiment_category").agg(
            (F.sum("score") / posts_sum).alias("avg_sentiment_score"), posts_sum.alias("number_of_posts"), F.sum("late").alias("late_posts")
        )

    def late(self) -> DataFrame | None:
        """The late posts themselves; None before the first batch."""
        rows = read_table(self.spark, f"{self.path}/late")
        return None if rows is None else rows.select(*schemas.POST_COLUMNS)


def stream_weekly_totals(
    spark: SparkSession,
    source: str,
    out: str,
    scorer: Callable[[DataFrame], DataFrame],
    delay: str = "60 days",
    max_files: int | None = None,
) -> WeeklyTotals:
    """Weekly sentiment of all rows that ever arrive, with the late ones on record."""
    score = F.col("sentiment_score")
    rows = posts(base_events(_stored(spark, source, max_files)), scorer)
    rows = rows.filter(is_opinionated(score) & F.col("team_id").isNotNull())
    totals = WeeklyTotals(spark, out, delay)
    _drain(rows.writeStream.foreachBatch(totals.write), out)
    return totals


def _engagements() -> Column:
    """What one event adds to threads: a reply, a reaction, or nothing."""
    is_reply = (F.col("event_type") == "message") & F.col("event_parent_user_id").isNotNull()
    reply = F.struct(thread_id(F.col("event_thread_ts")).alias("thread_id"), is_reply.alias("hit"), F.lit(1).alias("r"))
    reaction = F.struct(
        thread_id(F.col("reaction_item_ts")).alias("thread_id"), F.col("reaction").isNotNull().alias("hit"), F.lit(0).alias("r")
    )
    return F.filter(F.array(reply, reaction), lambda e: e["hit"] & e["thread_id"].isNotNull())


def stream_thread_engagement(
    spark: SparkSession, source: str, out: str, delay: str = "60 days", max_files: int | None = None
) -> DataFrame:
    """Replies and reactions per thread.

    State is kept per thread and week and expires with the watermark; the weeks
    are added up when read.
    """
    base = base_events(_stored(spark, source, max_files)).withWatermark("event_time", delay)
    hits = base.select("event_time", F.inline(_engagements()))
    keys = ["week", "thread_id"]
    state = (
        hits.groupBy(weekly_window(F.col("event_time")).alias("w"), "thread_id")
        .agg(F.sum("r").alias("num_replies"), F.sum(1 - F.col("r")).alias("num_reactions"))
        .select(F.col("w.start").alias("week"), "thread_id", "num_replies", "num_reactions")
    )
    _run_state(state, out, closed_only=False)
    weeks = _latest_state(spark, out, state.schema, keys)
    return weeks.groupBy("thread_id").agg(
        F.sum("num_replies").alias("num_replies"), F.sum("num_reactions").alias("num_reactions")
    )
