"""Read views over the marts: tables, series, messages and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import (
    DIGEST_SEPARATOR,
    DIGEST_TEMPLATE,
    MESSAGE_TEMPLATE,
    anonymity_label,
    capitalise,
)
from feedloom.functions.time import fmt_date
from feedloom.operators.incremental import latest_per_key
from feedloom.operators.skew import HOT_ROWS, join_unique


def _between(df: DataFrame, col: str, range: tuple[str, str] | None) -> DataFrame:
    """Rows from ``range[0]`` to ``range[1]``, both included; all without a range."""
    if range is None:
        return df
    kind = df.schema[col].dataType
    low, high = (F.lit(value).cast(kind) for value in range)
    return df.filter(F.col(col).between(low, high))


def feedback_table(summary: DataFrame, range: tuple[str, str] | None = None) -> DataFrame:
    """Rows of the summary, with ``part_no`` where the summary has it."""
    part = [c for c in ("part_no",) if c in summary.columns]
    return _between(summary, "feedback_start_date", range).select(
        *part,
        "sentiment_category",
        "avg_sentiment_score",
        "numbered_weighted_posts",
        "detailed_summary",
        "open_ended_question",
    )


def sentiment_series(posts: DataFrame, range: tuple[str, str] | None = None) -> DataFrame:
    """Score over time, ascending. ``id`` lets a range sort split equal times."""
    rows = _between(posts, "event_time", range)
    return rows.orderBy("event_time", "id").select("event_time", "sentiment_score")


def bot_post_counts(posts: DataFrame, range: tuple[str, str] | None = None) -> DataFrame:
    rows = _between(posts, "event_time", range)
    counts = rows.groupBy("is_bot_post").agg(F.count(F.lit(1)).alias("post_count"))
    return counts.withColumn("label", anonymity_label(F.col("is_bot_post")))


def _first_parts(summary: DataFrame) -> DataFrame:
    """One row per group, when a text has several parts."""
    return summary.filter(F.col("part_no") == 1) if "part_no" in summary.columns else summary


def latest_summary(summary: DataFrame, category: str, team_id: str) -> DataFrame:
    """Most recent summary of one team and class; empty when there is none."""
    wanted = (F.col("sentiment_category") == category) & (F.col("team_id") == team_id)
    return (
        _first_parts(summary)
        .filter(wanted)
        .orderBy(F.desc("feedback_start_date"))
        .limit(1)
        .select("detailed_summary", "feedback_start_date", "feedback_end_date")
    )


def latest_summaries(summary: DataFrame) -> DataFrame:
    """The same for every team and class at once."""
    columns = ["team_id", "sentiment_category", "detailed_summary", "feedback_start_date", "feedback_end_date"]
    rows = _first_parts(summary).select(*columns)
    return latest_per_key(rows, ["team_id", "sentiment_category"], ["feedback_start_date"])


def summary_message(summary: Column, start: Column, end: Column) -> Column:
    return F.format_string(MESSAGE_TEMPLATE, fmt_date(start), fmt_date(end), summary)


def with_message(latest: DataFrame) -> DataFrame:
    message = summary_message(F.col("detailed_summary"), F.col("feedback_start_date"), F.col("feedback_end_date"))
    return latest.withColumn("message", message)


def digest_paragraph(category: Column, start: Column, end: Column, summary: Column) -> Column:
    return F.format_string(
        DIGEST_TEMPLATE, fmt_date(start, "yyyy-MM-dd"), fmt_date(end, "yyyy-MM-dd"), capitalise(category), summary
    )


def _latest_week(summary: DataFrame) -> DataFrame:
    """Rows of each team's most recent week: at most one per class."""
    rows = _first_parts(summary)
    last = rows.groupBy("team_id").agg(F.max("feedback_start_date").alias("feedback_start_date"))
    return rows.join(last, ["team_id", "feedback_start_date"], "left_semi")


def weekly_digest(summary: DataFrame) -> DataFrame:
    """One message per team with a paragraph per class of its latest week."""
    paragraph = digest_paragraph(
        F.col("sentiment_category"),
        F.col("feedback_start_date"),
        F.col("feedback_end_date"),
        F.col("detailed_summary"),
    )
    rows = _latest_week(summary).select("team_id", "sentiment_category", paragraph.alias("paragraph"))
    paragraphs = F.array_sort(F.collect_list(F.struct("sentiment_category", "paragraph")))
    texts = F.transform(paragraphs, lambda p: p["paragraph"])
    return rows.groupBy("team_id").agg(F.array_join(texts, DIGEST_SEPARATOR).alias("message"))


def digest_deliveries(digest: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The team's digest for each of its members; one team may hold most members."""
    joined = join_unique(members, digest, ["team_id"], "inner", "user_id", hot_rows)
    return joined.select("team_id", "user_id", "message")


def weekly_question(summary: DataFrame) -> DataFrame:
    """One question per team: of its latest week, the negative class first."""
    rows = _first_parts(summary).select("team_id", "feedback_start_date", "sentiment_category", "open_ended_question")
    newest = F.struct("feedback_start_date", F.col("sentiment_category") == "negative")
    return rows.groupBy("team_id").agg(F.max_by("open_ended_question", newest).alias("question"))
