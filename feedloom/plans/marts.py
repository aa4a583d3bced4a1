"""Marts: each is a function of the datasets it depends on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.operators.answers import Answers
from feedloom.operators.flatten import base_events, reactions, replies
from feedloom.operators.incremental import emit_closed_weeks, one_per_key
from feedloom.operators.sentiment import posts
from feedloom.operators.skew import HOT_ROWS
from feedloom.operators.summaries import attach_to_parts, extractive_summary, open_question, question_groups, summarise_groups
from feedloom.operators.threads import thread_events, weigh, weighted_columns
from feedloom.operators.weekly import GROUP, PART_CHARS, ROW, classified, top_posts, weekly_feedback, with_texts
from feedloom.session import stage


@dataclass(frozen=True)
class Events:
    """The three typed subsets of the base table."""

    posts: DataFrame
    replies: DataFrame
    reactions: DataFrame


def staged_events(raw: DataFrame, scorer: Callable[[DataFrame], DataFrame], mode: str = "permissive") -> Events:
    """Parse raw events once, score posts once, and keep both as stored tables.

    Of the base table only columns of the three subsets are kept; which of repeated rows stays is decided by a hash of all.
    """
    base = base_events(raw, mode)
    wanted = {*schemas.POST_COLUMNS, *schemas.REPLY_COLUMNS, *schemas.REACTION_COLUMNS, "bot_id"}
    used = [c for c in base.columns if c in wanted]
    kept = stage(base.select(*used, F.xxhash64(*base.columns).alias("_tie")), "base")
    base = one_per_key(kept, ["id"], "_tie").select(*used)
    return Events(stage(posts(base, scorer), "posts"), replies(base), reactions(base))


def thread_reconstruction(events: Events) -> DataFrame:
    return thread_events(events.posts, events.replies, events.reactions)


def weighted_posts(events: Events, hot_rows: int = HOT_ROWS) -> DataFrame:
    return weighted_columns(weigh(events.posts, events.replies, events.reactions, hot_rows=hot_rows))


def summary_input(events: Events, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Non-neutral posts with weights, staged because the summary reads them more than once.

    Score and weight travel on the same row, so posts are not joined to
    themselves by id. Columns the summary does not use are pruned here.
    """
    narrow = events.posts.select("id", "team_id", "event_time", "event_ts", "event_text", "sentiment_score")
    weighed = weigh(narrow, events.replies, events.reactions, hot_rows=hot_rows)
    return with_texts(stage(classified(weighed).withColumn(ROW, F.monotonically_increasing_id()), "opinions"))


def summarise(
    opinion_rows: DataFrame,
    generator: Callable | None = None,
    hot_rows: int = HOT_ROWS,
    part_chars: int = PART_CHARS,
    book: Answers | None = None,
) -> DataFrame:
    """Weekly summaries of :func:`summary_input` rows: the contract plus ``part_no``.

    A group has one row unless its text exceeds ``part_chars``; then further rows carry
    the following parts of the text. Summary and question are the group's on each row.
    ``book`` keeps the answers of a ``generator`` across runs.
    """
    weekly = weekly_feedback(opinion_rows, hot_rows, part_chars)
    if generator is None:
        top = stage(top_posts(opinion_rows.filter(F.col("team_id").isNotNull())), "top")
        texts = attach_to_parts(weekly, extractive_summary(top).join(open_question(top), GROUP, "left"))
    else:
        texts = question_groups(summarise_groups(weekly, generator=generator, book=book), generator=generator, book=book)
    result = texts.withColumn("numbered_weighted_posts", F.array_join("numbered_posts", " "))
    return result.select(*schemas.SUMMARY_COLUMNS, "part_no")


def post_summary(
    events: Events,
    emitted: DataFrame | None = None,
    now: str | None = None,
    mode: str | None = None,
    generator: Callable | None = None,
    hot_rows: int = HOT_ROWS,
    part_chars: int = PART_CHARS,
    book: Answers | None = None,
) -> DataFrame:
    """Weekly summary per team and sentiment class.

    Without ``mode`` every week is summarised. With ``emitted`` and a ``mode``
    only weeks due for emission are, and only their posts are aggregated.
    """
    rows = summary_input(events, hot_rows)
    if mode is not None:
        rows = emit_closed_weeks(rows, emitted, now, mode)
    return summarise(rows, generator, hot_rows, part_chars, book)
