"""Group summaries and discussion questions, extractive or by a caller's model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.text import question_prompt, summary_prompt, tokens
from feedloom.operators.answers import Answers, ask
from feedloom.operators.skew import broadcastable
from feedloom.operators.weekly import GROUP
from feedloom.session import stage

BULLET = "- "
QUESTION_HEAD = "What are your thoughts on "
QUESTION_FALLBACK = "What would you like to talk about this week?"
# Shorter words seldom name a topic.
TOPIC_LETTERS = 4


def extractive_summary(top: DataFrame) -> DataFrame:
    """One bullet line per post out of :func:`top_posts`, heaviest first."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "event_text")))
    bullets = F.transform(lines, lambda p: F.concat(F.lit(BULLET), p["event_text"]))
    return top.groupBy(*GROUP).agg(F.array_join(bullets, "\n").alias("detailed_summary"))


def open_question(top: DataFrame, topics: int = 3) -> DataFrame:
    """A question on the most frequent words of each group's heaviest post."""
    words = top.filter(F.col("rank") == 1).select(*GROUP, F.explode(tokens(F.col("event_text"))).alias("word"))
    # Short words become NULL instead of being filtered: every group keeps a row.
    topic = F.when(F.length("word") >= TOPIC_LETTERS, F.col("word"))
    counted = words.groupBy(*GROUP, topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*GROUP).orderBy(F.col("topic").isNull(), F.desc("n"), "topic")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= topics)
    named = F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("place", "topic")))
    listed = F.array_join(F.transform(F.array_sort(named), lambda t: t["topic"]), ", ")
    asked = F.when(listed != "", F.concat(F.lit(QUESTION_HEAD), listed, F.lit("?"))).otherwise(QUESTION_FALLBACK)
    return ranked.groupBy(*GROUP).agg(asked.alias("open_ended_question"))


def attach_to_parts(weekly: DataFrame, per_group: DataFrame) -> DataFrame:
    """Put a group's text on each of its parts.

    Texts of few groups are broadcast, and ``weekly``, which holds all posts, is not moved. Otherwise
    the list of parts is narrow; with the part in the key both sides of the wide join are
    unique, however many parts a group has.
    """
    per_group = stage(per_group, "groups")
    if broadcastable(per_group, GROUP):
        return weekly.join(F.broadcast(per_group), GROUP, "left")
    parts = weekly.select(*GROUP, "part_no").join(per_group, GROUP)
    return weekly.join(parts, [*GROUP, "part_no"], "left")


def _generated(weekly: DataFrame, prompt: Callable, generator: Callable, out: str, book: Answers | None) -> DataFrame:
    """Answer each part, then the joined answers of every group that has several parts.

    The answers of the parts are staged, so that no part is sent to the generator twice.
    """
    parts = weekly.select(*GROUP, "part_no", F.array_join("numbered_posts", " ").alias("_posts"))
    answers = stage(ask(parts, prompt(F.col("_posts")), generator, out, book, keep=[*GROUP, "part_no"]), "answers")
    listed = F.array_sort(F.collect_list(F.struct("part_no", out)))
    groups = answers.groupBy(*GROUP).agg(F.transform(listed, lambda p: p[out]).alias("_answers"))
    single = groups.filter(F.size("_answers") == 1).select(*GROUP, F.col("_answers")[0].alias(out))
    several = groups.filter(F.size("_answers") > 1)
    joined = ask(several, prompt(F.array_join("_answers", " ")), generator, out, book, keep=GROUP)
    return attach_to_parts(weekly, single.unionByName(joined))


def summarise_groups(
    weekly: DataFrame, top: DataFrame | None = None, generator: Callable | None = None, book: Answers | None = None
) -> DataFrame:
    """Add ``detailed_summary`` to weekly rows: the generator's, or extractive. All parts of a group share it.

    ``generator`` turns a pandas Series of prompts into as many texts; ``book`` keeps its answers, see
    :func:`~feedloom.operators.answers.ask`. It is asked on aggregated rows only: one prompt
    per group and text part, and one more per group of several parts.
    """
    if generator is not None:
        return _generated(weekly, summary_prompt, generator, "detailed_summary", book)
    return attach_to_parts(weekly, extractive_summary(top))


def question_groups(
    weekly: DataFrame, top: DataFrame | None = None, generator: Callable | None = None, book: Answers | None = None
) -> DataFrame:
    """Add ``open_ended_question`` to weekly rows. All parts of a group share it."""
    if generator is not None:
        return _generated(weekly, question_prompt, generator, "open_ended_question", book)
    return attach_to_parts(weekly, open_question(top))
