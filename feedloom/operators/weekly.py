"""Weekly feedback: numbering, ordered text aggregation and top posts.

A team's week can hold any number of posts. Every group is cut into text parts by
its running characters, so the rows depend on the texts alone. While all groups are
small, posts are numbered with a window; otherwise they are numbered over a global
range sort, with the same result, and no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.feedback import NEUTRAL_BAND, is_opinionated, sentiment_category
from feedloom.functions.text import numbered, weighted_text
from feedloom.functions.time import week_end, week_start
from feedloom.operators.skew import HOT_ROWS
from feedloom.session import stage

GROUP = ["team_id", "sentiment_category", "feedback_start_date", "feedback_end_date"]
# A text is cut wherever its running characters pass a multiple of this, and a longer post is
# a part of its own. A part of several posts stays under twice as many characters. A warehouse
# text column ends at 16 MiB, so any group that fits one there is a single part here.
PART_CHARS = 16_000_000
# Characters of posts that one task of the range sort reads. Parts are cut by running sums, so a task may hold many.
RANGE_CHARS = 256_000_000
LABEL_CHARS = 16  # room for "n. " and the separator
ROW = "row_no"  # unique number of a stored row, by which posts numbered without their texts meet them
_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _label() -> Column:
    return weighted_text(F.col("event_text"), F.col("weight"))


def drop_neutral(df: DataFrame, band: float = NEUTRAL_BAND) -> DataFrame:
    return df.filter(is_opinionated(F.col("sentiment_score"), band))


def classified(weighed: DataFrame, band: float = NEUTRAL_BAND) -> DataFrame:
    """Non-neutral posts with their class, feedback week and the length of their text."""
    return drop_neutral(weighed.filter(F.col("event_text").isNotNull()), band).select(
        "id",
        "team_id",
        "event_time",
        "event_text",
        "sentiment_score",
        "weight",
        sentiment_category(F.col("sentiment_score"), band).alias("sentiment_category"),
        week_start(F.col("event_time")).alias("feedback_start_date"),
        week_end(F.col("event_time")).alias("feedback_end_date"),
        (F.length(_label()) + F.lit(LABEL_CHARS)).alias("text_chars"),
    )


def with_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weighted_text", _label())


def opinions(weighed: DataFrame, band: float = NEUTRAL_BAND) -> DataFrame:
    """Non-neutral posts with class, feedback week and weighted text."""
    return with_texts(classified(weighed, band))


def same_group(left: str, right: str) -> Column:
    test = F.lit(True)
    for c in GROUP:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def group_limits(df: DataFrame) -> tuple[int, int, int, int]:
    """Most posts and most characters of a group, and those of all groups.

    Reads lengths, not texts, when ``df`` comes from a stored table.
    """
    sizes = df.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("text_chars").alias("chars"))
    found = sizes.agg(F.max("n"), F.max("chars"), F.sum("n"), F.sum("chars")).first()
    return tuple(value or 0 for value in found)


def _number_by_window(df: DataFrame) -> DataFrame:
    order = W.partitionBy(*GROUP).orderBy("event_time", "id")
    return df.withColumn("post_number", F.row_number().over(order).cast("long"))


def _number_by_range(df: DataFrame, ranges: int, part_chars: int) -> DataFrame:
    """Numbers and text parts of groups of any size, without bringing a group into one partition.

    A range sort on (group, event_time, id) cuts groups across partitions in order.
    Within a partition posts, characters and posts over ``part_chars`` are counted on;
    what the group has in earlier partitions is added. The sort is staged so that
    positions stay fixed if a task is run again. The group's score and number of posts
    come along, so that no wide row is ever shuffled by its group alone. Texts take no part:
    each row meets its numbers by ``ROW``, which is added to a stored copy of rows that lack it.
    """
    keys = [*GROUP, "event_time", "id"]
    rows = df if ROW in df.columns else stage(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    placed = stage(
        rows.select(*keys, ROW, "text_chars", "sentiment_score")
        .repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "numbering",
    ).withColumn("_slot", F.shiftright("_pos", _SLOT_BITS))
    chars = F.coalesce("text_chars", F.lit(0))
    long_post = (chars > part_chars).cast("int")
    runs = placed.groupBy(*GROUP, "_slot").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(chars).alias("_chars"),
        F.sum(long_post).alias("_long"),
        F.sum("sentiment_score").alias("_score"),
        F.count("sentiment_score").alias("_scores"),
    )
    before = W.partitionBy(*GROUP).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*GROUP)
    offsets = runs.select(
        *GROUP,
        "_slot",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_chars", "_long")],
        F.sum("_n").over(group).alias("group_posts"),
        (F.sum("_score").over(group) / F.sum("_scores").over(group)).alias("group_score"),
    )
    inside = W.partitionBy(*GROUP, "_slot").orderBy("_pos")
    counted = placed.withColumns(
        {
            "_n": F.row_number().over(inside),
            "_chars": F.sum(chars).over(inside) - chars,
            "_long": F.sum(long_post).over(inside) - long_post,
        }
    )
    match = same_group("p", "o") & (F.col("p._slot") == F.col("o._slot"))
    passed = F.col("p._chars") + F.col("o._chars_before")
    alone = ((F.coalesce("p.text_chars", F.lit(0)) > part_chars) & (passed > 0)).cast("int")
    part = F.floor(passed / part_chars) + 2 * (F.col("p._long") + F.col("o._long_before")) + alone + 1
    numbers = (
        counted.alias("p")
        .join(offsets.alias("o"), match)
        .select(
            F.col(f"p.{ROW}").alias(ROW),
            (F.col("p._n") + F.col("o._n_before")).cast("long").alias("post_number"),
            part.cast("long").alias("part_no"),
            "o.group_posts",
            "o.group_score",
        )
    )
    return rows.join(numbers, ROW).select(*df.columns, "post_number", "part_no", "group_posts", "group_score")


def _number(df: DataFrame, hot_rows: int, part_chars: int) -> tuple[DataFrame, bool]:
    """Numbered rows, and whether groups were numbered by ranges because one is too large for a task."""
    posts, chars, all_posts, all_chars = group_limits(df)
    if posts <= hot_rows and chars <= part_chars:
        return _number_by_window(df), False
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _number_by_range(df, ranges(all_posts, all_chars, hot_rows, usual), part_chars), True


def ranges(posts: int, chars: int, hot_rows: int, usual: int) -> int:
    """Tasks of the range sort: by rows and by characters, not by the number of text parts."""
    return max(usual, -(-posts // hot_rows), -(-chars // RANGE_CHARS))


def number_posts(df: DataFrame, hot_rows: int = HOT_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """Add ``post_number`` within team, class and week by time, ties by ``id``."""
    rows, _ = _number(df, hot_rows, part_chars)
    return rows.select(*df.columns, "post_number")


def _collect_texts(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    posts = F.array_sort(F.collect_list(F.struct("post_number", "weighted_text")))
    grouped = rows.groupBy(*keys).agg(*aggregates, posts.alias("posts"))
    texts = F.transform("posts", lambda p: p["weighted_text"])
    labels = F.transform("posts", lambda p: numbered(p["post_number"], p["weighted_text"]))
    return grouped.withColumns({"feedback_texts": texts, "numbered_posts": labels}).drop("posts")


def weekly_feedback(df: DataFrame, hot_rows: int = HOT_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """Average score, post count and ordered texts per team, class and week.

    ``df`` comes from :func:`opinions`. One row per group and ``part_no``, which starts at
    1 and grows in text order; next to a post longer than ``part_chars`` numbers may be left
    out. Each part states the average and the count of the whole group. ``hot_rows``
    chooses the plan and never changes a row. Groups without a team are dropped.
    """
    rows, by_range = _number(df.filter(F.col("team_id").isNotNull()), hot_rows, part_chars)
    columns = [*GROUP, "part_no", "avg_sentiment_score", "number_of_posts", "feedback_texts", "numbered_posts"]
    if by_range:
        score, posts = F.first("group_score"), F.first("group_posts")
        parts = _collect_texts(
            rows, [*GROUP, "part_no"], score.alias("avg_sentiment_score"), posts.alias("number_of_posts")
        )
        return parts.select(*columns)
    # Same keys as the numbering window: the posts are shuffled once. No group passes the first cut here.
    whole = _collect_texts(
        rows,
        GROUP,
        F.avg("sentiment_score").alias("avg_sentiment_score"),
        F.count(F.lit(1)).alias("number_of_posts"),
    )
    return whole.withColumn("part_no", F.lit(1).cast("long")).select(*columns)


def numbered_posts_string(weekly: DataFrame) -> DataFrame:
    """The numbered posts of each row as one string, in order."""
    return weekly.withColumn("numbered_posts_string", F.array_join("numbered_posts", " "))


def top_posts(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` heaviest posts per group, ties by time and ``id``.

    Catalyst limits each group inside every map task before the shuffle, so a
    large group sends at most ``k`` rows per task.
    """
    order = W.partitionBy(*GROUP).orderBy(F.desc("weight"), "event_time", "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
