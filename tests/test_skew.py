"""Hot and NULL keys: the split paths give what the plain operators give."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.operators import skew, weekly
from tests.events import rows


@pytest.fixture(scope="module")
def left(spark):
    # A third of the rows on one key, a third on NULL, the rest on keys of their own.
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    return spark.range(900).withColumn("k", key).withColumn("k2", F.lit("x"))


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("hot", "x", 7), ("4", "x", 5), (None, "x", 9)], "k string, k2 string, v int")


def test_hot_keys_are_found_exactly(left):
    assert [tuple(r) for r in skew.heavy_keys(left, "k", 100).collect()] == [("hot", 300)]
    assert skew.heavy_keys(left, "k", 300).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows, small", [(1_000_000, False), (50, False), (50, True)])
def test_join_unique_equals_plain_join(left, right, how, hot_rows, small):
    got = skew.join_unique(left, right, ["k", "k2"], how, "id", hot_rows, small)
    assert rows(got) == rows(left.join(right, ["k", "k2"], how).select("id", "k", "k2", "v"))


def test_keys_never_collide(spark):
    left = spark.createDataFrame([(1, "a:1", "b"), (2, "a", "1:b"), (3, None, "2")], "id int, k string, k2 string")
    right = spark.createDataFrame([("a", "1:b", 1), ("3", "2", 2)], "k string, k2 string, v int")
    assert rows(skew.join_unique(left, right, ["k", "k2"]), "id", "v") == [(1, None), (2, 1), (3, None)]
    # The filler of a NULL key equals a real key here.
    single = skew.join_unique(left, right.drop("k2"), ["k"])
    assert rows(single, "id", "v") == [(1, None), (2, 1), (3, None)]


def test_hot_key_is_spread_over_tasks(spark, left, right):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.join_unique(left, right.drop("k2"), ["k"], hot_rows=20)
        placed = joined.withColumn("p", F.spark_partition_id()).groupBy("k", "p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(r.k for r in placed)["hot"] > 1
    assert Counter(r.k for r in placed)[None] > 1


def test_anti_join_keeps_null_keys(left, right):
    got = skew.anti_join(left, right, ["k"])
    assert got.count() == 900 - 300 - 1
    assert got.filter("k is null").count() == 300


def opinions(spark, n=500, hot=400):
    """One team-week with most of the posts, many at the very same instant."""
    team = F.when(F.col("id") < hot, "BIG").when(F.col("id") % 7 != 0, "SMALL")
    at = F.timestamp_seconds(1704240000 + (F.col("id") % 3) * 60)
    return spark.range(n).select(
        "id",
        team.alias("team_id"),
        F.lit("positive").alias("sentiment_category"),
        F.lit("2024-01-02").cast("date").alias("feedback_start_date"),
        F.lit("2024-01-07").cast("date").alias("feedback_end_date"),
        at.alias("event_time"),
        F.lit(0.5).alias("sentiment_score"),
        (F.col("id") % 5).cast("decimal(24,1)").alias("weight"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("event_text"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("weighted_text"),
        F.lit(24).alias("text_chars"),
    )


@pytest.mark.parametrize("hot_rows", [10, 37, 399])
def test_range_numbering_equals_window_numbering(spark, hot_rows):
    df = opinions(spark)
    plain = rows(weekly.number_posts(df), "id", "post_number")
    assert rows(weekly.number_posts(df, hot_rows=hot_rows), "id", "post_number") == plain


def joined_parts(df):
    parts = {}
    for row in df.orderBy("part_no").collect():
        parts.setdefault(row.team_id, []).append(row)
    return parts


def test_plan_choice_never_changes_rows(spark):
    df = opinions(spark)
    assert rows(weekly.weekly_feedback(df, hot_rows=30)) == rows(weekly.weekly_feedback(df))


def test_parts_of_uneven_posts_are_bounded(spark):
    uneven = opinions(spark).withColumn("text_chars", F.when(F.col("id") % 97 < 2, 3000).otherwise(F.col("id") % 50 + 16))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut, by_range = weekly._number(uneven, 500_000, 1000)
        parts = cut.groupBy("team_id", "part_no").agg(F.count("*").alias("n"), F.sum("text_chars").alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert by_range and sum(p.n for p in parts) == 500
    assert all(p.n == 1 or p.c < 2000 for p in parts)


@pytest.mark.parametrize("limits", [{"part_chars": 1000}, {"hot_rows": 50, "part_chars": 700}])
def test_parts_hold_every_post_in_order(spark, limits):
    df = opinions(spark)
    whole = joined_parts(weekly.weekly_feedback(df))
    cut = joined_parts(weekly.weekly_feedback(df, **limits))
    assert set(whole) == set(cut) == {"BIG", "SMALL"}  # groups without a team are dropped
    assert len(whole["BIG"]) == 1 and len(cut["BIG"]) > 3
    for team, parts in cut.items():
        assert [p.part_no for p in parts] == list(range(1, len(parts) + 1))
        assert sum((p.numbered_posts for p in parts), []) == whole[team][0].numbered_posts
        assert sum((p.feedback_texts for p in parts), []) == whole[team][0].feedback_texts
        for p in parts:
            assert (p.number_of_posts, p.avg_sentiment_score) == (whole[team][0].number_of_posts, 0.5)


def test_ordinary_groups_shuffle_posts_once(spark):
    df = weekly.weekly_feedback(opinions(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_posts_limits_before_the_shuffle(spark):
    top = weekly.top_posts(opinions(spark).filter("team_id = 'BIG'"), 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert set(rows(top, "id", "rank")) == {(9, 1), (24, 2)}  # weight 4, earliest minute, then id
