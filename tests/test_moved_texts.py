"""Steps that move or store the texts of posts no more often than they must."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import summaries, weekly
from feedloom.operators.answers import Answers, ask
from feedloom.operators.flatten import base_events
from feedloom.operators.incremental import one_per_key
from feedloom.plans import marts, pipeline
from tests.events import post, raw, reaction, reply, rows

AT = "2024-01-03 09:00:00"


def scorer(df):
    return df.withColumn("sentiment_score", F.when(F.col("event_text").startswith("good"), 1.0).otherwise(-1.0))


@pytest.fixture
def staged(monkeypatch):
    """Columns of what the modules under test store, by label."""
    seen = {}

    def watch(module):
        real = module.stage

        def stage(df, label):
            seen.setdefault(label, []).append(set(df.columns))
            return real(df, label)

        monkeypatch.setattr(module, "stage", stage)

    watch(weekly)
    watch(marts)
    return seen


@pytest.fixture
def opinions(spark):
    events = [(n, AT, post(f"{n}.0", f"good post {n}" if n % 3 else "bad post")) for n in range(60)]
    events += [(None, AT, post(f"{n}.0", "bad without an id")) for n in range(100, 104)]
    return marts.summary_input(marts.staged_events(raw(spark, events), scorer))


def test_ranges_are_sorted_without_texts(opinions, staged):
    by_range = weekly.number_posts(opinions, hot_rows=5)
    assert staged["numbering"] and not any({"event_text", "weighted_text"} & c for c in staged["numbering"])
    assert "rows" not in staged  # the stored rows have numbers of their own
    by_window = weekly.number_posts(opinions)
    assert by_range.columns == by_window.columns
    known = F.col("id").isNotNull()  # rows alike in group, time and id may take each other's number
    assert rows(by_range.filter(known), "id", "post_number") == rows(by_window.filter(known), "id", "post_number")
    assert rows(by_range.filter(~known), "post_number") == rows(by_window.filter(~known), "post_number")


def test_rows_without_numbers_of_their_own_get_them(opinions, staged):
    plain = opinions.drop(weekly.ROW)
    assert weekly.number_posts(plain, hot_rows=5).columns == [*plain.columns, "post_number"]
    assert staged["rows"]
    assert rows(weekly.weekly_feedback(plain, hot_rows=5)) == rows(weekly.weekly_feedback(opinions))


def test_base_is_stored_without_columns_that_no_subset_has(spark, staged):
    twice = [(1, AT, post("1.0", f"good {n}", token=f"t{n}", blocks=f"[{n}]")) for n in range(4)]
    events = raw(spark, [*twice, (2, AT, reply("2.0", "1.0")), (3, AT, reaction("3.0", "1.0"))])
    done = marts.staged_events(events, scorer)
    assert not {"anonymous_feedback_text", "blocks", "block_text"} & staged["base"][0]
    whole = one_per_key(base_events(events), ["id"])
    assert rows(done.posts, "id", "event_text", "token") == rows(whole.filter("id = 1"), "id", "event_text", "token")
    assert (done.replies.count(), done.reactions.count()) == (1, 1)


def test_few_group_texts_do_not_move_the_posts(spark):
    keys = spark.createDataFrame([("T1", "positive", i) for i in range(3)], "team_id string, sentiment_category string, part_no long")
    start = F.lit("2024-01-02").cast("date")
    parts = keys.withColumns({"feedback_start_date": start, "feedback_end_date": start, "numbered_posts": F.array(F.lit("x"))})
    groups = parts.select(*weekly.GROUP).distinct().withColumn("detailed_summary", F.lit("said"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = summaries.attach_to_parts(parts, groups)
        plan = done._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows(done, "part_no", "detailed_summary") == [(0, "said"), (1, "said"), (2, "said")]


def test_only_the_columns_to_keep_come_with_the_answers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "k int, text string")
    book = Answers(spark, str(tmp_path / "book"), "m")
    done = ask(df, F.concat("text", F.lit("?")), lambda p: p.str.upper(), "said", book, keep=["k"])
    assert done.columns == ["k", "said"] and rows(done) == [(1, "A?"), (2, "BB?"), (3, None)]


def test_a_load_and_a_rescore_store_posts_once(spark, tmp_path, monkeypatch):
    seen = []
    real = pipeline.stage
    monkeypatch.setattr(pipeline, "stage", lambda df, label: seen.append(label) or real(df, label))
    events = raw(spark, [(n, AT, post(f"{n}.0", "good" if n % 2 else "bad")) for n in range(20)])
    store = pipeline.Store(spark, str(tmp_path / "store"))
    pipeline.load_events(store, events, scorer, model="words")
    assert seen == ["fresh"] and store.read("posts").count() == 20
    other = lambda df: df.withColumn("sentiment_score", F.lit(0.5))
    assert pipeline.rescore(store, other, "half") == 1 and pipeline.rescore(store, other, "half") == 0
    assert seen == ["fresh"] and {r[0] for r in rows(store.read("posts"), "sentiment_score")} == {0.5}
    again = raw(spark, [(n, AT, post(f"{n}.0", f"bad {m}")) for n in (3, 30) for m in range(2)])
    pipeline.load_events(store, again, scorer, model="words")
    assert seen[1:] == ["fresh", "base", "posts"] and store.read("posts").count() == 21
