import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.operators import sentiment, summaries
from feedloom.functions.text import SUMMARY_PROMPT_HEAD, SUMMARY_PROMPT_TAIL
from feedloom.operators.sentiment import lexicon_scorer
from feedloom.plans import marts, views
from feedloom.sources import raw_events as raw_source
from feedloom.sources import tables
from tests.events import lexicon, post, raw, reaction, reply, rows

TUE, MON, NEXT = "2024-01-02 09:00:00", "2024-01-08 23:59:59", "2024-01-09 00:00:00"

RAW = [
    (1, TUE, post("1.0", "good coffee")),
    (2, MON, post("2.0", "great desks and great chairs")),
    (3, NEXT, post("3.0", "good lunch")),
    (4, TUE, post("4.0", "bad wifi", bot_id="B1")),
    (5, TUE, post("5.0", "plain words")),
    (6, TUE, post("6.0", "good idea", team=None)),
    (7, TUE, post("7.0", "awful", team="T2")),
    (8, NEXT, reply("8.0", "1.0")),
    (9, NEXT, reaction("9.0", "1.0")),
    (10, NEXT, reaction("10.0", "1.0", user="U3")),
]


@pytest.fixture(scope="module")
def events(spark):
    return marts.staged_events(raw(spark, RAW), lexicon_scorer(lexicon(spark)))


@pytest.fixture(scope="module")
def summary(events):
    return marts.post_summary(events).cache()


def test_summary_rows(summary):
    assert summary.columns == [*schemas.SUMMARY_COLUMNS, "part_no"]
    got = {(r.team_id, r.sentiment_category, str(r.feedback_start_date)): r for r in summary.collect()}
    assert set(got) == {  # neutral posts and posts without a team are left out
        ("T1", "positive", "2024-01-02"), ("T1", "positive", "2024-01-09"),
        ("T1", "negative", "2024-01-02"), ("T2", "negative", "2024-01-02"),
    }
    first = got["T1", "positive", "2024-01-02"]
    assert first.numbered_weighted_posts == (
        "1. good coffee (weight: 1.7) 2. great desks and great chairs (weight: 1.0)"
    )
    assert first.detailed_summary == "- good coffee\n- great desks and great chairs"
    assert first.open_ended_question == "What are your thoughts on coffee, good?"
    assert (first.avg_sentiment_score, first.feedback_end_date) == (1.0, dt.date(2024, 1, 7))


def test_each_part_carries_the_summary_of_its_group(events):
    cut = marts.post_summary(events, part_chars=50)
    parts = cut.filter("team_id = 'T1' AND sentiment_category = 'positive'").orderBy("feedback_start_date", "part_no")
    got = [(r.part_no, r.numbered_weighted_posts, r.detailed_summary) for r in parts.collect()]
    both = "- good coffee\n- great desks and great chairs"
    assert got[:2] == [
        (1, "1. good coffee (weight: 1.7)", both), (2, "2. great desks and great chairs (weight: 1.0)", both),
    ]
    latest = views.latest_summary(cut, "positive", "T1").collect()
    assert len(latest) == 1 and latest[0].detailed_summary == "- good lunch"


def test_generator_sees_one_prompt_per_row(events):
    done = marts.post_summary(events, generator=lambda prompts: prompts.str.slice(0, 9))
    assert {(r.detailed_summary, r.open_ended_question) for r in done.collect()} == {("Summarize", "Based on ")}


def test_generator_answers_the_parts_and_then_their_answers(events):
    done = marts.post_summary(events, part_chars=50, generator=lambda prompts: prompts.str.len().astype(str))
    rows = done.filter("team_id = 'T1' AND sentiment_category = 'positive' AND feedback_start_date = '2024-01-02'")
    frame = len(SUMMARY_PROMPT_HEAD) + len(SUMMARY_PROMPT_TAIL)
    texts = ["1. good coffee (weight: 1.7)", "2. great desks and great chairs (weight: 1.0)"]
    answers = " ".join(str(frame + len(t)) for t in texts)
    assert [r.detailed_summary for r in rows.collect()] == [str(frame + len(answers))] * 2


def test_emission_modes(spark, events):
    emitted = spark.createDataFrame([("2024-01-02",)], "d string").select(F.col("d").cast("date").alias("feedback_start_date"))
    closed = marts.post_summary(events, None, "2024-01-10 00:00:00", "closed")
    assert {str(r[0]) for r in rows(closed, "feedback_start_date")} == {"2024-01-02"}
    seen = marts.post_summary(events, emitted, None, "first_seen")
    assert {str(r[0]) for r in rows(seen, "feedback_start_date")} == {"2024-01-09"}


def test_question_without_topics(spark):
    columns = "team_id string, sentiment_category string, rank int, event_text string"
    df = spark.createDataFrame([("T", "positive", 1, "a b. no")], columns)
    df = df.withColumns({c: F.lit("2024-01-02").cast("date") for c in ("feedback_start_date", "feedback_end_date")})
    assert summaries.open_question(df).first().open_ended_question == "What would you like to talk about this week?"


def test_read_views(spark, events, summary):
    table = views.feedback_table(summary)
    assert table.columns == [
        "part_no", "sentiment_category", "avg_sentiment_score", "numbered_weighted_posts", "detailed_summary", "open_ended_question",
    ]
    assert views.feedback_table(summary, range=("2024-01-09", "2024-01-09")).count() == 1
    series = [r.event_time for r in views.sentiment_series(events.posts).collect()]
    assert series == sorted(series) and len(series) == 7
    assert rows(views.bot_post_counts(events.posts)) == [(False, 6, "With Name"), (True, 1, "Anonymous")]
    assert views.latest_summary(summary, "positive", "nobody").count() == 0


def test_latest_and_message(summary):
    got = {(r.team_id, r.sentiment_category): r for r in views.with_message(views.latest_summaries(summary)).collect()}
    assert set(got) == {("T1", "positive"), ("T1", "negative"), ("T2", "negative")}
    assert got["T1", "positive"].message == (
        "For the week of Jan 09 to Jan 14, the summarized feedback is: - good lunch"
    )


def test_digest_question_and_deliveries(spark, summary):
    digest = views.weekly_digest(summary)
    messages = dict(rows(digest, "team_id", "message"))
    assert messages["T2"] == (
        "\nHere is the feedback for the week of 2024-01-02 to 2024-01-07:\n\n*Negative Feedback:*\n- awful\n      "
    )
    assert "2024-01-02" not in messages["T1"]  # only the latest week
    members = spark.createDataFrame([("T1", "a"), ("T1", "b"), ("T2", "c"), ("T3", "d")], "team_id string, user_id string")
    sent = views.digest_deliveries(digest, members, hot_rows=1)
    assert rows(sent, "team_id", "user_id") == [("T1", "a"), ("T1", "b"), ("T2", "c")]
    assert dict(rows(views.weekly_question(summary)))["T1"] == "What are your thoughts on good, lunch?"


def test_digest_has_a_paragraph_per_class(spark):
    both = spark.createDataFrame(
        [("T", "positive", "yes"), ("T", "negative", "no")], "team_id string, sentiment_category string, detailed_summary string"
    ).withColumns({c: F.lit("2024-01-02").cast("date") for c in ("feedback_start_date", "feedback_end_date")})
    message = views.weekly_digest(both).first().message
    assert message.index("*Negative Feedback:*\nno") < message.index("\n\n\nHere is") < message.index("*Positive Feedback:*\nyes")


def test_lexicon_scores_whole_words(spark):
    texts = [(1, "GOOD, good!bad"), (2, "goodness"), (3, ""), (4, None), (5, "bad2good_x")]
    df = spark.createDataFrame(texts, "id int, event_text string")
    scored = sentiment.score_sentiment(df, lexicon(spark))
    assert dict(rows(scored.select("id", F.round("sentiment_score", 6)))) == {1: 0.333333, 2: 0.0, 3: 0.0, 4: None, 5: 0.0}


@pytest.mark.parametrize("small", [True, False])
def test_long_lexicon_path_equals_inline_path(spark, monkeypatch, small):
    df = spark.createDataFrame([(i, "good bad great word " * i) for i in range(6)], "id int, event_text string")
    inline = rows(sentiment.score_sentiment(df, lexicon(spark)), "id", "sentiment_score")
    monkeypatch.setattr(sentiment, "INLINE_LEXICON", 2)
    monkeypatch.setattr(sentiment, "small_enough", lambda df: small)
    assert rows(sentiment.score_sentiment(df, lexicon(spark)), "id", "sentiment_score") == inline


def test_function_and_trained_scorers(spark):
    texts = [("good great", 1.0), ("great fun good", 1.0), ("bad awful", 0.0), ("awful bad mess", 0.0)] * 5
    labelled = spark.createDataFrame(texts, "text string, label double")
    model = sentiment.train_scorer(labelled, features=1 << 10)
    scored = sentiment.model_score(labelled, model)
    assert all(-1 <= r.sentiment_score <= 1 and (r.sentiment_score > 0) == (r.label == 1.0) for r in scored.collect())
    limited = sentiment.score_with(labelled, lambda t: t.str.len() * 1.0, "text")
    assert {r.sentiment_score for r in limited.collect()} == {1.0}


def test_raw_events_are_idempotent(spark, tmp_path):
    payload = spark.createDataFrame([("message", "hi", None)], "type string, text string, user string")
    first = raw_source.to_raw_events(payload, ingest_ts="2024-01-01 00:00:00")
    assert first.collect() == raw_source.to_raw_events(payload, ingest_ts="2024-01-01 00:00:00").collect()
    assert first.columns == ["id", "event_time", "raw_event"]
    raw_source.append_raw_events(first, str(tmp_path / "raw"))
    raw_source.append_raw_events(first, str(tmp_path / "raw"))
    assert raw_source.read_raw_events(spark, str(tmp_path / "raw")).count() == 2
    for fmt in ("json", "orc"):
        raw_source.append_raw_events(first, str(tmp_path / fmt), fmt)
        assert raw_source.read_raw_events(spark, str(tmp_path / fmt), fmt).collect() == first.collect()


def test_full_write_and_json_export(spark, tmp_path, summary):
    path = str(tmp_path / "full")
    tables.write_full(summary, path)
    tables.write_full(summary.limit(1), path)
    assert tables.read_table(spark, path).count() == 1
    assert tables.read_table(spark, str(tmp_path / "none")) is None
    tables.export_json(views.feedback_table(summary), str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == 4 and set(back.columns) == set(views.feedback_table(summary).columns)
