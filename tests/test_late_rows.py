"""Late rows are counted, kept on record, and added to the same totals."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators.sentiment import lexicon_scorer
from feedloom.streaming import feeds
from tests.events import lexicon, post, raw, reply, rows

OLD, W1, W2 = "2023-06-07 09:00:00", "2024-01-03 09:00:00", "2024-01-10 09:00:00"


@pytest.fixture
def arrive(spark, tmp_path):
    def write(events):
        raw(spark, events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return write


def test_late_rows_are_counted_and_logged(spark, arrive, tmp_path):
    scorer, source = lexicon_scorer(lexicon(spark)), str(tmp_path / "in")

    def drain():
        return feeds.stream_weekly_totals(spark, source, str(tmp_path / "out"), scorer, "2 days")

    arrive([(1, OLD, post("1.0", "good")), (2, W1, post("2.0", "bad")), (3, W1, reply("3.0", "2.0")), (4, W1, post("4.0", "nothing"))])
    totals = drain()
    assert totals.late().count() == 0  # nothing came before
    arrive([(5, OLD, post("5.0", "good good bad")), (6, W2, post("6.0", "good")), (7, None, post("7.0", "bad"))])
    totals = drain()
    assert rows(totals.late(), "id") == [(5,)]
    arrive([(8, W1, post("8.0", "bad")), (9, W2, post("9.0", "good")), (10, W2, post("10.0", "good", team=None))])
    totals = drain()
    got = rows(totals.current(), F.col("feedback_start_date").cast("string"), "sentiment_category", F.round("avg_sentiment_score", 6), "number_of_posts", "late_posts")
    assert got == sorted(
        [("2023-06-06", "positive", 0.666667, 2, 1), ("2024-01-02", "negative", -1.0, 2, 1), ("2024-01-09", "positive", 1.0, 2, 0), (None, "negative", -1.0, 1, 0)],
        key=lambda r: [(v is None, str(v)) for v in r],
    )
    assert rows(totals.late(), "id") == [(5,), (8,)]
    before = rows(totals.current())
    assert rows(drain().current()) == before  # nothing new


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    totals = feeds.WeeklyTotals(spark, str(tmp_path / "t"), "1 hour")
    assert totals.current().count() == 0 and totals.late() is None
    table = lambda *at: feeds.posts(
        feeds.base_events(raw(spark, [(n, t, post(f"{n}.0", "good")) for n, t in enumerate(at)])), lexicon_scorer(lexicon(spark))
    )
    totals.write(table(W2, W1), 0)
    totals.write(table(W1, W2), 1)
    once = rows(totals.current())
    totals.write(table(W1, W2), 1)
    assert rows(totals.current()) == once and totals.late().count() == 1
    assert sum(r["late_posts"] for r in totals.current().collect()) == 1
