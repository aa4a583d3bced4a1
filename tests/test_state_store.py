"""State of streams outlives the query that built it, on disk and by change log."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.operators.sentiment import lexicon_scorer
from feedloom.streaming import feeds
from tests.events import lexicon, post, raw, rows

W1, W2 = "2024-01-03 09:00:00", "2024-01-10 09:00:00"
FIRST = [(n, W1, post(f"{n}.0", "good" if n % 2 else "bad")) for n in range(40)]
SECOND = [(n, W1 if n < 50 else W2, post(f"{n}.0", "good" if n % 2 else "bad")) for n in range(20, 60)]


@pytest.fixture
def arrive(spark, tmp_path):
    source = str(tmp_path / "in")

    def write(events):
        raw(spark, events).coalesce(1).write.mode("append").parquet(source)
        return source

    return write


def test_ids_seen_before_a_restart_are_known_after_it(spark, arrive, tmp_path):
    out = str(tmp_path / "out")
    assert feeds.stream_deduplicated(spark, arrive(FIRST), out).count() == 40
    done = feeds.stream_deduplicated(spark, arrive(SECOND), out)  # a new query that starts from the checkpoint
    assert [r[0] for r in rows(done, "id")] == sorted(range(60), key=str)
    assert feeds.stream_deduplicated(spark, arrive(FIRST + SECOND), out).count() == 60
    state = Path(out, "checkpoint", "state")
    assert list(state.rglob("*.changelog")) and not list(state.rglob("*.delta"))


def test_weekly_state_goes_on_after_a_restart(spark, arrive, tmp_path):
    out, scorer = str(tmp_path / "out"), lexicon_scorer(lexicon(spark))
    feeds.stream_weekly_sentiment(spark, arrive(FIRST), out, scorer)
    source = arrive([e for e in SECOND if e[0] >= 40])
    done = feeds.stream_weekly_sentiment(spark, source, out, scorer)
    counts = done.groupBy("sentiment_category").agg(F.sum("number_of_posts"))
    assert rows(counts) == [("negative", 30), ("positive", 30)]
    assert done.count() == 4 and done.agg(F.max("number_of_posts")).first()[0] == 25
    assert list(Path(out, "checkpoint", "state").rglob("*.changelog"))
