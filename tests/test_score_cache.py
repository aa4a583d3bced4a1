"""Scores remembered by text and model."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import score_cache
from feedloom.operators.sentiment import lexicon_scorer
from feedloom.plans import pipeline
from tests.events import control, lexicon, post, raw, rows

W1, W2, W3 = "2024-01-03 09:00:00", "2024-01-10 09:00:00", "2024-01-17 09:00:00"
EVENTS = [
    (1, W1, post("1.0", "good one")), (2, W1, post("2.0", "bad two")), (3, W2, post("3.0", "good one")),
    (4, W2, post("4.0", "nothing")), (5, W3, post("5.0", "awful five")), (6, W3, post("6.0", "bad two")),
]


class Counted:
    """A scorer that notes the texts it is given."""

    def __init__(self, score):
        self.score = score
        self.texts = []

    def __call__(self, df):
        self.texts += [r[0] for r in df.select("event_text").collect()]
        return self.score(df)


def flat(value):
    return lambda df: df.withColumn("sentiment_score", F.when(F.col("event_text").isNotNull(), F.lit(value) + F.length("event_text") / 1000))


def never(df):
    return df.withColumn("sentiment_score", F.raise_error(F.lit("scored again")).cast("double"))


@pytest.fixture
def store(spark, tmp_path):
    return pipeline.Store(spark, str(tmp_path / "s"))


@pytest.mark.parametrize("few", [True, False])
def test_each_text_is_scored_once_by_each_model(spark, monkeypatch, few):
    monkeypatch.setattr(score_cache, "small_enough", lambda df: few)
    texts = [(1, "good good bad"), (2, "x"), (2, "x"), (None, None), (3, None), (4, ""), (5, "good good bad"), (None, "bad")]
    df = spark.createDataFrame(texts, "id int, event_text string")
    scorer = lexicon_scorer(lexicon(spark))
    counted = Counted(scorer)
    first, fresh = score_cache.cached_scores(df, counted, None, "a")
    assert sorted(counted.texts, key=str) == sorted(["good good bad", "x", None, "", "bad"], key=str)
    assert rows(first) == rows(scorer(df)) and first.columns == ["id", "event_text", "sentiment_score"]
    again, none = score_cache.cached_scores(df, never, fresh, "a")
    assert rows(again) == rows(first) and none.count() == 0
    more = df.union(spark.createDataFrame([(9, "great"), (9, "great")], df.schema))
    counted = Counted(scorer)
    third, new = score_cache.cached_scores(more, counted, fresh, "a")
    assert counted.texts == ["great"] and new.count() == 1 and rows(third) == rows(scorer(more))
    other, all_new = score_cache.cached_scores(df, flat(0.5), fresh, "b")
    assert all_new.count() == 5 and {r[2] for r in rows(other) if r[1]} == {0.513, 0.501, 0.503}
    assert score_cache.cached_scores(df.limit(0), scorer, fresh, "a")[0].count() == 0


def test_heavy_texts_are_joined_over_salts(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "good").otherwise(F.col("id").cast("string")).alias("event_text"))
    scorer = lexicon_scorer(lexicon(spark))
    _, fresh = score_cache.cached_scores(df, scorer, None, "a")
    done, none = score_cache.cached_scores(df, never, fresh, "a")
    assert fresh.count() == 1001 and none.count() == 0
    assert done.agg(F.count("id"), F.sum("sentiment_score")).first()[:] == (3000, 2000.0)


def test_loads_call_the_scorer_for_new_texts_only(spark, store):
    scorer = lexicon_scorer(lexicon(spark))
    first, second = Counted(scorer), Counted(scorer)
    pipeline.load_events(store, raw(spark, EVENTS[:3]), first, model="words")
    pipeline.load_events(store, raw(spark, EVENTS), second, model="words")
    assert sorted(first.texts) == ["bad two", "good one"] and sorted(second.texts) == ["awful five", "nothing"]
    plain = pipeline.Store(spark, f"{store.root}-plain")
    pipeline.load_events(plain, raw(spark, EVENTS), scorer)
    assert rows(store.read("posts")) == rows(plain.read("posts"))
    assert plain.find("scores") is None


def test_a_new_model_changes_every_score_and_an_equal_one_none(spark, store):
    pipeline.load_events(store, raw(spark, EVENTS), lexicon_scorer(lexicon(spark)), model="words")
    before, version = rows(store.read("posts")), store.version
    assert pipeline.rescore(store, never, "words") == 0
    assert rows(store.read("posts")) == before and store.version == version
    counted = Counted(flat(0.25))
    assert pipeline.rescore(store, counted, "flat") == 3
    assert sorted(counted.texts) == ["awful five", "bad two", "good one", "nothing"]
    got = {r["id"]: r["sentiment_score"] for r in store.read("posts").collect()}
    assert got == {i: 0.25 + len(p["text"]) / 1000 for i, _, p in EVENTS}
    assert pipeline.rescore(store, never, "words") == 3  # all remembered
    assert rows(store.read("posts")) == before
    pipeline.compact_scores(store, ["words"])
    assert store.read("scores").count() == 4 and pipeline.rescore(store, never, "words") == 0


def test_a_run_that_dies_goes_on_where_it_stopped(spark, store):
    pipeline.load_events(store, raw(spark, EVENTS), lexicon_scorer(lexicon(spark)), model="words")

    class Dies(Counted):
        def __call__(self, df):
            if len(self.texts) > 2:
                raise RuntimeError("killed")
            return super().__call__(df)

    dying = Dies(flat(0.25))
    with pytest.raises(RuntimeError, match="killed"):
        pipeline.rescore(store, dying, "flat")
    assert len(rows(pipeline.Store(spark, store.root).read("posts"))) == len(EVENTS)
    rest = Counted(flat(0.25))
    assert pipeline.rescore(pipeline.Store(spark, store.root), rest, "flat") == 1
    assert sorted(dying.texts + rest.texts) == ["awful five", "bad two", "good one", "nothing"]


def test_deleted_and_rescored(spark, store):
    deletes = control(spark, [("message_deleted", W3, "2.0", None, None)])
    pipeline.load_events(store, raw(spark, EVENTS), lexicon_scorer(lexicon(spark)), deletes, model="words")
    assert pipeline.rescore(store, flat(0.25), "flat") == 3
    assert [r[0] for r in rows(store.read("posts"), "id")] == [1, 3, 4, 5, 6]
