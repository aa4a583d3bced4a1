"""One score whatever the length of the word list."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import sentiment
from feedloom.streaming import feeds
from tests.events import LEXICON, post, raw, rows

TEXTS = [
    (1, "good good bad"), (2, "nothing here"), (3, ""), (4, None), (5, "GOOD,bad!awful bad"), (5, "great"), (None, "bad bad"),
    (None, None), (6, "good good bad"), (7, "both twice none zero"),
]
ODD = [("both", 1), ("both", -1), ("twice", -1), ("twice", -1), ("none", None), ("zero", 0), (None, 1)]


def listed(spark, words):
    more = [(f"unused{'abcdefghij'[n % 10]}{n}", 1 - 2 * (n % 2)) for n in range(words)]
    return spark.createDataFrame(LEXICON + ODD + more, "token string, polarity int")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, event_text string")


def test_short_long_and_joined_lists_score_alike(spark, texts, monkeypatch):
    want = [
        (1, "good good bad", 0.333333), (2, "nothing here", 0.0), (3, "", 0.0), (4, None, None), (5, "GOOD,bad!awful bad", -0.5),
        (5, "great", 1.0), (None, "bad bad", -1.0), (None, None, None), (6, "good good bad", 0.333333), (7, "both twice none zero", 0.0),
    ]

    def scored(words):
        out = sentiment.score_sentiment(texts, listed(spark, words))
        assert out.columns == ["id", "event_text", "sentiment_score"]
        return rows(out, "id", "event_text", F.round("sentiment_score", 6))

    assert scored(10) == scored(10_000) == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])
    monkeypatch.setattr(sentiment, "small_enough", lambda df: False)
    assert scored(10) == scored(10_000) == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])


def test_long_list_scores_without_a_shuffle(spark, texts):
    plan = sentiment.score_sentiment(texts, listed(spark, 10_000))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_long_list_scores_a_stream(spark, tmp_path):
    events = raw(spark, [(n, "2024-01-02 10:00:00", post(f"{n}.0", text)) for n, text in enumerate(["good bad", "bad", "great good"])])
    events.write.parquet(str(tmp_path / "feed"))

    def weekly(words):
        scorer = sentiment.lexicon_scorer(listed(spark, words))
        return rows(feeds.stream_weekly_sentiment(spark, str(tmp_path / "feed"), str(tmp_path / f"w{words}"), scorer))

    assert len(weekly(10)) == 2 and weekly(10_000) == rows(
        feeds.stream_weekly_sentiment(spark, str(tmp_path / "feed"), str(tmp_path / "again"), sentiment.lexicon_scorer(listed(spark, 10)))
    )


def test_list_beyond_the_table_is_refused_on_a_stream(spark, tmp_path, texts, monkeypatch):
    texts.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "t"))
    monkeypatch.setattr(sentiment, "small_enough", lambda df: False)
    with pytest.raises(ValueError):
        sentiment.score_sentiment(stream, listed(spark, 10))


def test_common_words_of_a_long_list_are_scored_in_place(spark, monkeypatch):
    listed = [(f"w{chr(97 + n // 26)}{chr(97 + n % 26)}", 1 if n % 3 else -1) for n in range(120)]
    names = [w for w, _ in listed]
    texts = [(n, " ".join([names[n % 4]] * 9 + [names[(7 * n) % 120], "unlisted", "unlisted", f"rare{chr(97 + n % 26)}"])) for n in range(200)]
    texts += [(900, texts[0][1]), (None, texts[1][1]), (901, None), (902, ""), (903, "none of them")]
    docs = spark.createDataFrame(texts, "id long, event_text string")
    words = spark.createDataFrame(listed, "token string, polarity int")
    in_place = sentiment.score_sentiment(docs, words)
    stored = {}
    real = sentiment.stage

    def stage(df, label):
        stored[label] = real(df, label)
        return stored[label]

    monkeypatch.setattr(sentiment, "stage", stage)
    monkeypatch.setattr(sentiment, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(sentiment, "small_enough", lambda df: False)
    joined = sentiment.score_sentiment(docs, words)
    key = lambda r: (str(r["id"]), str(r["event_text"]))
    assert sorted(joined.collect(), key=key) == sorted(in_place.collect(), key=key)
    left = {t for r in stored["texts"].collect() for t in r["rest"]}
    assert not left & {*names[:4], "unlisted"} and left & set(names)  # frequent words are not joined, others are
    monkeypatch.setattr(sentiment, "BROADCAST_ROWS", 0)  # no word is common
    assert sorted(sentiment.score_sentiment(docs, words).collect(), key=key) == sorted(in_place.collect(), key=key)
