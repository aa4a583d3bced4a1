"""Answers of a text model: asked once, kept, asked again only where a call failed."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.operators import answers
from feedloom.operators.answers import Answers, Unanswered, ask
from feedloom.plans import pipeline
from feedloom.operators.sentiment import lexicon_scorer
from tests.events import lexicon, post, raw, rows


class Noted:
    """A generator that notes each call in a folder; it fails on the first ``failures`` calls with a prompt."""

    def __init__(self, folder, failures=0, only=None, name="re"):
        self.folder, self.failures, self.only, self.name = folder, failures, only, name
        folder.mkdir(exist_ok=True)

    def __call__(self, prompts):
        import hashlib

        for kind, key in [("asked", p) for p in prompts] + [("call", "\0".join(sorted(prompts)))]:
            with open(self.folder / f"{kind}-{hashlib.md5(key.encode()).hexdigest()}", "a") as note:
                note.write("x")
        call = "\0".join(sorted(prompts))
        turn = len((self.folder / f"call-{hashlib.md5(call.encode()).hexdigest()}").read_text())
        if turn <= self.failures and (self.only is None or self.only in call):
            raise ConnectionError("try later")
        return pd.Series([f"{self.name}: {p}" for p in prompts])

    def times(self, kind="asked"):
        return sorted(len(f.read_text()) for f in self.folder.glob(f"{kind}-*"))


@pytest.fixture
def book(spark, tmp_path):
    return Answers(spark, str(tmp_path / "book"), "m")


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def wanted(texts, name="re"):
    return [(i, t, None if t is None else f"{name}: {t}") for i, t in enumerate(texts)]


def test_each_prompt_is_asked_once_and_never_again(spark, tmp_path, book):
    texts = ["a", "b", None, "a", "", "c" * 50, "a"]
    one, two = Noted(tmp_path / "one"), Noted(tmp_path / "two")
    df = prompts(spark, texts)
    assert rows(ask(df, F.col("text"), one, "answer", book, batch=2)) == wanted(texts)
    assert one.times() == [1, 1, 1, 1]
    more = prompts(spark, [*texts, "new"])
    assert rows(ask(more, F.col("text"), two, "answer", book)) == wanted([*texts, "new"])
    assert two.times() == [1]
    other = Answers(spark, book.folder, "n")
    three = Noted(tmp_path / "three", name="other")
    assert rows(ask(df, F.col("text"), three, "answer", other)) == wanted(texts, "other")
    assert rows(ask(df, F.col("text"), two, "answer", book)) == wanted(texts) and two.times() == [1]


def test_a_generator_that_fails_once_per_call_answers_each_prompt_once(spark, tmp_path, book):
    texts = [f"prompt {i}" for i in range(23)]
    generator = Noted(tmp_path / "notes", failures=1)
    assert rows(ask(prompts(spark, texts), F.col("text"), generator, "answer", book, batch=4)) == sorted(wanted(texts), key=str)
    assert generator.times("call") == [2] * len(generator.times("call"))
    answered = book.known()
    assert answered.count() == 23 and answered.select("prompt_key").distinct().count() == 23
    assert book.rounds().filter("error IS NOT NULL").count() == 23


def test_answers_beside_a_failure_are_kept(spark, tmp_path, book):
    texts = [f"prompt {i}" for i in range(9)] + ["poison"]
    df = prompts(spark, texts)
    bad = Noted(tmp_path / "bad", failures=99, only="poison")
    with pytest.raises(Unanswered, match="1 prompts .* after 3 tries.*ConnectionError: try later"):
        ask(df, F.col("text"), bad, "answer", book, batch=1)
    assert bad.times() == [1] * 9 + [3] and book.known().count() == 9
    good = Noted(tmp_path / "good")
    assert rows(ask(df, F.col("text"), good, "answer", book)) == sorted(wanted(texts), key=str)
    assert good.times() == [1]


def test_finished_tasks_outlive_a_run_that_dies(spark, tmp_path, book):
    """A task that kills the whole job leaves the answers of the tasks before it."""
    texts = [f"prompt {i}" for i in range(8)]
    df = prompts(spark, texts)
    keyed = df.select(F.sha2("text", 256).alias("prompt_key"), "text").repartition(1).sortWithinPartitions("text")
    done = keyed.selectExpr("prompt_key", "'m' AS model", "'re: ' || text AS answer", "CAST(NULL AS STRING) AS error")
    marked = done.repartitionByRange(4, "answer").withColumn("answer", F.when(
        F.spark_partition_id() < 3, F.col("answer")).otherwise(F.raise_error(F.lit("dies")).cast("string")))
    with pytest.raises(Exception, match="dies"):
        book.add(marked)
    kept = book.known().count()
    again = Noted(tmp_path / "again")
    assert rows(ask(df, F.col("text"), again, "answer", book)) == wanted(texts)
    assert len(again.times()) == 8 - kept


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "old", 5), (1, "x", "old", 5)], "id long, _prompt string, answer string, _answer int")
    got = ask(df, F.col("_prompt"), lambda p: p + "!", "answer")
    assert got.columns == ["id", "_prompt", "_answer", "answer"] and rows(got) == [(1, "x", 5, "x!")] * 2
    assert ask(df.limit(0), F.col("_prompt"), lambda p: p, "answer").count() == 0
    none = ask(df, F.lit(None).cast("string"), lambda p: p, "answer")
    assert rows(none, "answer") == [(None,)] * 2
    empty = ask(df, F.col("_prompt"), lambda p: pd.Series([None] * len(p)), "answer")
    assert rows(empty, "answer") == [(None,)] * 2  # an answer, not a failure
    with pytest.raises(Unanswered, match="0 answers to 1 prompts"):
        ask(df, F.col("_prompt"), lambda p: p[:0], "answer", tries=1)


def test_calls_keep_to_rows_and_characters():
    frame = pd.DataFrame({"prompt": ["aa", "bb", "c" * 9, "d", "e", "f", "g"]})
    assert [list(c["prompt"].str[0]) for c in answers._calls(frame, 3, 4)] == [["a", "b"], ["c"], ["d", "e", "f"], ["g"]]
    assert list(answers._calls(frame[:0], 3, 4)) == []


def test_a_prompt_of_most_rows_is_asked_once(spark, tmp_path, book):
    df = spark.range(5000).withColumn("text", F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.concat(F.lit("p"), F.col("id") % 50)))
    noted = Noted(tmp_path / "notes")
    got = ask(df, F.col("text"), noted, "answer", book)
    assert got.filter(F.col("answer") == F.concat(F.lit("re: "), "text")).count() == 5000
    assert noted.times() == [1] * 51


def test_a_repeated_run_of_the_pipeline_asks_only_what_failed(spark, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "s"))
    events = raw(spark, [
        (1, "2024-01-03 09:00:00", post("1.0", "good one")), (2, "2024-01-03 10:00:00", post("2.0", "bad two")),
        (3, "2024-01-10 09:00:00", post("3.0", "good three", "T2")),
    ])
    pipeline.load_events(store, events, lexicon_scorer(lexicon(spark)))
    now = "2024-02-01 00:00:00"
    bad = Noted(tmp_path / "bad", failures=99, only="bad two")
    # All prompts of a call fail together, so the first run may keep few answers, but it keeps those.
    with pytest.raises(Unanswered):
        pipeline.emit_summaries(store, now, generator=bad, generator_model="m")
    assert store.find("summary") is None
    kept = Answers(spark, f"{store.root}/answers", "m").known().count()
    good = Noted(tmp_path / "good")
    done = pipeline.emit_summaries(store, now, generator=good, generator_model="m")
    assert done.count() == 3 and len(good.times()) == 6 - kept
    assert done.filter("detailed_summary LIKE 're: Summarize%' AND open_ended_question LIKE 're: Based on%'").count() == 3
