"""Versions of the store: readers see one whole version, dead runs leave none."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import changes
from feedloom.operators.sentiment import lexicon_scorer
from feedloom.plans import pipeline
from feedloom.session import stage
from feedloom.sources.snapshots import Conflict
from tests.events import control, lexicon, post, raw, rows
from tests.test_pipeline import DELETES, EVENTS, contents


@pytest.fixture(scope="module")
def scorer(spark):
    return lexicon_scorer(lexicon(spark))


def everything(store):
    return {**contents(store), "summary": store.find("summary") and rows(store.find("summary"))}


def test_reader_opened_before_a_run_keeps_its_version(spark, scorer, tmp_path):
    store = pipeline.Store(spark, str(tmp_path))
    pipeline.run_pipeline(store, raw(spark, EVENTS[:4]), scorer, now="2024-02-01 00:00:00")
    reader = pipeline.Store(spark, str(tmp_path))
    before, frame = everything(reader), reader.read("posts")
    pipeline.run_pipeline(store, raw(spark, EVENTS), scorer, control(spark, DELETES), now="2024-02-01 00:00:00")
    assert everything(reader) == before and rows(frame) == before["posts"]
    reader.refresh()
    assert everything(reader) == everything(store) != before
    assert [everything(pipeline.Store(spark, str(tmp_path), v))["posts"] for v in (1, 2)] == [before["posts"], rows(store.read("posts"))]


@pytest.mark.parametrize("name", ["control", "posts", "summary"])
def test_run_killed_between_tables_changes_nothing(spark, scorer, tmp_path, monkeypatch, name):
    store = pipeline.Store(spark, str(tmp_path))
    pipeline.run_pipeline(store, raw(spark, EVENTS[:4]), scorer, now="2024-02-01 00:00:00")
    before = everything(store)
    write = store.snapshots.write

    def dies(table, *args):
        folders = write(table, *args)
        if table == name:
            raise KeyboardInterrupt
        return folders

    monkeypatch.setattr(store.snapshots, "write", dies)
    run = (raw(spark, EVENTS), scorer, control(spark, DELETES))
    with pytest.raises(KeyboardInterrupt):
        pipeline.run_pipeline(store, *run, now="2024-02-01 00:00:00")
    assert everything(store) == everything(pipeline.Store(spark, str(tmp_path))) == before
    monkeypatch.undo()
    pipeline.run_pipeline(store, *run, now="2024-02-01 00:00:00")
    assert [r[0] for r in rows(store.read("base"), "id")] == [1, 3, 5, 6, 7, 8]


def test_two_runs_cannot_publish_the_same_version(spark, scorer, tmp_path):
    one, other = (pipeline.Store(spark, str(tmp_path)) for _ in range(2))
    pipeline.load_events(one, raw(spark, EVENTS[:2]), scorer)
    with pytest.raises(Conflict):
        pipeline.load_events(other, raw(spark, EVENTS), scorer)
    other.refresh()
    pipeline.load_events(other, raw(spark, EVENTS), scorer)
    assert [r[0] for r in rows(other.read("base"), "id")] == [r[0] for r in rows(raw(spark, EVENTS), "id")]


def test_unchanged_weeks_keep_their_folders_and_old_versions_expire(spark, scorer, tmp_path):
    store = pipeline.Store(spark, str(tmp_path))
    pipeline.load_events(store, raw(spark, EVENTS[:4]), scorer)
    first = set(store._folders["base"])
    pipeline.load_events(store, raw(spark, EVENTS), scorer)
    assert {f.split("/")[1] for f in store._folders["base"]} > {f.split("/")[1] for f in first}
    whole = contents(store)
    store.snapshots.expire(keep=1)
    assert store.snapshots.versions() == [2] and contents(pipeline.Store(spark, str(tmp_path))) == whole


def test_rows_without_a_time_are_scored_once(spark, tmp_path):
    texts = []

    def counting(df):
        texts.append(sorted(r[0] for r in df.select("event_text").collect()))
        return df.withColumn("sentiment_score", F.lit(1.0))

    store = pipeline.Store(spark, str(tmp_path))
    timeless = [(20, None, post("20.0", "twenty")), (21, None, post("21.0", "twenty-one"))]
    for events in (EVENTS[:1] + timeless[:1], EVENTS[:1] + timeless):
        pipeline.load_events(store, raw(spark, events), counting)
    assert "twenty" in texts[0] and "twenty-one" in texts[1] and "twenty" not in texts[1]
    assert [r[0] for r in rows(store.read("base").filter("event_time IS NULL"), "id")] == [20, 21]


def test_marking_stores_narrow_keys_only(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(changes, "small_enough", lambda *a: False)
    monkeypatch.setattr(changes, "stage", lambda df, label: staged.append(df.columns) or stage(df, label))
    kept = changes.apply_changes(raw(spark, EVENTS), control(spark, DELETES), hot_rows=1)
    assert [r[0] for r in rows(kept, "id")] == [1, 3, 5, 6, 7, 8]
    assert staged and all("raw_event" not in columns for columns in staged)
