"""A run of the pipeline leaves its store and nothing else, writes a week once and moves texts seldom."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from feedloom.operators import changes
from feedloom.operators.sentiment import lexicon_scorer
from feedloom.plans import pipeline
from feedloom.session import SCRATCH_CONF, scratch, shared_dir, stage
from feedloom.sources.tables import children
from tests.events import control, lexicon, post, raw, reaction, rows
from tests.test_pipeline import DELETES, EVENTS, W1, W2, W3, contents

NOW = "2024-02-01 00:00:00"
CODEC = "spark.sql.parquet.compression.codec"
# Rows without an id, one of them deleted, and one more deletion in each week.
LOOSE = [(None, W1, post("1.5", "bad one")), (None, W1, post("1.6", "good one")), (None, W2, reaction("5.5", "5.0"))]
MORE = [*DELETES, ("message_deleted", W3, "1.5", None, None), ("reaction_removed", W3, "5.0", "eyes", None)]


@pytest.fixture(scope="module")
def scorer(spark):
    return lexicon_scorer(lexicon(spark))


def staged(spark):
    return {name for name in children(spark, shared_dir(spark)) if name.startswith("feedloom-")}


def many(monkeypatch, limit):
    """Deletions count as too many to look up, ids as few up to ``limit``."""
    real = changes.removals
    monkeypatch.setattr(pipeline, "removals", lambda *a, **k: replace(real(*a, **k), small=False))
    monkeypatch.setattr(pipeline, "BROADCAST_IDS", limit)


@pytest.mark.parametrize("limit", [None, 0])
def test_a_run_leaves_only_its_store(spark, scorer, tmp_path, monkeypatch, limit):
    if limit is not None:
        many(monkeypatch, limit)
    before = staged(spark)
    store = pipeline.Store(spark, str(tmp_path / "s"))
    pipeline.run_pipeline(store, raw(spark, EVENTS[:6] + LOOSE), scorer, now=NOW)
    done = pipeline.run_pipeline(store, raw(spark, [*EVENTS, EVENTS[0], EVENTS[7]]), scorer, control(spark, MORE), now=NOW)
    assert staged(spark) == before
    assert [r[0] for r in rows(store.read("posts"), "id")] == [1, 5, 7, None] and done.count() > 0


def test_a_block_drops_what_is_staged_in_it_also_if_it_fails(spark):
    before, known = staged(spark), spark.conf.getAll
    with scratch(spark):
        assert all(spark.conf.get(k) == v for k, v in SCRATCH_CONF.items())
        with scratch(spark) as own:
            stage(spark.range(3), "gone")
            kept = own.keep(stage(spark.range(4), "kept"))
        assert len(staged(spark) - before) == 1 and kept.count() == 4
    assert staged(spark) == before and spark.conf.getAll == known
    with pytest.raises(ValueError), scratch(spark):
        stage(spark.range(3), "gone")
        raise ValueError
    assert staged(spark) == before and spark.conf.getAll == known
    stage(spark.range(3), "stays")
    assert len(staged(spark) - before) == 1


def test_a_block_keeps_the_settings_of_its_session(spark):
    spark.conf.set(CODEC, "zstd")
    try:
        with scratch(spark):
            assert spark.conf.get(CODEC) == "zstd"
        assert spark.conf.get(CODEC) == "zstd"
    finally:
        spark.conf.unset(CODEC)


def test_the_text_is_staged_once(spark, scorer, tmp_path, monkeypatch):
    seen = {}
    real = pipeline.stage
    monkeypatch.setattr(pipeline, "stage", lambda df, label: seen.setdefault(label, df.columns) and real(df, label))
    marked = [(1, W1, post("1.0", "Anonymous feedback: good", bot_id="B1")), (2, W1, post("2.0", "bad")), (3, W1, post("3.0", None))]
    store = pipeline.Store(spark, str(tmp_path / "s"))
    pipeline.load_events(store, raw(spark, [*marked, marked[0]]), scorer)
    for label in ("fresh", "base"):
        assert {"event_text", "anonymous_feedback_text"} & set(seen[label]) == {"anonymous_feedback_text"}
    assert store.read("base").columns == list(store._schemas["base"].names)
    found = rows(store.read("base"), "id", "event_text", "anonymous_feedback_text")
    assert found == [(1, "good", "Anonymous feedback: good"), (2, "bad", "bad"), (3, None, None)]


@pytest.mark.parametrize("limit", [None, 100, 0])
def test_deletions_by_id_equal_those_looked_up_and_write_a_table_once(spark, scorer, tmp_path, monkeypatch, limit):
    late = [(30, W2, reaction("30.0", "1.0", name="thumbsup")), (2, W2, post("2.0", "good and new"))]
    plain = pipeline.Store(spark, str(tmp_path / "plain"))
    # What is deleted never comes in, as each row is stored before its deletion.
    pipeline.load_events(plain, raw(spark, EVENTS + LOOSE + late[:1]), scorer, control(spark, MORE))
    if limit is not None:
        many(monkeypatch, limit)
    store = pipeline.Store(spark, str(tmp_path / "s"))
    pipeline.load_events(store, raw(spark, EVENTS[:6] + LOOSE), scorer)
    written = []
    write = store.snapshots.write
    monkeypatch.setattr(store.snapshots, "write", lambda name, *a: written.append(name) or write(name, *a))
    pipeline.load_events(store, raw(spark, EVENTS + late), scorer, control(spark, MORE))
    assert contents(store) == contents(plain)
    assert sorted(written) == ["base", "control", "posts", "reactions", "replies"]


def test_the_mark_is_that_of_the_rows_that_stay(spark, scorer, tmp_path, monkeypatch):
    deletes = control(spark, [("message_deleted", NOW, "7.0", None, None)])
    late = (9, W2, post("9.0", "great and late"))
    for limit in (None, 100):
        if limit is not None:
            many(monkeypatch, limit)
        store = pipeline.Store(spark, str(tmp_path / str(limit)))
        pipeline.load_events(store, raw(spark, [EVENTS[0], EVENTS[6]]), scorer)
        # Row 7 held the mark of W3; without it rows of W2 are new.
        pipeline.load_events(store, raw(spark, [EVENTS[0], EVENTS[6], late]), scorer, deletes)
        assert [r[0] for r in rows(store.read("base"), "id")] == [1, 9]


def test_texts_are_not_moved_for_few_deletions(spark, scorer, tmp_path, monkeypatch):
    many(monkeypatch, 100)
    store = pipeline.Store(spark, str(tmp_path / "s"))
    pipeline.load_events(store, raw(spark, EVENTS[:6]), scorer)
    plans = []
    replaced = pipeline.Store.replace

    def spy(self, name, df, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return replaced(self, name, df, *rest)

    monkeypatch.setattr(pipeline.Store, "replace", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pipeline.load_events(store, raw(spark, EVENTS), scorer, control(spark, DELETES))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {name for name, _ in plans} == {"posts", "replies", "reactions", "base"}
    for _, plan in plans:
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert all("event_ts" not in line for line in moved)
    assert store.read("base").filter(F.col("id") == 2).count() == 0


def test_files_of_base_hold_a_text_once(spark, scorer, tmp_path):
    marked = (1, W1, post("1.0", "Anonymous feedback: good", bot_id="B1"))
    events = [marked, (2, W1, post("2.0", "bad")), (3, W1, post("3.0", None)), (4, W2, post("4.0", ""))]
    store = pipeline.Store(spark, str(tmp_path / "s"))
    pipeline.load_events(store, raw(spark, events[:3]), scorer)
    pipeline.load_events(store, raw(spark, events), scorer)
    texts = ("id", "event_text", "anonymous_feedback_text")
    want = [(1, "good", "Anonymous feedback: good"), (2, "bad", "bad"), (3, None, None), (4, "", "")]
    assert rows(store.read("base"), *texts) == want
    files = spark.read.parquet(f"{store.root}/data/base")
    assert rows(files.select("event_text").distinct()) == [(None,)] and files.count() >= 4
    # Files that hold both texts, and a text of its own, read as they are.
    other = F.when(F.col("id") == 2, "mine").otherwise(F.col("event_text"))
    whole = store.read("base").withColumn("event_text", other)
    with store.change():
        store._folders = {**store._folders, "base": store.snapshots.write("base", whole, "week")}
    assert [r[1] for r in rows(store.read("base"), *texts)] == ["good", "mine", None, ""]
    with store.change():
        store.replace("base", store.read("base"), "week", [r[0] for r in rows(whole.select("week").distinct())])
    assert [r[1] for r in rows(store.read("base").filter("id = 2"), *texts)] == ["mine"]
