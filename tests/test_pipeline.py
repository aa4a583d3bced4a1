import pytest

from feedloom.operators.sentiment import lexicon_scorer
from feedloom.plans import pipeline
from feedloom.sources import tables
from feedloom.streaming import feeds
from tests.events import control, lexicon, post, raw, reaction, reply, rows

W1, W1B, W2, W3 = "2024-01-03 09:00:00", "2024-01-04 09:00:00", "2024-01-10 09:00:00", "2024-01-17 09:00:00"
EVENTS = [
    (1, W1, post("1.0", "good one")), (2, W1, post("2.0", "bad two", team="T2")), (3, W1B, reply("3.0", "1.0")),
    (4, W1B, reaction("4.0", "1.0")), (5, W2, post("5.0", "great five")), (6, W2, reaction("6.0", "5.0")),
    (7, W3, post("7.0", "awful seven")), (8, W3, reply("8.0", "7.0")),
]
DELETES = [("message_deleted", W3, "2.0", None, None), ("reaction_removed", W3, "1.0", "eyes", None)]
TABLES = ("base", "posts", "replies", "reactions")


@pytest.fixture(scope="module")
def scorer(spark):
    return lexicon_scorer(lexicon(spark))


def contents(store):
    return {name: rows(store.read(name)) for name in TABLES}


def load(spark, scorer, root, *batches, **options):
    store = pipeline.Store(spark, str(root))
    for events, deletes in batches:
        pipeline.load_events(store, raw(spark, events), scorer, control(spark, deletes) if deletes else None, **options)
    return store


def test_many_runs_equal_one_run(spark, scorer, tmp_path):
    once = load(spark, scorer, tmp_path / "once", (EVENTS, DELETES))
    often = load(
        spark, scorer, tmp_path / "often", (EVENTS[:4], None), (EVENTS[:6], None), (EVENTS, DELETES), (EVENTS, None)
    )
    assert contents(once) == contents(often)
    assert [r[0] for r in rows(once.read("base"), "id")] == [1, 3, 5, 6, 7, 8]
    assert [r[0] for r in rows(once.read("posts"), "id")] == [1, 5, 7]


def test_replayed_tied_and_timeless_rows_are_loaded_once(spark, scorer, tmp_path):
    timeless = [(20, None, post("20.0", "good twenty")), (21, None, reply("21.0", "1.0"))]
    tied = [(22, W3, post("22.0", "great and late"))]
    twice = [EVENTS[0], *EVENTS, EVENTS[3]]
    often = load(spark, scorer, tmp_path / "often", (twice, None), (twice + tied + timeless, None), (twice + timeless, None))
    once = load(spark, scorer, tmp_path / "once", (EVENTS + tied + timeless, None))
    for name in TABLES:
        ids = [r[0] for r in rows(often.read(name), "id")]
        assert ids == [r[0] for r in rows(once.read(name), "id")] and len(ids) == len(set(ids))
    assert {20, 21, 22} <= {r[0] for r in rows(often.read("base"), "id")}


def test_deletes_stay_out_of_loaded_tables_if_asked(spark, scorer, tmp_path):
    store = load(spark, scorer, tmp_path / "s", (EVENTS[:6], None), (EVENTS[:6], DELETES), propagate_deletes=False)
    assert [r[0] for r in rows(store.read("base"), "id")] == [1, 2, 3, 4, 5, 6]


def test_deletion_known_early_holds_for_rows_loaded_later(spark, scorer, tmp_path):
    # Row 2 is tied with the first mark, so it takes an inclusive load to reach it.
    store = load(spark, scorer, tmp_path / "s", (EVENTS[:1], DELETES), (EVENTS, None), inclusive=True)
    assert [r[0] for r in rows(store.read("base"), "id")] == [1, 3, 5, 6, 7, 8]


def test_load_after_a_crash_repeats_itself(spark, scorer, tmp_path):
    store = load(spark, scorer, tmp_path / "s", (EVENTS[:6], None))
    # Posts of a failed run are present although base was not yet written.
    broken = load(spark, scorer, tmp_path / "t", (EVENTS, None))
    tables.write_full(broken.read("posts"), store.path("posts"), ["week"])
    pipeline.load_events(store, raw(spark, EVENTS), scorer)
    assert contents(store) == contents(broken)


def test_summaries_are_emitted_once_per_closed_week(spark, scorer, tmp_path):
    store = load(spark, scorer, tmp_path / "s", (EVENTS[:6], None))
    first = rows(pipeline.emit_summaries(store, "2024-01-09 12:00:00"), "feedback_start_date", "team_id")
    assert [(str(d), t) for d, t in first] == [("2024-01-02", "T1"), ("2024-01-02", "T2")]
    # A late reaction to the first week no longer changes its summary.
    late = EVENTS + [(9, "2024-01-17 10:00:00", reaction("9.0", "1.0"))]
    done = pipeline.run_pipeline(store, raw(spark, late), scorer, now="2024-01-23 00:00:00")
    texts = {(str(r.feedback_start_date), r.team_id): r.numbered_weighted_posts for r in done.collect()}
    assert texts == {
        ("2024-01-02", "T1"): "1. good one (weight: 1.6)", ("2024-01-02", "T2"): "1. bad two (weight: 1.0)",
        ("2024-01-09", "T1"): "1. great five (weight: 1.1)", ("2024-01-16", "T1"): "1. awful seven (weight: 1.5)",
    }
    pipeline.refresh_marts(store)
    assert tables.read_table(spark, store.path("threads")).count() == 9
    weights = dict(rows(tables.read_table(spark, store.path("weighted")), "post_id", "num_reactions"))
    assert weights[1] == 2


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")

    def frame(data):
        return spark.createDataFrame(data, "id int, v string, week string").selectExpr("id", "v", "cast(week as date) week")

    def files():
        return {w.name: sorted(f.name for f in w.glob("*.parquet")) for w in (tmp_path / "t").glob("week=*")}

    first = frame([(1, "a", "2024-01-02"), (2, "b", "2024-01-09"), (3, "c", "2024-01-16")])
    tables.merge_partitions(spark, path, first, ["id"], "week")
    before = files()
    # Row 2 moves to another week, which empties its old one.
    tables.merge_partitions(spark, path, frame([(2, "B", "2024-01-16")]), ["id"], "week")
    assert rows(spark.read.parquet(path), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]
    after = files()
    assert after["week=2024-01-02"] == before["week=2024-01-02"] and "week=2024-01-09" not in after


def write_feed(spark, path, chunks):
    for chunk in chunks:
        raw(spark, chunk).coalesce(1).write.mode("append").parquet(str(path))


DELETE_EVENTS = [
    (20, W3, {**post("20.0"), "subtype": "message_deleted", "previous_message": {"ts": "2.0"}}),
    (21, W3, reaction("21.0", "1.0", kind="reaction_removed")),
    (22, W3, post("oops")),
]


def test_change_log_equals_batch_and_compacts(spark, tmp_path):
    write_feed(spark, tmp_path / "feed", [DELETE_EVENTS, EVENTS[:4], EVENTS[4:]])
    log = feeds.ChangeLog(spark, str(tmp_path / "log"))
    feeds.stream_apply_changes(log, str(tmp_path / "feed"), max_files=1)
    assert [r[0] for r in rows(log.current(), "id")] == [1, 3, 5, 6, 7, 8]
    again = [(30, W3, reaction("30.0", "1.0")), (31, W3, post("31.0"))]
    write_feed(spark, tmp_path / "feed", [again])
    small = log.compact(str(tmp_path / "log2"))
    assert rows(small.stored(), "id") == rows(small.current(), "id") == rows(log.current(), "id")
    feeds.stream_apply_changes(log, str(tmp_path / "feed"))  # only the new file is read
    assert log.stored().count() == 10


def test_stream_base_and_resume(spark, tmp_path, scorer):
    write_feed(spark, tmp_path / "feed", [EVENTS[:4]])
    out = str(tmp_path / "out")
    assert feeds.stream_base(spark, str(tmp_path / "feed"), out).count() == 4
    write_feed(spark, tmp_path / "feed", [EVENTS[4:], DELETE_EVENTS])
    got = feeds.stream_base(spark, str(tmp_path / "feed"), out, max_files=1)
    assert [r[0] for r in rows(got, "id")] == [1, 2, 3, 4, 5, 6, 7, 8]


def test_stream_state_over_batches(spark, tmp_path, scorer):
    write_feed(spark, tmp_path / "feed", [EVENTS[:2], EVENTS[2:5], EVENTS[5:]])
    weekly = feeds.stream_weekly_sentiment(spark, str(tmp_path / "feed"), str(tmp_path / "w"), scorer, max_files=1)
    got = sorted((str(d), *rest) for d, *rest in rows(weekly))
    assert got == [
        ("2024-01-02", "T1", "positive", 1.0, 1), ("2024-01-02", "T2", "negative", -1.0, 1),
        ("2024-01-09", "T1", "positive", 1.0, 1), ("2024-01-16", "T1", "negative", -1.0, 1),
    ]
    closed = feeds.stream_weekly_sentiment(
        spark, str(tmp_path / "feed"), str(tmp_path / "c"), scorer, delay="1 hour", closed_only=True, max_files=1
    )
    assert {str(r[0]) for r in rows(closed)} == {"2024-01-02", "2024-01-09"}
    threads = feeds.stream_thread_engagement(spark, str(tmp_path / "feed"), str(tmp_path / "e"), max_files=1)
    assert sorted(r[1:] for r in rows(threads)) == [(0, 1), (1, 0), (1, 1)]


def test_stream_drops_repeated_ids(spark, tmp_path):
    write_feed(spark, tmp_path / "feed", [EVENTS, EVENTS[:3]])
    out = feeds.stream_deduplicated(spark, str(tmp_path / "feed"), str(tmp_path / "d"), max_files=1)
    assert [r[0] for r in rows(out, "id")] == [1, 2, 3, 4, 5, 6, 7, 8]
