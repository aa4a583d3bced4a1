import pytest
from pyspark.sql import functions as F

from feedloom.operators import changes, skew
from tests.events import control, post, raw, reaction, reply, rows

T0, T1, T2, T3 = (f"2024-01-03 10:0{i}:00" for i in range(4))


def ids(df):
    return [r[0] for r in rows(df, "id")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_message_delete_takes_rows_stored_before_it(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(changes, "BROADCAST_ROWS", 1)
    source = raw(
        spark,
        [(1, T0, post("1.0")), (2, T2, post("1.0")), (3, T0, post("2.0")), (4, T1, post("1.0")),
         (5, T0, reaction("9.0", "1.0")), (6, T0, post(None)), (7, T0, reply("3.0", "1.0"))],
    )
    deletes = control(
        spark,
        [("message_deleted", T1, "1.0", None, None), ("message_deleted", T0, "1.0", None, None),
         ("message_deleted", T1, None, None, None), ("message_deleted", T3, "3.0", None, None),
         ("reaction_removed", T3, "2.0", "eyes", None)],
    )
    assert ids(changes.apply_message_deletes(source, deletes)) == [2, 3, 5, 6]
    assert ids(changes.apply_message_deletes(source, deletes, hot_rows=1)) == [2, 3, 5, 6]


def test_reaction_removed_and_added_again(spark):
    source = raw(
        spark,
        [(1, T0, reaction("1.0", "9.0")), (2, T2, reaction("2.0", "9.0")), (3, T0, reaction("3.0", "9.0", "thumbsup")),
         (4, T0, reaction("4.0", "9.0", user="U3")), (5, T0, reaction("5.0", "8.0")), (6, T0, post("9.0"))],
    )
    removal = control(spark, [("reaction_removed", T1, "9.0", "eyes", "U2")])
    assert ids(changes.apply_reaction_removals(source, removal)) == [2, 3, 5, 6]
    assert ids(changes.apply_reaction_removals(source, removal, match_user=True)) == [2, 3, 4, 5, 6]
    assert ids(changes.apply_changes(source, removal)) == [2, 3, 5, 6]


def test_invalid_timestamps_are_rejected(spark):
    source = raw(
        spark,
        [(1, T0, post("1.0")), (2, T0, post("x")), (3, T0, post(None)), (4, T0, reaction("1.0", "abc")),
         (5, T0, reaction("y", "1.0")), (6, T0, reaction("1.0", "2.0")), (7, T0, {"type": "other"}),
         (8, T0, reaction("1.0", "12abc", kind="reaction_removed"))],
    )
    valid, rejected = changes.split_valid(source)
    assert ids(valid) == [1, 6, 7]
    assert ids(rejected) == [2, 3, 4, 5, 8]


def test_routing(spark):
    edited = {**post("3.0"), "subtype": "message_changed"}
    deleted = {**post("4.0"), "subtype": "message_deleted", "previous_message": {"ts": "1.0"}}
    source = raw(
        spark,
        [(1, T0, post("1.0")), (2, T0, reaction("2.0", "1.0")), (3, T0, edited), (4, T1, deleted),
         (5, T2, reaction("5.0", "1.0", kind="reaction_removed")), (6, T0, {"x": 1})],
    )
    stored, events = changes.route_events(source)
    assert ids(stored) == [1, 2, 3, 6]  # an edit is one more stored row
    assert rows(events, "kind", "target_ts", "reaction", "user") == [
        ("message_deleted", "1.0", None, None), ("reaction_removed", "1.0", "eyes", "U2"),
    ]
    assert events.columns == ["kind", "event_time", "target_ts", "reaction", "user"]


KEYED = "id string, token string, extra string"


def test_upsert_updates_only_the_given_columns(spark):
    target = spark.createDataFrame([("a", "old", "x"), ("b", "old", "y"), (None, "n", "n")], KEYED)
    source = spark.createDataFrame([("a", "new", "z"), ("c", "new", "w"), (None, "m", "m")], KEYED)
    assert rows(changes.upsert(target, source, ["id"], ["token"])) == [
        ("a", "new", "x"), ("b", "old", "y"), ("c", "new", "w"), (None, "m", "m"), (None, "n", "n"),
    ]
    assert ("a", "new", "z") in rows(changes.upsert(target, source, ["id"]))


def test_upsert_can_write_null(spark):
    target = spark.createDataFrame([("a", "old", "x")], KEYED)
    source = spark.createDataFrame([("a", None, "z")], KEYED)
    assert rows(changes.upsert(target, source, ["id"], ["token"])) == [("a", None, "x")]


def test_update_columns_never_inserts(spark):
    target = spark.createDataFrame([("a", "old", "x"), ("b", "old", "y")], KEYED)
    source = spark.createDataFrame([("a", "new", "z"), ("c", "new", "w")], KEYED)
    assert rows(changes.update_columns(target, source, ["id"], ["token"])) == [("a", "new", "x"), ("b", "old", "y")]
    shared = target.unionByName(spark.createDataFrame([("a", "old", "x2"), (None, "old", "n")], KEYED))
    assert rows(changes.update_columns(shared, source, ["id"], ["token"])) == [
        ("a", "new", "x"), ("a", "new", "x2"), ("b", "old", "y"), (None, "old", "n"),
    ]


def test_a_wide_source_is_not_broadcast(spark):
    few = spark.range(20).select("id", F.repeat(F.lit("é"), 50).alias("text"), F.array("id").alias("list"))
    assert skew.broadcastable(few, ["id"], 20, 20 * (8 + 100 + len('{"list":[10]}')))
    assert not skew.broadcastable(few, ["id"], 20, 20 * 108)
    assert not skew.broadcastable(few, ["id"], 19)
    assert skew.broadcastable(few.limit(0), ["id"])
    target = spark.range(30).select("id", F.lit("old").alias("text"))
    wide = few.select("id", F.repeat(F.lit("x"), 4 << 20).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        updated = changes.update_columns(target, wide, ["id"], ["text"])
        assert "BroadcastHashJoin" not in updated._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert updated.groupBy(F.length("text").alias("n")).count().orderBy("n").collect() == [(3, 10), (4 << 20, 20)]


def test_anonymise(spark):
    df = spark.createDataFrame([("hi", "U1")], "text string, user string")
    assert rows(changes.anonymise(df), "text", "user", "bot_id") == [("Anonymous feedback: hi", None, "B1")]


def test_every_event_has_one_verdict(spark):
    events = [
        (1, None, post("1.0")), (2, None, post("none")), (3, None, reaction("3.0", "x")), (4, None, "{broken"), (5, None, None),
        (6, None, post("6.0", subtype="message_deleted", previous_message={"ts": "1.0"})), (7, None, "17"), (8, None, ""),
        (9, None, reaction("9.0", "1.0", kind="reaction_removed")), (10, None, reaction("9.0", "1.0", kind="reaction_removed") | {"item": None}),
    ]
    tagged = changes.tagged_events(raw(spark, events)).collect()
    want = {1: "store", 2: "rejected", 3: "rejected", 4: "malformed", 5: "store", 6: "control", 7: "store", 8: "malformed", 9: "control", 10: "rejected"}
    assert {r.id: r.tag for r in tagged} == want and len(tagged) == len(events)
    assert {r.id: (r.change.kind, r.change.target_ts) for r in tagged if r.change} == {6: ("message_deleted", "1.0"), 9: ("reaction_removed", "1.0")}


def test_verdicts_parse_each_payload_once(spark):
    df = changes.tagged_events(raw(spark, [(1, None, post("1.0"))]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
