import pytest
from pyspark.sql import functions as F

from feedloom.operators import incremental
from tests.events import rows

SCHEMA = "id int, at string, v string"


def timed(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("at", F.col("at").cast("timestamp"))


@pytest.fixture
def incoming(spark):
    times = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00.000001"]
    return timed(spark, [(i + 1, at, "v") for i, at in enumerate(times)])


def test_ties_and_rows_without_a_time_are_taken_unless_strict(spark, incoming):
    existing = timed(spark, [(9, "2024-01-02 00:00:00", "z")])
    more = incoming.union(timed(spark, [(4, None, "v")]))

    def taken(**flags):
        return [i for (i,) in rows(incremental.newer_than(more, existing, "at", **flags), "id")]

    assert taken() == [2, 3, 4]
    assert taken(inclusive=False) == [3, 4]
    assert taken(keep_null=False) == [2, 3]
    assert taken(inclusive=False, keep_null=False) == [3]


def test_empty_existing_table_is_a_first_load(spark, incoming):
    empty = timed(spark, [])
    assert incremental.newer_than(incoming, empty, "at").count() == 3
    assert incremental.newer_than(incoming, None, "at").count() == 3
    assert incremental.newer_than(incoming, empty, "at", strict_null_hwm=True).count() == 0


def test_mark_reaches_the_scan_as_a_value(spark, incoming, tmp_path):
    incoming.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    newer = incremental.newer_than(stored, incoming, "at", inclusive=False, keep_null=False)
    plan = newer._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThan(at,2024-01-02" in plan


def test_merge_replaces_by_key_and_keeps_null_keys(spark):
    existing = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    arriving = spark.createDataFrame([(2, "B"), (3, "C"), (None, "m")], "id int, v string")
    assert rows(incremental.merge_incremental(existing, arriving, ["id"])) == [
        (1, "a"), (2, "B"), (3, "C"), (None, "m"), (None, "n"),
    ]


def test_schema_sync_adds_and_drops_columns(spark):
    existing = spark.createDataFrame([(1, "a", 1.0)], "id int, gone string, kept double")
    arriving = spark.createDataFrame([(2, 2.0, "x")], "id int, kept double, added string")
    merged = incremental.merge_incremental(existing, arriving, ["id"])
    assert merged.columns == ["id", "kept", "added"]
    assert rows(merged) == [(1, 1.0, None), (2, 2.0, "x")]


def weeks(spark, *starts):
    df = spark.createDataFrame([(s,) for s in starts], "feedback_start_date string")
    return df.select(F.col("feedback_start_date").cast("date"))


def test_closed_weeks(spark):
    weekly = weeks(spark, "2024-01-02", "2024-01-09", "2024-01-16")
    emitted = weeks(spark, "2024-01-02")

    def emit(*args):
        return [str(r[0]) for r in rows(incremental.emit_closed_weeks(weekly, *args))]

    assert emit(None, "2024-01-15 23:59:59") == ["2024-01-02"]  # Monday still belongs to the week
    assert emit(None, "2024-01-16 00:00:00") == ["2024-01-02", "2024-01-09"]
    assert emit(emitted, "2024-01-16 00:00:00") == ["2024-01-09"]
    assert emit(emitted, None, "first_seen") == ["2024-01-09", "2024-01-16"]
    with pytest.raises(ValueError):
        incremental.emit_closed_weeks(weekly, None, None, "other")


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, n int, v string")
    assert rows(incremental.latest_per_key(df, ["k"], ["n"])) == [("a", 2, None), ("b", 1, "y")]


def test_repeated_keys_leave_the_latest_row(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-02", "b"), (1, "2024-01-01", "a"), (2, "2024-01-01", "c"), (2, "2024-01-01", "c"), (None, None, "d"), (None, None, "d")],
        "id long, event_time string, v string",
    )
    kept = rows(incremental.one_per_key(df, ["id"]).filter("id IS NOT NULL"))
    assert kept == [(1, "2024-01-02", "b"), (2, "2024-01-01", "c")]
    assert incremental.one_per_key(df, ["id"]).count() == 4
    merged = incremental.merge_incremental(df.filter("id = 2").limit(1), df.filter("id = 2"), ["id"])
    assert merged.count() == 1
