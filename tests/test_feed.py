"""The files that streams read: none grows with the tables, and the batches stay as many."""

from datetime import datetime
from pathlib import Path

import pytest

from catalog import queries as catalog
from feedloom import schemas
from feedloom.streaming import feeds


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(n, f"good text {n}", "en", "src20", 10) for n in range(300)]
    turns = [(n, 0, "user", "thanks") for n in range(0, 300, 3)]
    kinds = ["click", "view", "error", "purchase", "signup"]
    events = [(n, datetime(2024, 1, 2 + n % 20), n % 300, kinds[n % 5], 1.0, "{}") for n in range(200)]
    for name, rows in {"documents": docs, "conversations": turns, "events": events}.items():
        spark.createDataFrame(rows, catalog.given.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def written(path):
    return len(list(Path(path.removeprefix("file:")).glob("part-*")))


def test_files_of_a_feed_grow_in_number_with_the_tables(spark, folder, monkeypatch):
    path, quarter = catalog.feed(spark, folder)
    assert (written(path), quarter) == (4, 1)
    monkeypatch.setattr(catalog, "FEED_BYTES", catalog.given.stored_bytes(spark, folder) // 10)
    more, quarter = catalog.feed(spark, folder)
    assert written(more) == 4 * quarter >= 10
    assert sorted(spark.read.parquet(more).collect()) == sorted(spark.read.parquet(path).collect())


def test_batches_stay_as_many(spark, folder, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "FEED_BYTES", catalog.given.stored_bytes(spark, folder) // 10)
    path, quarter = catalog.feed(spark, folder)
    out = tmp_path / "out"
    feeds.stream_base(spark, path, str(out), max_files=2 * quarter)
    assert sorted(f.name for f in (out / "checkpoint" / "commits").iterdir() if f.name.isdigit()) == ["0", "1"]


def test_reading_dead_letters_leaves_the_schema_of_raw_events(spark, tmp_path):
    feeds.ChangeLog(spark, str(tmp_path / "log")).dead()
    assert [f.name for f in schemas.RAW_SCHEMA.fields] == schemas.RAW_SCHEMA.names == ["id", "event_time", "raw_event"]
