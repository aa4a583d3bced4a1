"""The operators' SQL, their registration, and the pipeline on a whole small table."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from feedloom.llm import decontaminate, packing, queries, simhash
from tests.compare import connect, difference
from tests.llm.test_brute_force import holds, plain_report

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_against_sql(spark, name):
    assert difference(name, queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.oracles()[name]) is None


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and len(queries.QUERIES) == 13
    assert set(queries.oracles()) <= set(__spark_entry__.oracle_sql())


def test_pipeline_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.dtypes
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if name != "packing":
            assert docs.dtypes == columns
    before, after = seen["language_id"]
    lettered = {r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in after.collect()} == lettered
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    before, after = seen["near_dedup"]
    groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(groups)
    before, after = seen["decontamination"]
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    dirty = {r[0] for r in plain_report([(r["doc_id"], r["text"]) for r in before.collect()], items) if r[-1]}
    was = {r["doc_id"]: r["text"] for r in before.collect()}
    now = {r["doc_id"]: r["text"] for r in after.collect()}
    assert {i for i in was if was[i] != now[i]} == dirty
    assert decontaminate.report(after, bench).filter("contaminated").count() == 0
    before, pieces = seen["packing"]
    assert holds([(r["doc_id"], r["text"]) for r in before.collect()], pieces.toPandas()).max() <= packing.WINDOW
