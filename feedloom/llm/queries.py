"""Registered queries of the operators, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import (
    crosspolytope,
    decontaminate,
    html,
    langid,
    licenses,
    linededup,
    packing,
    runs,
    sharding,
    simhash,
    spelling,
    topk,
    urls,
)
from feedloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licences(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.report(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op11_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return crosspolytope.components(table(spark, folder, "embeddings"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), plant=True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_url_filter,
        op3_exact_topk,
        op4_sharding,
        op5_language_id,
        op6_simhash,
        op7_decontamination,
        op8_html_extraction,
        op9_line_dedup,
        op10_packing,
        op11_embedding_dedup,
        op12_periodic_runs,
        op13_spelling_variants,
    )
}


def oracles() -> dict[str, str]:
    return {
        "op2_url_filter": urls.judge_sql(),
        "op3_exact_topk": topk.top_k_sql(),
        "op11_embedding_dedup": crosspolytope.components_sql(),
    }
