"""Scores remembered by text and model, so that a text is scored once by each model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.sentiment import unused
from feedloom.operators.skew import anti_join, join_unique, small_enough
from feedloom.session import stage

CACHE_SCHEMA = "text_key string, model string, score double"


def cached_scores(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    known: DataFrame | None,
    model: str,
    text_col: str = "event_text",
    out: str = "sentiment_score",
    spread: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """``df`` with the score of its text, and the scores that ``known`` lacked.

    ``scorer`` gets one row of each text that ``known`` (:data:`CACHE_SCHEMA`) has no score of
    by ``model``; its score must depend on the text alone. Texts are told apart by a
    128-bit hash, a NULL text is one like others, and a NULL score is remembered
    as such. The new scores are stored before they are used: a lost executor does not
    call the scorer again. Where the texts of ``df`` are few, the known scores are read where
    they lie; otherwise narrow keys are shuffled. Repeats of a text are combined before the
    shuffle and met by a join that splits heavy keys over ``spread``.
    """
    key = unused(df, "_text_key")
    score = unused(df, "_known_score")
    marked = df.withColumn(key, F.coalesce(F.md5(text_col), F.lit("")))
    missing = marked
    old = None
    if known is not None:
        old = known.filter(F.col("model") == model).select(F.col("text_key").alias(key), F.col("score").alias(score))
        arriving = marked.select(key).distinct()
        if small_enough(arriving):
            old = old.join(F.broadcast(arriving), key, "left_semi")
        missing = anti_join(marked, old, [key])
    one = scorer(missing.dropDuplicates([key]))
    fresh = stage(one.select(F.col(key).alias("text_key"), F.lit(model).alias("model"), F.col(out).cast("double").alias("score")), "scores")
    found = fresh.select(F.col("text_key").alias(key), F.col("score").alias(score))
    joined = join_unique(marked, found if old is None else found.unionByName(old), [key], "left", spread)
    return joined.select(*[c for c in df.columns if c != out], F.col(score).alias(out)), fresh
