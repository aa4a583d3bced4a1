"""Answers of a text model, asked for in batches and kept as they come."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.sentiment import unused
from feedloom.operators.skew import BROADCAST_ROWS, broadcastable, join_unique, small_enough
from feedloom.session import stage, staging_path
from feedloom.sources.tables import children

ANSWER_SCHEMA = "prompt_key string, model string, answer string, error string"
# Prompts of one call, characters that end a call early, and tasks of one job.
BATCH = 64
BATCH_CHARS = 16_000_000
TASKS = 20_000
TRIES = 3


class Unanswered(RuntimeError):
    """Prompts that every try failed on. The answers of all others are kept."""


class Answers:
    """Answers of one ``model``, kept in ``folder`` across runs.

    Every round of questions is a folder of its own. Files move there when their task ends, so a
    run that dies, driver included, leaves all that its finished tasks brought. Failed
    calls are kept as rows with an ``error``.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark = spark
        self.folder = folder
        self.model = model

    def _folders(self) -> list[str]:
        return [f"{self.folder}/{n}" for n in children(self.spark, self.folder) if n.startswith("round-")]

    def is_new(self) -> bool:
        return not self._folders()

    def rounds(self) -> DataFrame:
        """All rows, failures included, of all models."""
        return self._read(self._folders())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ANSWER_SCHEMA)
        return self.spark.read.schema(ANSWER_SCHEMA).parquet(*folders)

    def known(self) -> DataFrame:
        """Rows of prompts that the model has answered; runs side by side may have asked one twice."""
        return self.rounds().filter((F.col("model") == self.model) & F.col("error").isNull())

    def add(self, rows: DataFrame) -> DataFrame:
        """Store one round; returns its rows as stored."""
        folder = f"{self.folder}/round-{uuid.uuid4().hex}"
        # Answers stand on their own, so a part of a round is as good as all of it.
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
        return self._read([folder])


def _calls(frame: pd.DataFrame, batch: int, batch_chars: int) -> Iterator[pd.DataFrame]:
    """Rows in order, cut where a call has ``batch`` prompts or would pass ``batch_chars``."""
    start = chars = 0
    for at, size in enumerate(frame["prompt"].str.len()):
        if at > start and (at - start == batch or chars + size > batch_chars):
            yield frame.iloc[start:at]
            start, chars = at, 0
        chars += size
    if len(frame):
        yield frame.iloc[start:]


def _asker(generator: Callable, model: str, batch: int, batch_chars: int) -> Callable:
    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for call in _calls(frame, batch, batch_chars):
                prompts = call["prompt"].reset_index(drop=True)
                try:
                    answer = [None if pd.isna(a) else str(a) for a in generator(prompts)]
                    if len(answer) != len(prompts):
                        raise ValueError(f"{len(answer)} answers to {len(prompts)} prompts")
                    error = None
                except Exception as failure:  # kept as a row: the answers of other calls must not be lost with it
                    answer, error = None, f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame(
                    {"prompt_key": call["prompt_key"].to_numpy(), "model": model, "answer": answer, "error": error},
                    dtype=object,
                )

    return asked


def ask(
    df: DataFrame,
    prompt: Column,
    generator: Callable[[pd.Series], pd.Series],
    out: str,
    book: Answers | None = None,
    batch: int = BATCH,
    tries: int = TRIES,
    batch_chars: int = BATCH_CHARS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df``, or its columns ``keep``, with the ``generator``'s answer to each row's ``prompt``.

    ``generator`` turns a pandas Series of prompts into as many texts. Prompts are told apart by
    a 256-bit hash and each is asked once, however many rows have it; a NULL prompt is not asked and has a
    NULL answer, and a NULL answer is kept as one. Those that ``book`` knows are not asked. A call that
    fails is asked again, up to ``tries`` times, while the answers of the others are
    stored; if some still fail :class:`Unanswered` is raised, and the next run with the same ``book``
    asks only for these. Without a ``book`` answers are kept for this call only.

    A task makes one call, unless that takes more than ``TASKS`` tasks, and its answers are stored when it ends: a
    lost executor costs no more than the calls of its running tasks.
    """
    book = book or Answers(df.sparkSession, staging_path(df.sparkSession, "answers"), "")
    names = [*df.columns] if keep is None else [*keep]
    text, key, row, answer = (unused(df, name) for name in ("_prompt", "_prompt_key", "_asked_row", "_answer"))
    mark = F.xxhash64(*names)  # spreads rows of one prompt
    rows = stage(df.select(*names, prompt.alias(text), mark.alias(row)).withColumn(key, F.sha2(text, 256)), "asked")
    wanted = rows.filter(F.col(text).isNotNull())
    keys = wanted.select(F.col(key).alias("prompt_key")).distinct()
    known = not book.is_new()
    for turn in range(tries + 1):
        asked_before = known or turn > 0
        left = stage(keys.join(book.known(), "prompt_key", "left_anti"), "unanswered") if asked_before else keys
        n = left.count()
        if not n:
            break
        few = F.broadcast(left) if n <= BROADCAST_ROWS else left
        if turn == tries:
            failed = book.rounds().filter(F.col("error").isNotNull()).join(few, "prompt_key", "left_semi")
            raise Unanswered(f"{n} prompts without an answer after {tries} tries, such as: {failed.agg(F.max('error')).first()[0]}")
        todo = wanted.select(F.col(key).alias("prompt_key"), F.col(text).alias("prompt"))
        if asked_before:
            todo = todo.join(few, "prompt_key", "left_semi")
        chars = todo.agg(F.sum(F.length("prompt"))).first()[0]
        tasks = min(TASKS, max(math.ceil(n / batch), math.ceil(chars / batch_chars)))
        once = todo.repartition(tasks, "prompt_key").dropDuplicates(["prompt_key"])
        got = book.add(once.mapInPandas(_asker(generator, book.model, batch, batch_chars), ANSWER_SCHEMA))
        if not got.filter(F.col("error").isNotNull()).limit(1).count():
            break
    mine = book.known()
    if known:  # else the book holds nothing but answers to these prompts
        mine = mine.join(F.broadcast(keys) if small_enough(keys) else keys, "prompt_key", "left_semi")
    found = mine.groupBy(F.col("prompt_key").alias(key)).agg(F.min("answer").alias(answer))
    joined = join_unique(rows.drop(text), found, [key], "left", row, small_right=broadcastable(found, [key]))
    return joined.select(*[c for c in names if c != out], F.col(answer).alias(out))
