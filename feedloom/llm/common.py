"""Helpers shared by the operators: gapless ranks, connected components, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import stage

# Rows that one task numbers at a time.
RANK_ROWS = 100_000

# Limits of an Arrow batch that carries texts.
RECORDS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BYTES, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches small enough for long texts, on both sides of the pipe.

    Texts vary from none to many megabytes; Spark's default of 10,000 rows or 64 MB would be
    held several times over. A session's own lower limits are kept.
    """
    conf = df.sparkSession.conf
    if int(conf.get(RECORDS, "10000")) > BATCH_ROWS:
        conf.set(RECORDS, str(BATCH_ROWS))
    if (conf.get(BYTES, "64m") or "").rstrip("b") in ("67108864", "64m", "-1"):
        conf.set(BYTES, BATCH_LIMIT)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gapless(df: DataFrame, group: str, order: Sequence[str], spread: Column, total: int, name: str = "rank", parts: Sequence[str] = ()) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps and without one task per group.

    Rows are dealt over buckets by the hash of ``spread``; each bucket numbers its own
    rows in ``order`` and starts after the rows of the buckets before it. Groups may
    be as large as the table: a bucket holds about ``RANK_ROWS`` rows. Columns ``parts`` cut
    a bucket further where one value of ``spread`` has more; the parts follow each other in their order.
    """
    buckets = max(1, -(-total // RANK_ROWS))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    at = ["_bucket", *parts]
    before = Window.partitionBy(group).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, *at).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(group, *at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, *at).orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [group, *at])
        .withColumn(name, F.col("_start") + F.col("_at"))
        .select(*df.columns, name)
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component: columns ``node`` and ``root``.

    ``edges`` has long columns ``a`` and ``b``. Every round points each node's larger
    neighbours at its smallest one, first seen from all nodes, then from the smaller
    side only, so the rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder, which cuts the lineage. Neighbour minima are combined
    before the shuffle, so a hub costs no more than any other node.
    """
    links = stage(edges.filter("a <> b").select("a", "b").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: every larger neighbour of a node is tied to the node's minimum.
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = stage(small, "links")
        # Sums of mixed values tell whether the set of links still changes.
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def text_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` text bytes: the rows, the bytes laid end to end, the end of each text.

    The text is the last column; null is empty. A longer text is a run of its own.
    """
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            data = texts.buffers()[2]
            whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(at, to - at), whole[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
            at = to


def laid(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``at`` with ``length`` values each, end to end."""
    before = np.cumsum(length) - length
    return flat[np.repeat(at - before, length) + np.arange(int(length.sum()))]
