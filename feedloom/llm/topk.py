"""Exact top-k inner products by branch and bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import record
from feedloom.session import stage

TOP = 5
EVERY = 50
SCALE = 256
# Queries sent to the executors at a time; more are searched block by block.
BLOCK_QUERIES = 8192
# Dimensions added between two prunings, queries bounded together, candidates of one vertical block.
DIMENSIONS = 8
QUERY_GROUP = 128
CANDIDATES = 2048
# Candidates are compacted once so small a share of all pairs is left.
SPARSE = 0.25

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LIMIT = float(1 << 53)


def quantized(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(256 x) of the batch's vectors, as whole doubles, filled up with zeros to ``width``."""
    listed = batch.column(1)
    sizes = np.diff(listed.offsets.to_numpy())
    flat = listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((batch.num_rows, width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(batch.num_rows), sizes), place] = np.floor(flat * SCALE)
    return batch.column(0).to_numpy(zero_copy_only=False), out


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.query = k, np.zeros(0, np.int64)
        self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        last = nth == self.k - 1
        self.floor[query[last]] = score[last]


def _exact(queries: np.ndarray, vertical: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products beyond the exact range of doubles, by whole numbers; cut to the range of a long."""
    low, high = -(1 << 63), (1 << 63) - 1
    out = []
    for q, c in zip(qi.tolist(), ci.tolist(), strict=True):
        total = sum(int(a) * int(b) for a, b in zip(queries[q].tolist(), vertical[:, c].tolist(), strict=True))
        out.append(min(high, max(low, total)))
    return np.array(out, np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best, offset: int) -> None:
    """Adds to ``best`` what the vectors hold for a group of queries, numbered from ``offset``.

    Candidates lie in vertical layout, a row for each dimension. Blocks of dimensions are
    added to the partial scores in the order of the queries' mass. After each block what
    is left can change a score by no more than the product of the remaining norms, so
    candidates under the k-th lower bound are dropped; once few pairs survive they are
    compacted and only they are carried on.
    """
    order = np.argsort(-(queries**2).sum(axis=0), kind="stable")
    queries, vertical = queries[:, order], np.ascontiguousarray(vectors[:, order].T)
    width = len(vertical)
    if np.abs(queries).max(initial=0) * np.abs(vertical).max(initial=0) * max(1, width) >= _LIMIT:
        qi, ci = np.nonzero(query_ids[:, None] != ids[None, :])
        best.add(qi + offset, ids[ci], _exact(queries, vertical, qi, ci))
        return
    edges = list(range(0, width, DIMENSIONS)) + [width]
    mass = lambda x, at: np.sqrt((x[at:] ** 2).sum(axis=0))
    across = queries.T
    partial = np.zeros((len(queries), len(ids)))
    alive = query_ids[:, None] != ids[None, :]
    pairs = None
    floor = best.floor[offset : offset + len(queries)].copy()
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        left_q, left_c = mass(across, to), mass(vertical, to)
        if pairs is None:
            partial += queries[:, at:to] @ vertical[at:to]
            slack = left_q[:, None] * left_c[None, :] * (1 + 1e-9)
            if alive.shape[1] >= best.k:
                low = np.where(alive, partial - slack, -np.inf)
                floor = np.maximum(floor, np.partition(low, -best.k, axis=1)[:, -best.k])
            alive &= partial + slack >= floor[:, None] - 0.5
            if alive.mean() < SPARSE:
                qi, ci = np.nonzero(alive)
                pairs = qi, ci, partial[qi, ci]
        else:
            qi, ci, score = pairs
            for d in range(at, to):
                score = score + queries[qi, d] * vertical[d, ci]
            keep = score + left_q[qi] * left_c[ci] * (1 + 1e-9) >= floor[qi] - 0.5
            pairs = qi[keep], ci[keep], score[keep]
    if pairs is None:
        qi, ci = np.nonzero(alive)
        pairs = qi, ci, partial[qi, ci]
    qi, ci, score = pairs
    best.add(qi + offset, ids[ci], score.astype(np.int64))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors without null or non-finite components, as doubles."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).filter(
        F.col("embedding").isNotNull() & fine & F.col("vec_id").isNotNull()
    )


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        best = Best(len(queries), k)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                some = batch.slice(at, CANDIDATES)
                width = max(queries.shape[1], int(np.diff(some.column(1).offsets.to_numpy()).max(initial=0)))
                ids, vectors = quantized(some, width)
                wide = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                for q in range(0, len(wide), QUERY_GROUP):
                    part = slice(q, q + QUERY_GROUP)
                    search(wide[part], query_ids[part], ids, vectors, best, q)
        yield record(_FOUND, {"query_id": query_ids[best.query], "vec_id": best.id, "score": best.score})

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Queries are the vectors whose vec_id is divisible by ``every``; candidates are all
    others. Components become floor(256 x). Ties go to the smaller vec_id; a query with
    fewer candidates gets all. Vectors that are null, hold null or non-finite components or
    have no vec_id take no part; a shorter vector counts as filled up with zeros. Scores
    beyond a long are cut to its range. A vector that comes twice under one vec_id is a
    candidate twice; a query that comes twice is searched once. No query, no rows.

    The query set is stated, and sent in blocks of at most ``block`` queries; every block
    is one pass over the vectors where they lie. A task returns k rows per query.
    """
    vectors = usable(vectors)
    queries = vectors.filter(F.col("vec_id") % every == 0)
    blocks = -(-queries.count() // block)
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = sorted({r["vec_id"]: r["embedding"] for r in part.collect()}.items())
        width = max((len(v) for _, v in rows), default=0)
        packed = np.zeros((len(rows), width))
        for n, (_, vector) in enumerate(rows):
            packed[n, : len(vector)] = np.floor(np.array(vector) * SCALE)
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([i for i, _ in rows], np.int64), packed))
        near = vectors.mapInArrow(_scan(sent, k), "query_id long, vec_id long, score long")
        near = stage(near, "near") if blocks > 1 else near
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_sql() -> str:
    """The same in DuckDB SQL; whole numbers are summed."""
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
    """
