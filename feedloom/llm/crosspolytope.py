"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash
is the nearest of the signed axes. Several such hashes make the bucket of a table. A vector
also goes to the buckets next to its own, in which the least certain hash takes its second
best axis. What shares a bucket is a candidate; candidates are verified on the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import connected_components, map_arrow, record, slices
from feedloom.operators.skew import heavy_keys, join_unique
from feedloom.session import stage

COSINE = 0.93
# Hashes that make the bucket of one table; more of them keep buckets small in larger tables.
HASHES = 3
# Buckets beside its own that a vector goes to in each table.
PROBES = 4
# Share of the pairs right at the threshold that no table may bring together.
MISSED = 5e-4
SEED = 11
# Pairs at the threshold on which the hit rate of one table is measured.
TRIALS = 4000
# Bits of the sketch that thins out buckets before vectors are sent, and the deviations it is lenient by.
SKETCH_BITS, LENIENT = 256, 6.0
# Rows of one bucket that a task compares as they are; a larger bucket is dealt over several.
AT_ONCE = 4096
# Rows whose cells are searched at a time.
GATHERED = 1 << 14
# Similarities, and pairs of linked rows, held in memory at a time.
COMPARED, PAIRS = 1 << 21, 1 << 16

_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("mark", pa.string()), ("vector", pa.binary())])
_CODED = pa.schema([("node", pa.int64()), ("slots", pa.list_(pa.int64())), ("sketch", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    rows, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(rows, -1, 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


@lru_cache(256)
def _signs(width: int, table: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, table]).choice([-1.0, 1.0], (hashes, 3, width))


def _padded(unit: np.ndarray) -> np.ndarray:
    width = max(2, 1 << (unit.shape[1] - 1).bit_length())
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def table_codes(padded: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """Codes of the buckets of one table: each row's own bucket first, then the likeliest ones beside it."""
    rows, width = padded.shape
    best, second, gap = [], [], []
    for signs in _signs(width, table, hashes):
        turned = padded
        for flip in signs:
            turned = hadamard(turned * flip)
        size = np.abs(turned)
        top = np.argpartition(-size, 1, axis=1)[:, :2]
        values = np.take_along_axis(size, top, 1)
        top = np.where((values[:, :1] < values[:, 1:]), top[:, ::-1], top)
        axes = 2 * top + (np.take_along_axis(turned, top, 1) < 0)
        best.append(axes[:, 0])
        second.append(axes[:, 1])
        gap.append(np.abs(values[:, 0] ** 2 - values[:, 1] ** 2))
    best, second, gap = (np.stack(x, 1) for x in (best, second, gap))
    # Subsets of hashes that switch to the second axis, by what this costs in all.
    masks = (np.arange(1, 1 << hashes)[:, None] >> np.arange(hashes) & 1).astype(bool)
    order = np.argsort(gap @ masks.T, axis=1, kind="stable")[:, :probes]
    switched = np.concatenate([np.zeros((rows, 1, hashes), bool), masks[order]], axis=1)
    axes = np.where(switched, second[:, None, :], best[:, None, :]).astype(np.uint64)
    code = np.zeros(axes.shape[:2], np.uint64)
    for k in range(hashes):  # 32 bits whatever the width; what is equal here is a bucket
        code = (code * np.uint64(2 * width) + axes[:, :, k]) % np.uint64(4294967291)
    return code.astype(np.int64)


@lru_cache(32)
def tables_needed(width: int, cosine: float, hashes: int, probes: int, missed: float) -> int:
    """Tables by which random pairs right at ``cosine`` are missed with probability ``missed`` at most."""
    width = max(2, width)
    random = np.random.default_rng([SEED, width])
    one, other = random.normal(size=(2, TRIALS, width))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    other = cosine * one + np.sqrt(max(0.0, 1 - cosine**2)) * other
    a, b = (table_codes(_padded(x), 0, hashes, probes) for x in (one, other))
    hit = min((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean(), 1 - 1e-6)
    if hit < 0.01:
        raise ValueError("pairs at this cosine hardly share a bucket; use fewer hashes or more probes")
    return int(np.ceil(np.log(missed) / np.log(1 - hit)))


@lru_cache(32)
def _planes(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, 0]).normal(size=(width, SKETCH_BITS))


def _units(data: list[bytes], kind: str) -> np.ndarray:
    values = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _rows(vectors: DataFrame, vector: str, kind: str) -> DataFrame:
    """``vec_id``, ``label``, ``mark`` of label and vector, and the vector's bytes; no mark if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks, data = [], []
            for label, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = own.values
                mark = raw = None
                if label is not None and values is not None and len(values) and not values.null_count:
                    numbers = values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
                    if np.isfinite(numbers).all() and numbers.any():
                        raw = numbers.astype(kind).tobytes()
                        mark = hashlib.md5(f"{len(label)}:{label}:".encode("utf-8", "surrogatepass") + raw).hexdigest()
                marks.append(mark)
                data.append(raw)
            yield record(_ROWS, {"vec_id": batch.column(0), "label": batch.column(1), "mark": marks, "vector": data})

    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col(vector))
    return map_arrow(given, run, "vec_id long, label string, mark string, vector binary")


def _coded(reps: DataFrame, kind: str, cosine: float, hashes: int, probes: int, missed: float) -> DataFrame:
    """``node``, ``slots`` (table above, bucket below) in all tables, and a ``sketch`` of signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in data])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                unit = _units([data[n] for n in rows], kind)
                tables = tables_needed(unit.shape[1], cosine, hashes, probes, missed)
                padded = _padded(unit)
                slots = [table_codes(padded, t, hashes, probes) | t << 32 for t in range(tables)]
                sketch = np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1)
                columns = {"node": nodes[rows], "slots": list(np.concatenate(slots, axis=1))}
                yield record(_CODED, columns | {"sketch": [s.tobytes() for s in sketch]})

    return map_arrow(reps.select("node", "vector"), run, "node long, slots array<long>, sketch binary")


def _cells(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of many whole cells at a time and where each cell starts.

    The first ``parts`` columns tell cells apart and rows come sorted by them.
    """
    held, size = [], 0
    for batch in _closed(batches):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
            if size < GATHERED:
                continue
        if not size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(size, bool)
        new[0] = True
        for c in range(parts):
            column = table.column(c)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
        starts = np.flatnonzero(new)
        ready = size if batch is None else int(starts[-1])  # the last cell may go on
        if ready:
            yield table.slice(0, ready), starts[starts < ready]
            held, size = table.slice(ready).to_batches(), size - ready


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _blocks(sides: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of rows and what each meets: side 0 meets side 1, or itself where there is no side 1."""
    first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides)
    within = not len(second)
    against = first if within else second
    step = max(1, COMPARED // max(1, len(against) * width))
    for at in range(0, len(first), step):
        block = first[at : at + step]
        yield block, against[at:] if within else against, within


def _thinned(allowed: int):
    """Rows of a cell that have a likely partner there: no more rows out than in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _cells(batches, 1):
            sides = table.column("side").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(sides), -1)
            sizes = np.diff(np.append(starts, len(sides)))
            end = np.repeat(starts + sizes, sizes)
            sided = np.repeat(np.logical_or.reduceat(sides > 0, starts), sizes)
            likely = np.zeros(len(sides), bool)
            step, rows = 1, np.flatnonzero(end > np.arange(len(sides)) + 1)
            while len(rows):
                other = rows + step
                far = np.bitwise_count(sketch[rows] ^ sketch[other]).sum(axis=1, dtype=np.int32)
                near = (far <= allowed) & (~sided[rows] | (sides[rows] != sides[other]))
                likely[rows[near]] = likely[other[near]] = True
                step += 1
                rows = rows[end[rows] > rows + step]
            if likely.any():
                yield from table.select(["cell", "side", "node", "slot"]).filter(pa.array(likely)).to_batches()

    return run


def _met_before(one: np.ndarray, other: np.ndarray, slot: int, width: int) -> np.ndarray:
    """Whether the pairs of slot lists share a bucket before ``slot``."""
    seen = np.zeros(len(one), bool)
    for table in range((slot >> 32) + 1):
        left = np.flatnonzero(~seen)
        a, b = (x[left, table * width : (table + 1) * width] for x in (one, other))
        seen[left] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < slot)).any(axis=(1, 2))
    return seen


def _hooked(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the sets of ``label`` along the pairs, in place, and returns which pairs did: a forest."""
    ends = []
    while len(p):
        one, other = label[p], label[q]
        apart = one != other
        p, q, one, other = p[apart], q[apart], one[apart], other[apart]
        high, at = np.unique(np.maximum(one, other), return_index=True)
        if not len(high):
            break
        ends.append((p[at], q[at]))
        parent = np.arange(len(label))
        parent[high] = np.minimum(one, other)[at]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label[:] = parent[label]
    if not ends:
        return p[:0], q[:0]
    one, other = zip(*ends, strict=True)
    return np.concatenate(one), np.concatenate(other)


def _single(tables: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.Table]:
    """One cell after the other, those of a single row left out."""
    for table, starts in tables:
        ends = np.append(starts[1:], table.num_rows)
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start > 1:
                yield table.slice(start, end - start)


def _linked(kind: str, cosine: float, width: int):
    """Of each cell: how many vectors each row links, counting pairs that meet here first, and a forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _single(_cells(batches, 4)):
            nodes, sides, times = (cell.column(c).to_numpy() for c in ("node", "side", "n"))
            unit = _units(cell.column("vector").to_pylist(), kind)
            slots = np.array(cell.column("slots").to_pylist(), np.int64)
            slot = cell.column("slot")[0].as_py()
            counts, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            edges = []
            for block, against, within in _blocks(sides, 1):
                linked = unit[block] @ unit[against].T >= cosine
                if within:
                    linked &= against[None] > block[:, None]
                p, q = np.nonzero(linked)
                p, q = block[p], against[q]
                for at in range(0, len(p), PAIRS):
                    one, other = p[at : at + PAIRS], q[at : at + PAIRS]
                    new = ~_met_before(slots[one], slots[other], slot, width)
                    one, other = one[new], other[new]
                    np.add.at(counts, one, times[other])
                    np.add.at(counts, other, times[one])
                    edges.append(_hooked(label, one, other))
            some = np.flatnonzero(counts)
            if len(some):
                yield record(_FOUND, {"a": nodes[some], "b": pa.nulls(len(some), pa.int64()), "links": counts[some]})
                a, b = (nodes[np.concatenate(x)] for x in zip(*edges, strict=True))
                yield record(_FOUND, {"a": np.minimum(a, b), "b": np.maximum(a, b), "links": np.zeros(len(a), np.int64)})

    return run


def _dealt(keyed: DataFrame) -> DataFrame:
    """Rows ``cell``, ``side``, ``node``, ``slot``, ``sketch``: a bucket each, large ones as pairs of their parts.

    All pairs of a bucket meet in one cell. A bucket of m rows is cut into m / ``AT_ONCE`` parts.
    """
    hot = heavy_keys(keyed, "key", AT_ONCE)
    whole = keyed.select(F.col("key").alias("cell"), F.lit(0).alias("side"), "node", "slot", "sketch")
    if not hot.limit(1).count():
        return whole
    # There may be as many hot keys as the table has rows by AT_ONCE: no forced broadcast.
    joined = keyed.join(hot, "key", "left")
    fan = F.coalesce(F.ceil(F.col("rows") / AT_ONCE), F.lit(1)).cast("long")
    part = F.pmod(F.xxhash64("node", "key"), F.col("fan"))
    met = joined.withColumn("fan", fan).withColumn("part", part)
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
    pair = F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))
    cell = F.when(F.col("fan") > 1, pair).otherwise(F.col("key"))
    return met.select(cell.alias("cell"), (F.col("with") < F.col("part")).cast("int").alias("side"), "node", "slot", "sketch")


def components(
    vectors: DataFrame,
    cosine: float = COSINE,
    vector: str = "embedding",
    hashes: int = HASHES,
    probes: int = PROBES,
    missed: float = MISSED,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels and widths are equal and their cosine, in double precision, is
    ``cosine`` or more; every link returned is verified. The number of tables follows from
    ``missed`` and the width, so that a pair right at the threshold is found with probability
    1 - ``missed``, closer ones more often. Equal vectors of a label are one node and
    count as often as they come; a row repeated whole counts as another vector. Vectors that are
    null, empty, zero or hold null, NaN or infinite values, and rows without a label, link with
    nothing: 0 links, their own component. ``component_id`` is the smallest vec_id of the
    component; a null vec_id is it only if there is no other. An empty table gives no rows. Other
    columns are ignored.

    Buckets hold row numbers and a short sketch only; the vectors are sent for rows that
    have a likely partner in a bucket. Each pair is counted in the first bucket it
    shares, so no pair leaves a task: a task returns counts and a spanning forest. Buckets over ``AT_ONCE``
    rows are cut into parts that meet pairwise in tasks of their own; none is capped. Counting
    the links of a group of m different vectors that are all near takes m * m products.
    """
    if not 1 <= probes < 1 << hashes:
        raise ValueError("probes must lie between 1 and the number of switched subsets")
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie above 0, up to 1")
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = _rows(vectors, vector, kind)
    same = F.col("mark").isNotNull()
    once = rows.filter(same).groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    reps = stage(once.withColumn("node", F.monotonically_increasing_id()), "vectors")
    coded = stage(_coded(reps, kind, cosine, hashes, probes, missed), "codes")
    width = F.octet_length("vector").alias("width")
    keyed = coded.join(reps.select("node", "label", width), "node").select("node", "sketch", "label", "width", F.explode("slots").alias("slot"))
    keyed = keyed.select(F.xxhash64("label", "width", "slot").alias("key"), "node", "slot", "sketch")

    angle = np.arccos(min(cosine, 1.0)) / np.pi
    allowed = int(np.ceil(SKETCH_BITS * angle + LENIENT * np.sqrt(SKETCH_BITS * angle * (1 - angle)))) + 1
    dealt = _dealt(keyed).repartition("cell").sortWithinPartitions("cell")
    likely = stage(map_arrow(dealt, _thinned(allowed), "cell long, side int, node long, slot long"), "likely")
    full = likely.join(reps.select("node", "label", "vector", "n", width), "node").join(coded.select("node", "slots"), "node")
    full = full.select("cell", "slot", "label", "width", "side", "node", "n", "vector", "slots")
    sent = full.repartition("cell").sortWithinPartitions("cell", "slot", "label", "width")
    found = stage(map_arrow(sent, _linked(kind, cosine, probes + 1), "a long, b long, links long"), "links")

    roots = connected_components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = reps.select("node", "mark", "n", "low").join(links, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    known = nodes.join(lowest, "root").select(
        "mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = join_unique(rows.select("vec_id", "mark"), known, ["mark"], "left", "vec_id")
    own = F.when(same, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )


def components_sql(cosine: float = COSINE, vector: str = "embedding") -> str:
    """All pairs of a label compared, as SQL: for tables of some thousand rows."""
    return f"""
        WITH RECURSIVE valid AS (
            SELECT vec_id, label, {vector}::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len({vector}) > 0
              AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter({vector}, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS one, b.vec_id AS other FROM valid a JOIN valid b
            ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= {cosine}
        ), reached AS (
            SELECT vec_id, vec_id AS far FROM embeddings
            UNION SELECT r.vec_id, l.other FROM reached r JOIN links l ON l.one = r.far
        ), lowest AS (SELECT vec_id, min(far) AS component_id FROM reached GROUP BY vec_id)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.one = e.vec_id) AS n_links,
               o.component_id, e.vec_id = o.component_id AS kept
        FROM embeddings e JOIN lowest o USING (vec_id)"""
