"""Near-duplicate documents by SimHash and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import connected_components, map_arrow, record, slices, unused
from feedloom.operators.skew import join_unique
from feedloom.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Shingles whose bits are counted at a time.
COUNTED = 1 << 16
# Rows of one key that a task searches as they are; a larger key is dealt over several.
AT_ONCE = 8192
# Comparisons held in memory at a time.
COMPARED = 1 << 19

# Near duplicates of the pipeline: shingles of so many words, and the share of them that is common.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
# A signature of minima is cut into segments; each is indexed once without each of its values.
SEGMENTS, SEGMENT = 4, 4
# Minima of the whole signature; what the segments do not use only estimates the similarity.
MINIMA = 128
# Shingles whose minima are taken at a time.
MIXED = 4096
# Estimates at which links are sought before the exact check; the estimate's deviation is 0.035.
LEVELS = (0.7, 0.77, 0.84)
# Texts of different components are compared if a partner's estimate reaches this; one at 0.8 falls below it less than once in a million.
LEAST = 0.6
# Pairs that a task hands on at a time.
HANDED = 1 << 16
# Links of one text that a task may hold before they are split.
HUB_LINKS = 20_000
# Rows of one key whose texts a task holds; more are dealt over several.
TEXTS_AT_ONCE = 1024
# Texts a task remembers having handed on.
REMEMBERED = 100_000

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False) | np.uint64(1)
_SIGNATURES = pa.schema([("mark", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
_PRINTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])
_CELLED = pa.schema([("cell", pa.int64()), ("side", pa.int32()), ("mark", pa.int64()), ("root", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, width: int, at_once: int = COUNTED) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in stretches of at most ``at_once``.

    Words are separated by ASCII white space, A to Z are lower-cased. A text of fewer
    words is one shingle, one without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= width:
        yield np.array([digest(line, seed)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends = ends[width - 1 :]
    for at in range(0, len(starts), at_once):
        spans = zip(starts[at : at + at_once].tolist(), ends[at : at + at_once].tolist(), strict=True)
        yield np.array([digest(line[s:e], seed) for s, e in spans], "<u8")


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned number.

    A bit is set if it is set in over half of the shingles' hashes. No words: 0.
    """
    ones, total = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, width):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, a ``mark`` of the text and its fingerprint ``fp`` as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64)
            yield record(_PRINTS, {"doc_id": batch.column(0), "mark": batch.column(1), "fp": prints.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, mark long, fp long")


def variant_keys(fp: str = "fp") -> F.Column:
    """The 64 keys of a fingerprint: two halves, each with one of its 32 bits wiped out.

    Three differing bits leave one half with at most one, and two halves that differ in
    at most one bit agree once that bit is wiped. A key packs half, bit and the rest.
    """
    keys = []
    for side in (0, 1):
        half = F.shiftrightunsigned(F.col(fp), 32 * side).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            tag = (side << 5 | bit) << 32
            keys.append(half.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit)).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def _forest(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the links of ``limit`` or fewer bits, found breadth first.

    Only what is not reached yet is compared, so a dense set costs little more than its
    size and memory stays linear.
    """
    parents, children = [], []
    left, step = np.arange(len(fps)), max(1, COMPARED // len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), step):
                part = front[at : at + step]
                close = np.bitwise_count(fps[part][:, None] ^ fps[left][None, :]) <= limit
                hit = close.any(axis=0)
                if hit.any():
                    parents.append(part[close[:, hit].argmax(axis=0)])
                    children.append(left[hit])
                    reached.append(left[hit])
                    left = left[~hit]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
    if not parents:
        return left[:0], left[:0]
    return np.concatenate(parents), np.concatenate(children)


def _near(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``fps`` that connect all at ``limit`` or fewer bits.

    A large set is split once more: of ``limit`` + 1 parts of the word one is equal.
    """
    if len(fps) <= AT_ONCE:
        return _forest(fps, limit)
    found, width = [], 64 // (limit + 1)
    for part in range(limit + 1):
        values = fps >> np.uint64(part * width) & np.uint64((1 << width) - 1)
        order = np.argsort(values, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            p, q = _forest(fps[run], limit)
            found.append((run[p], run[q]))
    p, q = zip(*found, strict=True)
    return np.concatenate(p), np.concatenate(q)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Columns of whole keys and where each key starts and ends.

    Rows come sorted by the first column; the last key of a batch waits for the next one.
    """
    held: list[list[np.ndarray]] = []
    for batch in _closed(batches):
        if batch is not None and batch.num_rows:
            held.append([_values(column) for column in batch.columns])
        if not held or batch is not None and held[0][0][0] == held[-1][0][-1]:
            continue  # one key so far
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        keys = columns[0]
        ready = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[:ready])) + 1, [ready]))
        yield columns, list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        held = [[c[ready:] for c in columns]] if ready < len(keys) else []


def _values(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINIMA)
    return column.to_numpy(zero_copy_only=False)


def _edges(one: list[np.ndarray], other: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(one), np.concatenate(other)
    return record(_EDGES, {"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _run_links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, marks), runs in _by_key(batches):
            fps = marks.view(np.uint64)
            cuts = np.array(runs)
            pair = cuts[cuts[:, 1] - cuts[:, 0] == 2, 0]
            pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= limit]
            a, b = [marks[pair]], [marks[pair + 1]]
            for start, end in cuts[cuts[:, 1] - cuts[:, 0] > 2].tolist():
                p, q = _near(fps[start:end], limit)
                a.append(marks[start + p])
                b.append(marks[start + q])
            if sum(map(len, a)):
                yield _edges(a, b)

    return run


def _across(alike, best: bool):
    """Pairs of a cell's rows (cell, side, mark, root, value) that ``alike`` and whose roots differ.

    Rows of side 0 meet those of side 1, or each other where the cell has no side 1. With
    ``best`` a row keeps only its likest partner in each other component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, size = [], [], 0
        for (_, sides, marks, roots, values), cells in _by_key(batches):
            for start, end in cells:
                second = np.flatnonzero(sides[start:end]) + start
                first = np.flatnonzero(sides[start:end] == 0) + start
                within = not len(second)
                against = first if within else second
                columns = np.ascontiguousarray(values[against].T)
                for n, row in enumerate(first.tolist()):
                    rest = against[n + 1 :] if within else against
                    if not len(rest):
                        continue
                    score = alike(values[row], columns[..., n + 1 :] if within else columns)
                    near = np.flatnonzero((score >= 0) & (roots[rest] != roots[row]))
                    if best and len(near) > 1:
                        near = near[np.argsort(-score[near], kind="stable")]
                        near = near[np.unique(roots[rest[near]], return_index=True)[1]]
                    if len(near):
                        one.append(np.full(len(near), marks[row]))
                        other.append(marks[rest[near]])
                        size += len(near)
                        if size >= HANDED:
                            yield _edges(one, other)
                            one, other, size = [], [], 0
        if size:
            yield _edges(one, other)

    return run


def _parted(n: str = "n") -> F.Column:
    """The key of a row; a key of more than ``AT_ONCE`` rows becomes as many keys as it needs."""
    fan = F.ceil(F.col(n) / AT_ONCE).cast("long")
    part = F.xxhash64("key", F.pmod(F.xxhash64("mark", "key"), fan))
    return F.when(F.col(n) > AT_ONCE, part).otherwise(F.col("key"))


def _cells(keyed: DataFrame, roots: DataFrame, at_once: int) -> DataFrame:
    """Rows ``cell``, ``side``, ``mark``, ``root`` in which all pairs of a key in different components meet.

    A key wholly in one component has no cell. The rows of a large key are dealt over
    parts, and a cell holds two of them; parts of its largest component meet only parts of the rest.
    """
    of = keyed.join(roots.select(F.col("node").alias("mark"), "root"), "mark", "left")
    of = stage(of.select("key", "mark", F.coalesce("root", "mark").alias("root")), "rooted")
    sizes = of.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    whole = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top"))
    whole = whole.filter(F.col("n") > F.col("top.m"))
    large = F.when(F.col("n") > at_once, F.col("top.m")).otherwise(F.lit(0))
    fans = whole.select(
        "key",
        F.when(F.col("n") > at_once, F.col("top.root")).alias("top"),
        F.ceil((F.col("n") - large) / at_once).cast("long").alias("few"),
        F.ceil(large / at_once).cast("long").alias("many"),
    )
    joined = of.join(fans, "key").withColumn("big", F.coalesce(F.col("root") == F.col("top"), F.lit(False)))
    joined = joined.withColumn("at", F.pmod(F.xxhash64("mark", "key"), F.when(F.col("big"), F.col("many")).otherwise(F.col("few"))))

    def cell(i, j, side):
        return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    at, few, many, zero = F.col("at"), F.col("few"), F.col("many"), F.lit(0).cast("long")
    rest = F.transform(F.sequence(zero, few - 1), lambda x: cell(F.least(at, x), F.greatest(at, x), x < at))
    top = F.transform(F.sequence(zero, F.greatest(many, F.lit(1)) - 1), lambda y: cell(at, few + y, F.lit(0)))
    own = F.transform(F.sequence(zero, few - 1), lambda x: cell(x, few + at, F.lit(1)))
    met = F.when(F.col("big"), own).when(many > 0, F.concat(rest, top)).otherwise(rest)
    exploded = joined.select("key", "mark", "root", F.explode(met).alias("c"))
    return exploded.select(F.xxhash64("key", "c.i", "c.j").alias("cell"), "c.side", "mark", "root")


def links(prints: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints that connect all within ``limit`` bits.

    Each different fingerprint goes once to each of its 64 variant keys; equal keys meet
    in one sorted run and are verified there. Of a run only a spanning forest of its true
    links is returned, so a group of n near copies gives n - 1 links for a key, not
    n * n. Equal texts are one fingerprint here, so a run holds only what differs. Keys are
    counted first: one of more than ``AT_ONCE`` rows is dealt over tasks in parts, and what
    the parts leave in different components is compared afterwards, parts by parts.
    """
    if not 0 < limit <= 3:
        raise ValueError("two one-wildcard halves cover one to three differing bits")
    keyed = prints.select("fp").distinct().select(F.explode(variant_keys()).alias("key"), F.col("fp").alias("mark"))
    hot = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > AT_ONCE), "hot")
    some = bool(hot.limit(1).count())
    if some:
        parted = keyed.join(F.broadcast(hot), "key", "left").select(_parted().alias("key"), "mark")
    else:
        parted = keyed
    dealt = parted.repartition("key").sortWithinPartitions("key", "mark")
    found = map_arrow(dealt, _run_links(limit), "a long, b long").distinct()
    if not some:
        return found
    found = stage(found, "near")
    cells = _cells(keyed.join(F.broadcast(hot.select("key")), "key", "left_semi"), connected_components(found), AT_ONCE)
    cells = cells.withColumn("fp", F.col("mark")).repartition("cell").sortWithinPartitions("cell")

    def within(own: np.int64, others: np.ndarray) -> np.ndarray:
        return limit - np.bitwise_count(own.view(np.uint64) ^ others.view(np.uint64)).astype(np.int16)

    return found.unionByName(map_arrow(cells, _across(within, True), "a long, b long")).distinct()


def components(docs: DataFrame, width: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """Every row's ``doc_id``, ``mark``, ``fp``, the ``root`` fingerprint of its component and ``component_id``."""
    prints = stage(fingerprints(docs, width), "prints")
    roots = connected_components(links(prints, limit))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = lowest.join(roots, lowest.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of ``limit`` or fewer
    differing bits, its own included. Texts that are null or have no words share
    fingerprint zero. Repeated rows are returned as often as they come. A null doc_id is
    never the smallest unless its component has no other. Other columns are ignored; an
    empty table gives no rows. Copies and hot fingerprints are combined before any link
    is sought, and the last join has one row per fingerprint on its small side.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return components(docs, width, limit).select("doc_id", hexed, "component_id")


def signature(text: str | None, width: int = SIMILAR_WORDS) -> np.ndarray:
    """Minima of the shingles' hashes under ``MINIMA`` mixings; a text without words has all ones."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for part in shingle_hashes(text, width, MIXED):
        np.minimum(least, (part[:, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least


def _segment_keys(least: np.ndarray) -> list[int]:
    keys = []
    for segment in range(SEGMENTS):
        values = least[segment * SEGMENT : (segment + 1) * SEGMENT]
        for gone in range(SEGMENT):
            rest = np.delete(values, gone).tobytes()
            keys.append(xxhash.xxh64_intdigest(rest, segment * SEGMENT + gone))
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, width: int = SIMILAR_WORDS) -> DataFrame:
    """One row per different text: its ``mark``, the ``keys`` of its segments and a ``sketch`` of one byte per minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            least = [signature(t.as_py(), width) for t in batch.column(1)]
            sketches = [(m >> np.uint64(16)).astype(np.uint8).tobytes() for m in least]
            keys = [_segment_keys(m) for m in least]
            yield record(_SIGNATURES, {"mark": batch.column(0), "keys": keys, "sketch": sketches})

    rows = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return map_arrow(rows, run, "mark long, keys array<long>, sketch binary").dropDuplicates(["mark"])


def _agreeing(level: float) -> float:
    """Bytes of two sketches that agree at an estimate of ``level``; those of different minima do once in 256 times."""
    return np.ceil(MINIMA * (level + (1 - level) / 256))


def _sketch_forest(sketches: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the estimates of ``level`` or more, found breadth first like :func:`_forest`.

    Each row is tied to the likest row of the part of the front that reaches it.
    """
    needed = _agreeing(level)
    parents, children = [], []
    left = np.arange(len(sketches))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached, at = [], 0
            while at < len(front) and len(left):
                part = front[at : at + max(1, (COMPARED << 5) // (MINIMA * len(left)))]
                at += len(part)
                same = np.empty((len(part), len(left)), np.int16)
                columns = np.ascontiguousarray(sketches[left].T)
                for row, own in enumerate(sketches[part]):
                    same[row] = (columns == own[:, None]).sum(axis=0, dtype=np.uint8)
                hit = same.max(axis=0) >= needed
                if hit.any():
                    parents.append(part[same[:, hit].argmax(axis=0)])
                    children.append(left[hit])
                    reached.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(reached) if reached else left[:0]
    if not parents:
        return left[:0], left[:0]
    return np.concatenate(parents), np.concatenate(children)


def _alike(sketches: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Likely links of one key, which connect most of it before pairs are sought between components."""
    return [_sketch_forest(sketches, level) for level in LEVELS]


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, marks, sketches), runs in _by_key(batches):
        cuts = np.array(runs)
        pair = cuts[cuts[:, 1] - cuts[:, 0] == 2, 0]
        pair = pair[(sketches[pair] == sketches[pair + 1]).sum(axis=1) >= _agreeing(LEAST)]
        a, b = [marks[pair]], [marks[pair + 1]]
        for start, end in cuts[cuts[:, 1] - cuts[:, 0] > 2].tolist():
            for p, q in _alike(sketches[start:end]):
                a.append(marks[start + p])
                b.append(marks[start + q])
        if sum(map(len, a)):
            yield _edges(a, b)


def distinct_shingles(text: str | None, width: int = SIMILAR_WORDS) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of two texts' different shingles; two texts without words are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell (cell, side, mark, root, sketch) with a likely partner in another component there."""
    needed = _agreeing(LEAST)
    for (cells, sides, marks, roots, sketches), runs in _by_key(batches):
        likely = np.zeros(len(cells), bool)
        for start, end in runs:
            first, second = _sides(sides[start:end], start)
            columns = np.ascontiguousarray(sketches[second].T)
            for row in first.tolist():
                other = second[(columns == sketches[row][:, None]).sum(axis=0, dtype=np.uint8) >= needed]
                other = other[roots[other] != roots[row]]
                likely[other] = True
                likely[row] |= len(other) > 0
        if likely.any():
            yield record(_CELLED, {"cell": cells[likely], "side": sides[likely], "mark": marks[likely], "root": roots[likely]})


def _sides(sides: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that look for partners and rows that are partners: all, or side 0 and side 1 where there is a side 1."""
    second = np.flatnonzero(sides) + start
    first = np.flatnonzero(sides == 0) + start
    return (first, second) if len(second) else (first, first)


def _exact_links(width: int, similarity: float):
    """Of each cell (cell, side, mark, root, text) links of ``similarity`` or more that connect its components.

    The texts' shingles are numbered and each number lists its texts, so the common shingles of one text
    with all others are counted at once and exactly. Rows out are fewer than rows in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, marks, roots, sets in _cell_texts(batches, width):
            first, second = _sides(sides, 0)
            sizes = np.array([len(x) for x in sets])
            empty = np.flatnonzero(sizes == 0)
            owners = np.repeat(second, sizes[second])
            listed = np.concatenate([np.zeros(0, np.uint64), *[sets[n] for n in second.tolist()]])
            order = np.argsort(listed, kind="stable")
            listed, owners = listed[order], owners[order]
            group = np.unique(roots, return_inverse=True)[1]
            one, other = [], []
            for row in first.tolist():
                own = sets[row]
                low, high = np.searchsorted(listed, own), np.searchsorted(listed, own, side="right")
                common = np.bincount(owners[_spans(low, high)], minlength=len(sizes))
                with np.errstate(invalid="ignore"):
                    alike = common / (sizes[row] + sizes - common) >= similarity
                if not sizes[row]:
                    alike[empty] = True
                hits = second[alike[second] & (group[second] != group[row])]
                for hit in hits.tolist():
                    if group[hit] != group[row]:
                        group[group == group[hit]] = group[row]
                        one.append(marks[row])
                        other.append(marks[hit])
            if one:
                yield _edges([np.array(one)], [np.array(other)])

    return run


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    length = high - low
    return np.repeat(low - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _cell_texts(batches: Iterator[pa.RecordBatch], width: int):
    """Sides, marks, roots and different shingles of one cell after the other; rows come sorted by cell."""
    cell, held = None, []
    for batch in slices(batches, 100):
        cells, sides, marks, roots = (batch.column(c).to_pylist() for c in range(4))
        for n, own in enumerate(cells):
            if held and own != cell:
                yield _columns(held)
                held = []
            cell = own
            held.append((sides[n], marks[n], roots[n], distinct_shingles(batch.column(4)[n].as_py(), width)))
    if held:
        yield _columns(held)


def _columns(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    sides, marks, roots, sets = zip(*rows, strict=True)
    return np.array(sides), np.array(marks), np.array(roots), list(sets)


def similar_links(docs: DataFrame, width: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` between marks of different texts whose word shingles agree by ``similarity`` or more.

    Three bits of a SimHash stand for far more than 0.8, so the signature here is one of
    minima; it is indexed as the fingerprints are: cut into segments, each without one of
    its values, equal keys meet and are verified. Two texts that agree by 0.8 share a
    key but once in a thousand times. In each key forests of likely links come first and are
    checked on the whole texts. What then still lies in different components of a key
    and has a likely partner there meets in cells with its text, where all pairs of components
    are compared exactly; a cell returns only links that connect its components. So only links
    inside a component are skipped, however large the key, and no stage returns pairs.
    """
    signed = stage(signatures(docs, width), "signatures")
    sketches = signed.select("mark", "sketch")
    keyed = signed.select("mark", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = stage(keyed.join(shared, "key").select("key", "mark", "n"), "keys")
    texts = stage(_texts(docs, keyed.select("mark").distinct()), "texts")
    parted = keyed.select(_parted().alias("key"), "mark").join(sketches, "mark").select("key", "mark", "sketch")
    dealt = parted.repartition("key").sortWithinPartitions("key", "mark")
    likely = stage(map_arrow(dealt, _sketch_links, "a long, b long").distinct(), "likely")
    found = stage(_verified(texts, likely, width, similarity), "similar")
    cells = _cells(keyed.select("key", "mark"), connected_components(found), TEXTS_AT_ONCE).join(sketches, "mark")
    cells = cells.select("cell", "side", "mark", "root", "sketch").repartition("cell").sortWithinPartitions("cell")
    left = stage(map_arrow(cells, _likely_rows, "cell long, side int, mark long, root long"), "left")
    meet = left.join(texts, "mark").select("cell", "side", "mark", "root", "text")
    meet = meet.repartition("cell").sortWithinPartitions("cell")
    more = stage(map_arrow(meet, _exact_links(width, similarity), "a long, b long").distinct(), "similar")
    return found.unionByName(more)


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``mark`` and ``text`` of the texts with these marks, each once.

    A task hands on the copies of a text once for as long as it remembers it, so that a text
    with many copies is not gathered in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for batch in batches:
            new = []
            for mark in batch.column(0).to_pylist():
                new.append(mark not in seen)
                seen[mark] = None
                if len(seen) > REMEMBERED:
                    del seen[next(iter(seen))]
            yield batch.filter(pa.array(new, pa.bool_()))

    rows = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "mark long, text string").join(marks, "mark", "left_semi").dropDuplicates(["mark"])


def _verified(texts: DataFrame, likely: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs of marks whose whole texts are as similar."""
    pairs = likely
    for end, other in (("a", "b"), ("b", "a")):
        side = texts.select(F.col("mark").alias(end), F.col("text").alias(f"text_{end}"))
        pairs = join_unique(pairs, side, [end], "inner", other, HUB_LINKS)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, own = None, None
        for batch in batches:
            hit = []
            for b, one, other in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if own is None or b != mark:  # rows mostly come in order of b
                    mark, own = b, distinct_shingles(other.as_py(), width)
                hit.append(jaccard(distinct_shingles(one.as_py(), width), own) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), check, "a long, b long")


def keep_one(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    limit: int = MAX_BITS,
    words: int = SIMILAR_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The documents without near duplicates: of each component the row of its smallest doc_id.

    Documents are linked by fingerprints of ``limit`` or fewer differing bits, and by
    shingles of ``words`` words that agree by ``similarity`` or more; see
    :func:`similar_links`. Texts that are null or have no words are alike. Columns stay as
    they are. Rows that share this doc_id are told apart by their texts, and of rows alike
    in both one stays. A component whose doc_ids are all null keeps one.
    """
    prints = stage(components(docs, width, limit).select("doc_id", "mark", "root"), "components")
    near = similar_links(docs, words, similarity)
    of = prints.select("mark", "root").distinct()
    for end, root in (("a", "one"), ("b", "other")):
        near = near.join(of.select(F.col("mark").alias(end), F.col("root").alias(root)), end)
    joined = connected_components(near.select(F.col("one").alias("a"), F.col("other").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = prints.join(joined, "root", "left").select("doc_id", "mark", F.coalesce("top", "root").alias("root"))
    found = stage(found, "groups")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("first")
    winners = found.groupBy("root").agg(first).select("first.doc_id", "first.mark")
    repeated = found.groupBy("doc_id", "mark").count().filter("count > 1")
    mark, other_id, other = (unused(docs, c) for c in ("_mark", "_won_id", "_won_mark"))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    won = winners.select(F.col("doc_id").alias(other_id), F.col("mark").alias(other))
    kept = marked.join(won, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(mark) == F.col(other)), "left_semi")
    twice = won.join(repeated, F.col(other_id).eqNullSafe(repeated["doc_id"]) & (F.col(other) == repeated["mark"]), "left_semi")
    if twice.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns)
