"""Benchmark decontamination with an FM-index over the words of each training shard."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import laid, map_arrow, record, text_groups, unused
from feedloom.session import stage

WINDOW = 10
# Text bytes of one index. A task holds one index at a time.
SHARD_BYTES = 2_000_000
# Words of one indexed segment; segments overlap by a window less one, so no occurrence is split.
SEGMENT = 128
# Every so many words a position is stored; the others are reached by walking back.
SAMPLING = 8
# Benchmark bytes sent to the executors at a time. A larger benchmark is searched in blocks.
BLOCK_BYTES = 16_000_000

# Bytes outside words become spaces, A to Z become a to z; bytes of other letters stay.
_FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class FmIndex:
    """FM-index of word sequences: suffix order, wavelet levels of the last column, sampled positions.

    Segments end in separators that differ from each other, so the suffix order is total
    and is settled after at most a segment's words.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, window: int = WINDOW, segment: int = SEGMENT):
        stride = segment - window + 1
        count = np.maximum(1, -(-(sizes - window + 1) // stride))
        doc_at = np.cumsum(sizes) - sizes
        nth = laid(np.arange(count.max(initial=1)), np.zeros(len(count), np.int64), count)
        owner = np.repeat(np.arange(len(sizes)), count)
        #: First word of each segment in the shard, and its words.
        self.begins = doc_at[owner] + nth * stride
        lengths = np.minimum(segment, sizes[owner] - nth * stride)
        self.places = np.cumsum(lengths + 1) - lengths - 1
        n, marks = int((lengths + 1).sum()), len(lengths)
        text = np.empty(n, np.int64)
        separators = self.places + lengths
        text[separators] = np.arange(marks)
        inside = np.ones(n, bool)
        inside[separators] = False
        text[inside] = laid(ids, self.begins, lengths) + marks
        self.first_word, self.n = marks, n
        self.symbols = int(text.max(initial=0)) + 1
        order = self._suffixes(text)
        self.heads = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))
        self._levels(text[order - 1])
        sampled = order % SAMPLING == 0
        self.kept = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.samples = order[sampled]
        self.origin = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; only suffixes that still tie are sorted again."""
        n, bits = len(text), max(1, int(self.symbols).bit_length())
        step = max(1, min(3, 62 // bits))
        key = np.zeros(n, np.int64)
        for k in range(step):
            key <<= bits
            key[: n - k] |= text[k:]
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        at = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = np.diff(key[order]) != 0
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        while len(tied):
            some = order[tied]
            key = rank[some] * n + rank[np.minimum(some + step, n - 1)]
            by = np.argsort(key)
            key, some = key[by], some[by]
            order[tied] = some
            new = np.ones(len(tied), bool)
            new[1:] = np.diff(key) != 0
            rank[some] = np.maximum.accumulate(np.where(new, tied, 0))
            tied = tied[~new | ~np.append(new[1:], True)]
            step *= 2
        return order

    def _levels(self, column: np.ndarray) -> None:
        self.shifts = list(range(int(self.symbols).bit_length() - 1, -1, -1))
        self.ones, self.zeros = [], []
        column = column.astype(np.int32)
        for shift in self.shifts:
            bit = (column >> shift & 1).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            column = np.concatenate((column[~bit], column[bit]))

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows after all wavelet levels; less the symbol's origin this is its rank before the row."""
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            up = ones[row]
            row = np.where(symbol >> shift & 1, zeros + up, row - up)
        return row

    def _back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that starts one word earlier."""
        symbol = np.zeros(len(row), np.int64)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            up = ones[row]
            bit = ones[row + 1] > up
            symbol |= bit.astype(np.int64) << shift
            row = np.where(bit, zeros + up, row - up)
        return self.heads[symbol] + row - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns. A pattern is right-aligned in its row; -1 is a word the shard lacks."""
        width = patterns.shape[1]
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for back in range(width):
            going = alive[lengths[alive] > back]
            symbol = patterns[going, width - 1 - back]
            known = symbol >= 0
            high[going[~known]] = low[going[~known]]
            going, symbol = going[known], symbol[known] + self.first_word
            low[going] = self.heads[symbol] + self._down(symbol, low[going]) - self.origin[symbol]
            high[going] = self.heads[symbol] + self._down(symbol, high[going]) - self.origin[symbol]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word of the shard at which the suffix of each row starts."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            hit = self.kept[here + 1] > self.kept[here]
            done = left[hit]
            found[done] = self.samples[self.kept[rows[done]]] + steps[done]
            left = left[~hit]
            rows[left] = self._back(rows[left])
            steps[left] += 1
        segment = np.searchsorted(self.places, found, side="right") - 1
        return self.begins[segment] + found - self.places[segment]


class Phrases:
    """Different windows of the benchmark items, right-aligned, and the items each belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        found: dict[tuple[bytes, ...], set[int]] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: n for n, name in enumerate(self.names)}
        for item, text in items:
            listed = words(text)
            width = min(window, len(listed))
            for at in range(len(listed) - width + 1 if listed else 0):
                owners = found.setdefault(tuple(listed[at : at + width]), set())
                if item is not None:
                    owners.add(number[str(item)])
        self.vocabulary = sorted({w for key in found for w in key})
        code = {w: n for n, w in enumerate(self.vocabulary)}
        self.lengths = np.array([len(key) for key in found], np.int64)
        self.codes = np.full((len(found), window), len(code), np.int64)
        for n, key in enumerate(found):
            self.codes[n, window - len(key) :] = [code[w] for w in key]
        counts = [len(v) for v in found.values()]
        self.owner_at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.owners = np.array([n for v in found.values() for n in sorted(v)], np.int64)


def hits(texts: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Which words of the shard lie in an occurrence, the words of each text, and the items found in each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    items: list[list[int]] = [[] for _ in texts]
    covered = np.zeros(total, bool)
    if not total or not len(phrases.lengths):
        return covered, sizes, items
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.concatenate([np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts])
    index = FmIndex(ids, sizes, phrases.window)
    here = np.array([known.get(w, -1) for w in phrases.vocabulary] + [-1], np.int64)
    low, high = index.search(here[phrases.codes], phrases.lengths)
    many = high - low
    rows = laid(np.arange(index.n), low, many)
    which = np.repeat(np.arange(len(many)), many)
    if not len(rows):
        return covered, sizes, items
    start = index.locate(rows)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + phrases.lengths[which], -1)
    covered = np.cumsum(edge[:-1]) > 0
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    pairs = np.unique(text * len(many) + which)
    text, which = pairs // len(many), pairs % len(many)
    owned = phrases.owner_at[which + 1] - phrases.owner_at[which]
    item = laid(phrases.owners, phrases.owner_at[which], owned)
    width = max(1, len(phrases.names))
    for pair in np.unique(np.repeat(text, owned) * width + item).tolist():
        items[pair // width].append(pair % width)
    return covered, sizes, items


_FOUND = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())]
    + [("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
FOUND = "row long, doc_id long, n_words long, starts array<long>, lengths array<long>, items array<string>"


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _scan(phrases) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in text_groups(batches, SHARD_BYTES):
            raw, at = data.tobytes().translate(_FOLD), np.concatenate(([0], ends)).tolist()
            covered, sizes, items = hits([raw[a:b].split() for a, b in zip(at, at[1:], strict=False)], phrases.value)
            last = np.cumsum(sizes)
            spans: list[tuple[list[int], list[int]]] = [([], [])] * len(sizes)
            for n in [n for n, found in enumerate(items) if found or covered[last[n] - sizes[n] : last[n]].any()]:
                a, b = _runs(covered[last[n] - sizes[n] : last[n]])
                spans[n] = a.tolist(), b.tolist()
            names = phrases.value.names
            yield record(
                _FOUND,
                {"row": rows.column(0), "doc_id": rows.column(1), "n_words": sizes}
                | {"starts": [s for s, _ in spans], "lengths": [n for _, n in spans]}
                | {"items": [[names[i] for i in found] for found in items]},
            )

    return run


def blocks(benchmark: DataFrame, limit: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 64)).first()[0] or 0
    return max(1, -(-size // limit))


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removal spans of every document: ``doc_id``, ``n_words``, ``starts`` and ``lengths`` in words, ``items``.

    Words are runs of ASCII digits, a to z (A to Z folded) and all non-ASCII characters.
    Every ``window`` consecutive words of an item are a phrase; a shorter item is one
    phrase; an item without words has none. Overlapping occurrences are one span. Nulls
    and empty texts have no words. Repeated rows, repeated items and equal phrases of
    several items each count for what they are; a null item_id hits but is not listed.

    Each task indexes its documents shard by shard, so nothing is shuffled. The
    benchmark is measured first and sent in blocks of ``block_bytes``; with several blocks
    the documents are written with row numbers once and the findings joined by them.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n = blocks(items, block_bytes)
    context = docs.sparkSession.sparkContext
    if n == 1:
        phrases = context.broadcast(Phrases([tuple(r) for r in items.collect()], window))
        return map_arrow(rows, _scan(phrases), FOUND)
    rows, found = stage(rows, "numbered"), None
    for block in range(n):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        phrases = context.broadcast(Phrases([tuple(r) for r in some.collect()], window))
        part = stage(map_arrow(rows, _scan(phrases), FOUND), "found")
        phrases.destroy()
        found = part if found is None else found.unionByName(part)
    cover = F.flatten(F.collect_list(F.arrays_zip("starts", "lengths")))
    merged = found.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(cover).alias("cover"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    # Spans in order of their starts; one that begins inside the last is folded into it.
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (s.starts <= F.element_at(done, -1).starts + F.element_at(done, -1).lengths),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(
                F.struct(
                    F.element_at(done, -1).starts.alias("starts"),
                    (
                        F.greatest(F.element_at(done, -1).starts + F.element_at(done, -1).lengths, s.starts + s.lengths)
                        - F.element_at(done, -1).starts
                    ).alias("lengths"),
                )
            ),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    none = F.array().cast("array<struct<starts:bigint,lengths:bigint>>")
    joined = merged.withColumn("cover", F.aggregate("cover", none, step))
    return joined.select("row", "doc_id", "n_words", "cover.starts", "cover.lengths", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the words hit and a digest of the items found; see :func:`spans`."""
    n_hit = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    listed = F.concat_ws(",", F.array_sort("items"))
    return spans(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: str, found: list[tuple[int, int]]) -> str:
    """The text less its spans, each with the white space before it."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_CASE))]
    kept, done = [], 0
    for start, length in found:
        kept.append(raw[done : at[start][0]].rstrip())
        done = at[start + length - 1][1]
    return b"".join((*kept, raw[done:])).decode("utf-8", "surrogatepass")


_CASE = bytes(b + 32 if chr(b).isupper() and b < 0x80 else b for b in range(256))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their removal spans cut out of the texts; clean documents stay as they are.

    Columns and types stay; ``n_chars`` follows the text where the table has it. A text
    that is wholly benchmark becomes what is left, perhaps empty; no row is dropped.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    context, schema = docs.sparkSession.sparkContext, docs.schema
    sent = [
        context.broadcast(Phrases([tuple(r) for r in some.collect()], window))
        for some in _cut(items, blocks(items, BLOCK_BYTES))
    ]
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in text_groups(batches, SHARD_BYTES):
            raw, cut = data.tobytes().translate(_FOLD), np.concatenate(([0], ends)).tolist()
            listed = [raw[a:b].split() for a, b in zip(cut, cut[1:], strict=False)]
            covered = None
            for phrases in sent:
                more, sizes, _ = hits(listed, phrases.value)
                covered = more if covered is None else covered | more
            last = np.cumsum(sizes)
            texts = rows.column(rows.num_columns - 1).to_pylist()
            for n in np.unique(np.searchsorted(last, np.flatnonzero(covered), side="right")).tolist():
                a, b = _runs(covered[last[n] - sizes[n] : last[n]])
                texts[n] = _without(texts[n], list(zip(a.tolist(), b.tolist(), strict=True)))
            columns = list(rows.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    cleaned = map_arrow(docs.withColumn(unused(docs, "_text"), F.col("text").cast("string")), run, schema)
    if "n_chars" not in names:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))


def _cut(items: DataFrame, n: int) -> list[DataFrame]:
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]
