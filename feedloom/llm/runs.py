"""Periodic runs of words by internal pattern matching.

All blocks of 2^k words that start at a multiple of 2^k are sought in the window behind them, among the
starts at distance 2^k to 2^(k+1): the suffix array gives the block's interval, a wavelet tree over it the first, second
and last occurrence in the window. These lie in one arithmetic progression. A run of period q and
length 3q or more holds such a block whose copy one period later is in its window, so its
period is among the candidates, which are then extended to both sides and checked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, record, text_groups

# A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Words of the smallest block: periods up to it need no window of their own.
BLOCK_LEVEL = 3
# Bytes of text that are searched together, and that are cut into words at a time.
GROUP_BYTES, CUT_BYTES = 1 << 20, 1 << 20
# Every how many rows the test repetition is planted, its least exponent and the number of its exponents.
PLANTED_EVERY, LEAST_EXPONENT, EXPONENTS = 10, 3, 8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUNS)), ("collapsed", pa.large_string())])


class Wavelet:
    """Wavelet tree of a permutation: counts and order statistics of stretches, by one bit a level and value."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            words = np.zeros(self.size // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            zeros = self.size - int(ones.sum())
            self.levels.append((words, before, zeros))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def below(self, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values in [start, end) are below ``limit``."""
        start, end = start.copy(), end.copy()
        found = np.where(limit >= 1 << self.bits, end - start, 0)
        alive = limit < 1 << self.bits
        for level, (words, before, zeros) in enumerate(self.levels):
            one = (limit >> (self.bits - 1 - level) & 1).astype(bool)
            s, e = self._rank(words, before, start), self._rank(words, before, end)
            found += np.where(alive & one, (end - e) - (start - s), 0)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return found

    def nth(self, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of rank ``n`` (from 0) in [start, end)."""
        start, end, n = start.copy(), end.copy(), n.copy()
        value = np.zeros(len(n), np.int64)
        for words, before, zeros in self.levels:
            s, e = self._rank(words, before, start), self._rank(words, before, end)
            low = (end - e) - (start - s)
            one = n >= low
            n = np.where(one, n - low, n)
            value = value << 1 | one
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return value


def _names(words: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of all blocks of 2^k words, level by level, and the suffix array of the words.

    A name is the place of the block's bucket in the suffix array so far. Blocks that pass
    the end of their text equal no other, so no block spans two texts. Only buckets
    of several blocks are refined, and the levels end when there are none.
    """
    total = len(words)
    lengths = np.diff(np.concatenate(([0], ends)))
    text = np.repeat(np.arange(len(ends)), lengths)
    end = np.repeat(ends, lengths)
    order = np.lexsort((words, text))
    first = np.ones(total, bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.flatnonzero(first)
    rank = np.empty(total, np.int64)
    rank[order] = np.repeat(place, np.diff(np.concatenate((place, [total]))))
    sizes = np.diff(np.concatenate((place, [total])))
    active = order[np.repeat(sizes, sizes) > 1]
    levels = [rank.astype(np.int32)]
    width = 1
    while len(active):
        after = active + width
        # Past the end of its text a block comes first; such blocks differ in where they end.
        second = np.where(after < end[active], rank[np.minimum(after, total - 1)] + 1, 0)
        key = rank[active] * (total + 1) + second
        sort = np.argsort(key, kind="stable")
        active, key = active[sort], key[sort]
        old, inside = rank[active], np.arange(len(active))
        fresh, new = np.ones(len(active), bool), np.ones(len(active), bool)
        fresh[1:] = old[1:] != old[:-1]
        new[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(fresh, inside, 0))
        group = np.maximum.accumulate(np.where(new, inside, 0))
        rank[active] = old + group - start
        sizes = np.diff(np.concatenate((np.flatnonzero(new), [len(active)])))
        active = active[np.repeat(sizes, sizes) > 1]
        levels.append(rank.astype(np.int32))
        width *= 2
    array = np.empty(total, np.int64)
    array[rank] = np.arange(total)
    return levels, array


def _ahead(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words agree from ``one`` and ``other`` on; places past the texts agree in none."""
    total, found = len(levels[0]), np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + found, other + found
        inside = np.maximum(a, b) < total
        same = inside & (levels[level][np.where(inside, a, 0)] == levels[level][np.where(inside, b, 0)])
        found += same.astype(np.int64) << level
    return found


def _behind(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words agree before ``one`` and ``other``."""
    found = np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one - found - (1 << level), other - found - (1 << level)
        inside = np.minimum(a, b) >= 0
        same = inside & (levels[level][np.where(inside, a, 0)] == levels[level][np.where(inside, b, 0)])
        found += same.astype(np.int64) << level
    return found


def _window(tree: Wavelet, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray):
    """First, second and last occurrence with a start in [start, end), and their number."""
    below, upto = tree.below(lo, hi, start), tree.below(lo, hi, end)
    count = upto - below
    last = np.maximum(hi - lo - 1, 0)
    places = [tree.nth(lo, hi, np.clip(n, 0, last)) for n in (below, below + 1, upto - 1)]
    return count, *places


def _candidates(levels: list[np.ndarray], array: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that may be those of a run."""
    total = len(array)
    if len(levels) <= BLOCK_LEVEL:  # no block of that many words comes twice
        return array[:0], array[:0]
    tree = None
    lengths = np.diff(np.concatenate(([0], ends)))
    begins = ends - lengths
    places, periods = [array[:0]], [array[:0]]
    for level in range(BLOCK_LEVEL, len(levels)):
        width = 1 << level
        # Blocks start at multiples of their width in their own text.
        count = np.maximum(lengths // width, 0)
        blocks = np.repeat(begins, count) + width * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        end = np.repeat(ends, count)
        names = levels[level]
        sorted_names = names[array]
        lo = names[blocks].astype(np.int64)
        hi = np.searchsorted(sorted_names, names[blocks], side="right")
        again = hi - lo > 1
        blocks, lo, hi, end = blocks[again], lo[again], hi[again], end[again]
        if not len(blocks):
            continue
        tree = tree or Wavelet(array)
        if level == BLOCK_LEVEL:  # periods up to the block itself: its next occurrence
            found, first, _, _ = _window(tree, lo, hi, blocks + 1, np.minimum(blocks + width, end))
            hit = found > 0
            places.append(blocks[hit])
            periods.append(first[hit] - blocks[hit])
        found, first, second, last = _window(tree, lo, hi, blocks + width, np.minimum(blocks + 2 * width, end))
        for hit, at in ((found > 0, first), (found == 2, second)):
            places.append(blocks[hit])
            periods.append(at[hit] - blocks[hit])
        many = found > 2
        own, at, step = blocks[many], first[many], second[many] - first[many]
        # The block repeats itself by ``step`` and so does what is around its occurrences; a larger
        # period moves the edges of the one stretch onto those of the other.
        left, right = _behind(levels, own, own + step), _ahead(levels, own, own + step)
        other_left, other_right = _behind(levels, at, at + step), _ahead(levels, at, at + step)
        for move in ((at - other_left) - (own - left), (at + other_right) - (own + right)):
            hit = move > 0
            places.append(own[hit])
            periods.append(move[hit])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """All runs of the texts laid end to end in ``words``: rows of start, end and smallest period, by start and period."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    levels, array = _names(words, ends)
    at, period = _candidates(levels, array, ends)
    inside = at + period < len(words)
    at, period = at[inside], period[inside]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    at, period = np.unique(np.stack((at, period)), axis=1)
    start = at - _behind(levels, at, at + period)
    end = at + period + _ahead(levels, at, at + period)
    long = end - start >= np.maximum(least, times * period)
    found = np.unique(np.stack((start, end, period), axis=1)[long], axis=0)
    # A multiple of the smallest period gives the same stretch.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _cut(text: np.ndarray, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Numbers of a text's words; equal words of a group of texts have equal numbers. Long texts go in stretches."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CUT_BYTES)
        while to < len(text) and not _SPACE[text[to]]:  # to the end of the word
            more = _SPACE[text[to : to + CUT_BYTES]]
            to += int(np.argmax(more)) if more.any() else len(more)
        yield np.array([known.setdefault(w, len(known)) for w in text[at:to].tobytes().split()], np.int32)
        at = to


def planted(words: np.ndarray, doc_id: int | None, every: int = PLANTED_EVERY) -> np.ndarray:
    """The words, with the repetition that the row number calls for, if any."""
    mark = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or mark % every or not len(words):
        return words
    part = mark // every
    start = part % len(words)
    period = 1 + (len(words) - start) // (LEAST_EXPONENT + part % EXPONENTS)
    return np.concatenate((words[:start], words[start + np.arange(len(words) - start) % period]))


def _collapsed(words: np.ndarray, spelled: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what a run repeats of its first period, joined by single spaces."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = words[np.cumsum(gone[:-1]) == 0]
    return b" ".join([spelled[n] for n in kept.tolist()])


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, its ``runs`` and its ``collapsed`` text.

    Words are what ASCII white space separates, numbered from 0. A run is a maximal stretch whose
    smallest period is q, of ``least`` words and ``times`` periods or more (``times`` is 3 at
    least: the search relies on it); ``runs`` are structs of start, length and period by
    start, then period. The collapsed text has no word that a run holds after its first q
    words. ``plant`` first puts the test repetition of the contract into the rows whose number asks for it. Null, empty
    and blank texts have no words, no runs and an empty collapsed text. Repeated rows come as
    often as they do in the table, a null doc_id is never planted, other columns are
    ignored and an empty table gives no rows. A text is searched whole, as a run may span it:
    time grows as n log n, and memory with its words times the levels at which blocks still repeat.
    """
    if times < 3 or least < 3 << BLOCK_LEVEL:
        raise ValueError(f"runs of {3 << BLOCK_LEVEL} words and 3 periods or more are found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, ends in text_groups(batches, GROUP_BYTES):
            known: dict[bytes, int] = {}
            texts, at = [], 0
            for doc_id, to in zip(rows.column(0).to_pylist(), ends.tolist(), strict=True):
                parts = [np.zeros(0, np.int32), *_cut(flat[at:to], known)]
                words = np.concatenate(parts)
                texts.append(planted(words, doc_id) if plant else words)
                at = to
            stops = np.cumsum([len(t) for t in texts])
            words = np.concatenate(texts)
            found = find_runs(words, stops, least, times)
            of = np.searchsorted(stops, found[:, 0], side="right")
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            spelled = list(known)
            listed, collapsed = [], []
            for n, text in enumerate(texts):
                own = found[cuts[n] : cuts[n + 1]] - np.array([stops[n] - len(text)] * 2 + [0])
                listed.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                collapsed.append(_collapsed(text, spelled, own).decode("utf-8", "surrogatepass"))
            columns = {"doc_id": rows.column(0), "n_words": [len(t) for t in texts], "runs": listed, "collapsed": collapsed}
            yield record(_FOUND, columns)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(
        given, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`periodic_runs` with planted repetitions: one row per document.

    ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the run with the greatest
    exact length / period, ties to the smallest start, then period (null without a run); and
    hashes of the list of runs and of the collapsed text.
    """

    def greater(best: Column, own: Column) -> Column:
        # Products instead of quotients: exact. Runs come in the order that settles ties.
        more = best["length"].isNull() | (own["length"] * best["period"] > best["length"] * own["period"])
        return F.when(more, own).otherwise(best)

    found = periodic_runs(docs, plant=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = found.withColumn("best", F.aggregate("runs", none, greater))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
