"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is taken as the set of its letters, each numbered among its equals: a binary vector. One
inserted or deleted letter changes one place of it, a replaced one two. The places are
dealt over parts; of ``PARTS`` parts two at most differ, so two near words agree in all the
rest. Every choice of ``PARTS`` - 2 parts gives a signature, equal signatures meet, and what meets is
verified on the words.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, record, slices, text_groups
from feedloom.operators.skew import heavy_keys, join_unique
from feedloom.session import stage

LEAST_LETTERS, LEAST_COUNT = 7, 2
# A word's form is at least so many times as frequent.
TIMES = 10
# Of the runs in the documents one in so many loses a letter, as the contract plants them.
PLANTED = 31
# Parts of the letters' places; places that differ between near words.
PARTS, DISTANCE = 6, 2
# Different words that a task counts before it hands them on.
COUNTED = 200_000
# Words of one signature that a task compares as they are; more are dealt over several.
AT_ONCE = 4096
# Rows whose cells are searched at a time, likely pairs verified at a time, and the longest words that lie in rows.
GATHERED, PAIRS, WIDE = 1 << 16, 1 << 19, 32
# Bytes of text cut into words at a time.
CUT_BYTES = 1 << 20

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_SIGNED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random, equal for equal ones."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _spaced(text: np.ndarray) -> bytes:
    """UTF-8 text with A to Z lower-cased and a space for every byte that belongs to no letter."""
    out = np.empty(len(text), np.uint8)
    for at in range(0, len(text), CUT_BYTES):
        # A byte more on both sides: letters above U+00BF are two bytes.
        own = text[max(0, at - 1) : at + CUT_BYTES + 1]
        low = np.where((own >= 65) & (own <= 90), own + 32, own)
        lead = np.zeros(len(own), bool)
        lead[:-1] = (own[:-1] == 0xC3) & (own[1:] & 0xC0 == 0x80)
        letter = (low >= 97) & (low <= 122) | lead
        letter[1:] |= lead[:-1]
        skip = min(at, 1)
        part = np.where(letter, low, 32)[skip : skip + CUT_BYTES]
        out[at : at + len(part)] = part
    return out.tobytes()


def runs(spaced: bytes) -> Iterator[list[bytes]]:
    """Maximal runs of letters, a stretch of text at a time."""
    at = 0
    while at < len(spaced):
        to = spaced.find(b" ", at + CUT_BYTES)
        to = len(spaced) if to < 0 else to
        yield spaced[at:to].split()
        at = to


def letters(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def planted(run: bytes, mark: int) -> bytes:
    """The run without the letter that ``mark`` points at."""
    word = run.decode()
    at = mark % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def counted(docs: DataFrame, plant: bool = False, least: int = LEAST_LETTERS) -> DataFrame:
    """``word`` and its number ``n`` in all documents, for words of ``least`` letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            columns = {"word": [w.decode() for w in seen], "n": list(seen.values())}
            seen.clear()
            return record(_COUNTS, columns)

        for rows, flat, ends in text_groups(batches, CUT_BYTES):
            spaced, at = _spaced(flat), 0
            for doc_id, to in zip(rows.column(0).to_pylist(), ends.tolist(), strict=True):
                prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for some in runs(spaced[at:to]):
                    # No fewer bytes than letters, and none is added.
                    some = [w for w in some if len(w) >= least]
                    if plant:
                        marks = [zlib.crc32(w, prefix) for w in some]
                        some = [w if m % PLANTED else planted(w, m) for w, m in zip(some, marks, strict=True)]
                    seen.update([w for w in some if letters(w) >= least])
                    if len(seen) >= COUNTED:
                        yield handed()
                at = to
        if seen:
            yield handed()

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = map_arrow(given, run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words end to end, one byte each, and the words' lengths."""
    data = words.cast(pa.large_binary())
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lead = flat == 0xC3  # the only lead byte there is
    before = np.concatenate(([0], np.cumsum(~lead)))
    kept = flat[~lead]
    return np.where(kept >= 0x80, kept + 0x40, kept), np.diff(before[offsets - offsets[0]])


def _places(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the place of every letter: the letter and how many equal ones come before it in the word."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(of << 8 | flat, kind="stable")
    flat = flat[order].astype(np.uint64)
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    inside = np.arange(len(flat))
    number = (inside - np.maximum.accumulate(np.where(first, inside, 0))).astype(np.uint64)
    return of, _mixed(flat | number << np.uint64(8))


@lru_cache(8)
def _choices(parts: int) -> np.ndarray:
    return np.array([[g in kept for g in range(parts)] for kept in combinations(range(parts), parts - DISTANCE)])


def signatures(flat: np.ndarray, lengths: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """One row per word: its signature for every choice of ``parts`` - ``DISTANCE`` parts."""
    of, place = _places(flat, lengths)
    sums = np.zeros((len(lengths), parts), np.uint64)
    np.add.at(sums, (of, (_mixed(place) % np.uint64(parts)).astype(np.int64)), place)
    chosen = _choices(parts)
    return _mixed(sums @ chosen.T.astype(np.uint64) + np.arange(len(chosen), dtype=np.uint64)).view(np.int64)


def _signed(words: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            keys = signatures(*letters_of(batch.column(0)), parts)
            yield record(_SIGNED, {"word": batch.column(0), "n": batch.column(1), "keys": list(keys)})

    return map_arrow(words.select("word", "n"), run, "word string, n long, keys array<long>")


def folded(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of each word folded to 64 bits, a bit by the parity of its places.

    Two words that differ in ``DISTANCE`` places differ in as many bits at most.
    """
    of, place = _places(flat, lengths)
    bits = np.zeros(len(lengths), np.uint64)
    np.bitwise_xor.at(bits, of, np.uint64(1) << (place & np.uint64(63)))
    return bits


class Edits:
    """Tells whether two of the words, which differ, are one inserted, deleted or replaced letter apart.

    Words lie in rows of eight letters to a number, once from the front and once from the rear, filled
    up with zeros, which are no letter. Longer words than ``WIDE`` letters are compared one by one.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths, self.ends = flat, lengths, np.cumsum(lengths)
        inside = lengths <= WIDE
        self.width = int(-(-lengths[inside].max(initial=1) // 8))
        of = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(flat)) - (self.ends - lengths)[of]
        use = inside[of]
        of, at, flat = of[use], at[use], flat[use]
        self.sides = []
        for spot in (at, lengths[of] - 1 - at):
            rows = np.zeros((len(lengths), 8 * self.width), np.uint8)
            rows[of, spot] = flat
            self.sides.append(rows.view("<u8"))

    def _common(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(self.width):
            x = rows[a, k] ^ rows[b, k]
            low = x & (~x + np.uint64(1))  # the lowest differing bit
            same += np.where(open_, np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3), 0)
            open_ &= x == 0
        return same

    def _word(self, n: int) -> bytes:
        return self.flat[self.ends[n] - self.lengths[n] : self.ends[n]].tobytes()

    def _slow(self, a: int, b: int) -> bool:
        one, other = sorted((self._word(a), self._word(b)), key=len)
        front = len(os.path.commonprefix((one, other)))
        rear = len(os.path.commonprefix((one[::-1], other[::-1])))
        return front + rear >= len(other) - 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.maximum(self.lengths[a], self.lengths[b])
        front, rear = (np.minimum(self._common(rows, a, b), size) for rows in self.sides)
        found = front + rear >= size - 1
        for n in np.flatnonzero(size > WIDE).tolist():
            found[n] = self._slow(int(a[n]), int(b[n]))
        return found & (np.abs(self.lengths[a] - self.lengths[b]) <= 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of many whole cells at a time; rows come sorted by cell."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < GATHERED:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cells = table.column(0).to_numpy()
        ready = int(np.searchsorted(cells, cells[-1]))
        if ready:
            yield table.slice(0, ready)
            held, size = table.slice(ready).to_batches(), size - ready
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words of each cell; where it has rows of side 1, these meet those of side 0 only."""
    for table in _gathered(batches):
        cells, sides = (table.column(c).to_numpy() for c in ("cell", "side"))
        flat, lengths = letters_of(table.column("word"))
        edits = Edits(flat, lengths)
        order = np.lexsort((lengths, cells))
        number = np.cumsum(np.concatenate(([0], cells[1:] != cells[:-1])))
        sided = np.zeros(number[-1] + 1, bool)
        sided[number[sides > 0]] = True
        bits = folded(flat, lengths)[order]
        # A row meets the rows behind it in its cell, up to those one letter longer.
        spot = number[order] * np.int64(1 << 32) + lengths[order]
        end = np.searchsorted(spot, spot + 1, side="right")
        step, likely, size = 1, [], 0
        rows = np.flatnonzero(end > np.arange(len(end)) + 1)
        while len(rows):
            hit = rows[np.bitwise_count(bits[rows] ^ bits[rows + step]) <= DISTANCE]
            likely.append((order[hit], order[hit + step]))
            size += len(hit)
            step += 1
            rows = rows[end[rows] > rows + step]
            if size < PAIRS and len(rows):
                continue
            a, b = (np.concatenate(x) for x in zip(*likely, strict=True))
            meet = (sides[a] != sides[b]) | ~sided[number[a]]
            a, b = a[meet], b[meet]
            near = edits(a, b)
            if near.any():
                one, other = (table.select(["word", "n"]).take(pa.array(x[near])) for x in (a, b))
                yield from _ordered(one, other)
            likely, size = [], 0


def _ordered(one: pa.Table, other: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs with the smaller word first, so that a pair found twice is the same row."""
    turn = pc.greater(one["word"], other["word"])
    columns = []
    for first, second in ((one, other), (other, one)):
        columns += [pc.if_else(turn, second[c], first[c]) for c in ("word", "n")]
    yield from pa.Table.from_arrays(columns, schema=_PAIRS).to_batches()


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """All pairs of different words one edit apart: ``word``, ``n``, ``other``, ``other_n``, each pair once.

    ``words`` has unique ``word`` and ``n``. More ``parts`` make more signatures with fewer
    words each. Signatures of over ``AT_ONCE`` words are cut into parts, which meet pairwise in tasks of their own.
    """
    if parts <= DISTANCE:
        raise ValueError("there must be more parts than differing places")
    keyed = stage(_signed(words, parts), "signed").select("word", "n", F.explode("keys").alias("key"))
    hot = heavy_keys(keyed, "key", AT_ONCE)
    cells = keyed.select(F.col("key").alias("cell"), F.lit(0).alias("side"), "word", "n")
    if hot.limit(1).count():
        fan = F.coalesce(F.ceil(F.col("rows") / AT_ONCE), F.lit(1)).cast("long")
        part = F.pmod(F.xxhash64("word", "key"), F.col("fan"))
        met = keyed.join(hot, "key", "left").withColumn("fan", fan).withColumn("part", part)
        met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
        pair = F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))
        cell = F.when(F.col("fan") > 1, pair).otherwise(F.col("key"))
        cells = met.select(cell.alias("cell"), (F.col("with") < F.col("part")).cast("int").alias("side"), "word", "n")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return map_arrow(dealt, _verified, "word string, n long, other string, other_n long").distinct()


def _roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """``word`` and ``root``: the end of its chain of forms. A form is more frequent, so chains end and are short."""
    state = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        known = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        left = state.withColumnRenamed("root", "at")
        moved = stage(join_unique(left, known, ["at"], "left", "word"), "roots")
        state = moved.select("word", F.coalesce("next", "at").alias("root"))
        if not moved.filter("next is not null").limit(1).count():
            return state
    raise RuntimeError("chains of forms did not end")


def variants(docs: DataFrame, plant: bool = False, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, parts: int = PARTS) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are maximal runs of A to Z, a to z and U+00C0 to U+00FF with A to Z lower-cased, of ``least`` letters
    and ``count`` occurrences or more. ``n_near`` counts the words one inserted, deleted or
    replaced letter apart; the most frequent of them (ties: the smallest) is the form of a
    word if it comes ``times`` as often, else the form is null. ``root`` is where forms lead at last, the word itself without one.
    ``plant`` first takes a letter from the runs whose hash asks for it; a null doc_id is
    hashed as an empty one. Null and empty texts have no words, repeated rows
    count as often as they come, other columns are ignored, an empty table gives no rows. Texts
    are read run by run; what a task holds is its own count of ``COUNTED`` words at most.
    """
    words = stage(counted(docs, plant, least).filter(F.col("n") >= count), "words")
    pairs = stage(near_pairs(words, parts), "near")
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))

    def best(field: str) -> Column:
        return F.when(F.col("best.other_n") >= times * F.col("n"), F.col(f"best.{field}"))

    greatest = F.min(F.struct((-F.col("other_n")).alias("_less"), "other", "other_n")).alias("best")
    near = pairs.unionByName(turned).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), greatest)
    near = stage(near.select("word", "n_near", best("other").alias("form"), best("other_n").alias("form_n")), "forms")
    roots = _roots(near.filter("form is not null"))
    known = words.join(near, "word", "left").join(roots, "word", "left")
    return known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
