"""Order-preserving packing of token streams into fixed windows by dynamic programming."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import laid, map_arrow, record, text_groups

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
# Tokens planned together. A plan never looks beyond its chunk, so memory does not grow with the input.
CHUNK_TOKENS = 500_000
# Costs in tokens of padding: a cut after a sentence, a cut inside one, and every sequence.
SENTENCE_CUT = 8
INNER_CUT = 64
PER_SEQUENCE = 32
# Unpadded lengths under this one are tried in the last window of a stream only.
SHORT = 512
# Distance of the cuts allowed inside a stretch that has no boundary.
INNER_STEP = 64
# Encoded words kept by a Python worker, and the longest word kept, in bytes.
CACHED_WORDS = 400_000
CACHED_BYTES = 48
# Text bytes encoded at a time.
ENCODED_BYTES = 1_000_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True


def tokenizer_path() -> str:
    """Place of the public vocabulary on the machine that asks; it is not part of the library."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Token ids of texts by the tokenizer file, with every different word encoded once.

    The tokenizer drops white space, so words between spaces, tabs and line ends never
    share a token. Words are told apart by a 64-bit hash that also holds their length;
    those over ``CACHED_BYTES`` are encoded wherever they stand.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        stops = [i for t, i in vocabulary.items() if len(t) > 4 and t.endswith("</w>") and set(t[:-4]) <= set(".!?")]
        self.enders = np.array(sorted(stops), np.uint32)
        self.weights = np.random.default_rng(1).integers(1, 1 << 63, CACHED_BYTES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Letters go through the tokenizer in long lines."""
        units: dict[str, int] = {"": 0}
        parts = np.zeros((len(words), 2), np.int64)
        for n, word in enumerate(words):
            core = word.rstrip(".,!?;:")
            if core.isalpha():
                parts[n] = units.setdefault(core, len(units)), units.setdefault(word[len(core) :], len(units))
            else:
                parts[n, 0] = units.setdefault(word, len(units))
        listed = list(units)
        letters = np.array([u.isalpha() for u in listed])
        flat, length = [], np.zeros(len(listed), np.int64)
        chosen = np.flatnonzero(letters)
        for at in range(0, len(chosen), 5000):
            some = [listed[k] for k in chosen[at : at + 5000].tolist()]
            ids = self._ids([" ".join(some)])[0]
            stops = np.flatnonzero(self.word_end[ids]) + 1
            sizes = np.diff(stops, prepend=0)
            if len(sizes) != len(some):  # some letter is none to the tokenizer
                alone = self._ids(some)
                ids, sizes = np.concatenate(alone), [len(x) for x in alone]
            flat.append(ids)
            length[chosen[at : at + 5000]] = sizes
        others = np.flatnonzero(~letters)
        alone = self._ids([listed[k] for k in others.tolist()])
        length[others] = [len(x) for x in alone]
        order = np.concatenate((chosen, others))
        at = np.zeros(len(listed), np.int64)
        at[order] = np.cumsum(length[order]) - length[order]
        ids = laid(np.concatenate((*flat, *alone)), at[parts.ravel()], length[parts.ravel()])
        return ids, length[parts].sum(axis=1)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end in ``data``, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        inside = ~((data == 32) | (data == 10) | (data == 9) | (data == 13))
        fresh = np.zeros(len(data) + 1, bool)
        fresh[0] = True
        fresh[ends] = True
        # A stop after a letter or digit is a token's border anyway, so it is a word of its own.
        border = np.zeros(len(data), bool)
        border[1:] = _STOP[data[1:]] & _ALNUM[data[:-1]]
        first = inside.copy()
        first[1:] &= fresh[1:-1] | ~inside[:-1] | border[1:]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        last = inside.copy()
        last[:-1] &= fresh[1:-1] | ~inside[1:] | border[1:]
        stops = np.flatnonzero(last) + 1
        sizes = stops - starts
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        place = np.arange(starts[0], len(data)) - starts[owner]
        mixed = self.weights[np.minimum(place, CACHED_BYTES - 1)] * (data[starts[0] :].astype(np.uint64) + np.uint64(1))
        mixed[~inside[starts[0] :]] = 0
        keys = np.add.reduceat(mixed, starts - starts[0])
        long = sizes > CACHED_BYTES
        unique, spot, which = np.unique(keys[~long], return_index=True, return_inverse=True)
        self._know(data, unique, starts[~long][spot], stops[~long][spot])
        slot = np.searchsorted(self.known, unique)[which]
        at, length, flat = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.flat
        at[~long], length[~long] = self.at[slot], self.length[slot]
        if long.any():
            alone = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(starts[long], stops[long], strict=True)]
            coded = self._ids(alone)
            length[long] = [len(x) for x in coded]
            at[long] = len(flat) + np.cumsum(length[long]) - length[long]
            flat = np.concatenate((flat, *coded))
        before = np.concatenate(([0], np.cumsum(length)))
        return laid(flat, at, length), np.diff(before[np.searchsorted(starts, ends)], prepend=0)

    def _know(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        if len(self.known) > CACHED_WORDS:
            self.forget()
        here = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inner = here < len(self.known)
        new[inner] = self.known[here[inner]] != keys[inner]
        if not new.any():
            return
        raw, spans = data.tobytes(), zip(starts[new].tolist(), stops[new].tolist(), strict=True)
        words = [raw[a:b].decode("utf-8", "replace") for a, b in spans]
        ids, length = self._learn(words)
        at = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate((self.flat, ids))
        self.known = np.insert(self.known, here[new], keys[new])
        self.at, self.length = np.insert(self.at, here[new], at), np.insert(self.length, here[new], length)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def boundaries(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, the last included, and the penalty of each.

    Ends of documents cost nothing, ends of sentences ``SENTENCE_CUT``. A stretch longer
    than a quarter of a window gets further places inside, at ``INNER_CUT`` each.
    """
    after = np.flatnonzero(np.isin(ids, enders)) + 1
    places = np.union1d(after, ends)
    lefts = np.concatenate(([0], places[:-1]))
    gaps = np.flatnonzero(places - lefts > window // 4)
    inner = [np.arange(lefts[g] + INNER_STEP, places[g], INNER_STEP) for g in gaps]
    cost = np.full(len(places), SENTENCE_CUT)
    cost[np.isin(places, ends)] = 0
    if inner:
        inner = np.concatenate(inner)
        order = np.argsort(np.concatenate((places, inner)), kind="stable")
        cost = np.concatenate((cost, np.full(len(inner), INNER_CUT)))[order]
        places = np.concatenate((places, inner))[order]
    return places, cost


def cut(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cuts with the least padding and penalties, as positions; the last place is always one.

    best(j) = penalty(j) + PER_SEQUENCE + min over i within a window of best(i) + padding(j - i).
    Padding is the window less the length, so the minimum is the head of a monotone queue of
    best(i) + place(i). Lengths that are powers of two need no padding; the few places at
    such a distance are looked up beside the queue.
    """
    n = len(places)
    at = np.concatenate(([0], places))
    exact: dict[int, list[int]] = {}
    size = 1
    while size < window:
        # Short lengths pay only where a stream ends; elsewhere a window is filled instead.
        low = 0 if size >= SHORT else int(np.searchsorted(at, at[-1] - window))
        some = at[low:]
        i = np.searchsorted(at, some - size)
        hit = np.flatnonzero((some >= size) & (at[i] == some - size))
        for j, k in zip((hit + low).tolist(), i[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(k)
        size *= 2
    at, fee = at.tolist(), [0, *(penalty + PER_SEQUENCE).tolist()]
    best, came = [0] * (n + 1), [0] * (n + 1)
    queue, worth, head = [0] * (n + 1), [0] * (n + 1), 0
    tail = 0
    for j in range(1, n + 1):
        i, v = j - 1, best[j - 1] + at[j - 1]
        while tail > head and worth[tail - 1] >= v:
            tail -= 1
        queue[tail], worth[tail] = i, v
        tail += 1
        here = at[j]
        while here - at[queue[head]] > window:
            head += 1
        low, low_from = worth[head] + window - here, queue[head]
        for k in exact.get(j, ()):
            if best[k] < low:
                low, low_from = best[k], k
        best[j], came[j] = low + fee[j], low_from
    cuts, j = [], n
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def _plan(names: pa.Array, ids: np.ndarray, sizes: np.ndarray, enders: np.ndarray, first: int, window: int):
    """Pieces of one chunk of documents with sequence numbers from ``first``, and how many it used."""
    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
    starts = ends - sizes
    cuts = np.array(cut(*boundaries(ids, ends, enders, window), window), np.int64)
    edges = np.union1d(np.concatenate(([0], cuts)), ends)
    left, right = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, left, side="right")
    sequence = np.searchsorted(cuts, left, side="right")
    opened = np.concatenate(([0], cuts))[sequence]
    return {
        "doc_id": names.take(pa.array(doc)),
        "start": left - starts[doc],
        "length": right - left,
        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)],
        "doc_tokens": sizes[doc],
        "sequence_id": first + sequence,
        "offset": left - opened,
    }, len(cuts)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """All documents cut into pieces and laid into sequences of at most ``window`` tokens.

    Documents keep the order in which their partition holds them, so nothing is shuffled:
    each task plans chunks of about ``chunk`` tokens one after the other. Every row is one
    document, repeated ones too; a null text is empty and still holds its end token. A
    null doc_id stays null. Texts of any length are packed whole. ``sequence_id`` is unique
    over the table and rises in order within a task; an empty table gives no pieces.
    ``path`` is the vocabulary file on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, following = encoder(path), TaskContext.get().partitionId() << 40
        names, held, sizes, tokens = [], [], [], 0
        for rows, data, ends in _and_last(text_groups(batches, ENCODED_BYTES)):
            if rows is not None:
                ids, counts = coder.encode(data, ends)
                names.append(rows.column(0))
                held.append(np.insert(ids, np.cumsum(counts), END_ID))
                sizes.append(counts + 1)
                tokens += len(held[-1])
            if names and (rows is None or tokens >= chunk):
                some = pa.concat_arrays(names), np.concatenate(held), np.concatenate(sizes)
                pieces, used = _plan(*some, coder.enders, following, window)
                yield record(_PIECES, pieces)
                names, held, sizes, tokens, following = [], [], [], 0, following + used

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def _and_last(groups):
    yield from groups
    yield None, None, None
