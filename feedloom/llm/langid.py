"""Language identification by a blended-spectrum string kernel, Nyström landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, record, text_groups
from feedloom.session import stage

# Lengths of the n-grams of the blended spectrum, in bytes of the lower-cased text.
ORDERS = (1, 2, 3)
OFFSETS = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
SPECTRUM = OFFSETS[3] + (1 << 24)

# Bounds of the labelled sample the model is fitted on: texts and landmarks per language, and
# languages (the most frequent). Nothing else of the model is bounded by a sample.
FIT_TEXTS = 300
LANDMARKS = 64
LANGUAGES = 200
RIDGE = 0.01

# A batch that is scored at once: text bytes and texts.
BATCH_BYTES = 500_000
BATCH_TEXTS = 128

UNKNOWN = "und"
# Texts whose predicted language scores less than this are rejected by the pipeline stage.
LEAST_SCORE = 0.2

_GRAMS = pa.schema([("lang", pa.string()), ("grams", pa.binary())])


def grams(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all n-grams of texts laid end to end and the text of each, order by order.

    No n-gram crosses the end of its text.
    """
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    code = data.astype(np.int32)
    yield code, text
    for order in ORDERS[1:]:
        if len(data) < order:
            return
        code = (code[:-1] << 8) | data[order - 1 :]
        inside = text[: len(code)] == text[order - 1 :]
        yield code[inside] + OFFSETS[order], text[: len(code)][inside]


def presence(data: np.ndarray) -> np.ndarray:
    """Sorted codes of the different n-grams of one text."""
    found = [np.unique(code) for code, _ in grams(data, np.array([len(data)]))]
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """n-grams of the landmarks and, for each language, the weight of each of them.

    The presence kernel k(x, l) = |x and l| / sqrt(|x| |l|) is linear in the presence of
    the landmarks' n-grams, so kernel values times ridge coefficients are one matrix:
    the landmarks' presence, scaled, times the coefficients.
    """

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]

    @staticmethod
    def fit(texts: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        languages = sorted({lang for lang, _ in texts})
        if not languages:
            return Model(np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0), [])
        chosen: list[np.ndarray] = []
        for lang in languages:
            chosen += [g for name, g in texts if name == lang][:landmarks]
        vocabulary = np.unique(np.concatenate(chosen)).astype(np.int32)
        rows = lambda sets: np.stack([np.isin(vocabulary, g, assume_unique=True) for g in sets]).astype(np.float32)
        marks = rows(chosen)
        marks /= np.sqrt(np.maximum(1, marks.sum(axis=1, keepdims=True)))
        seen = rows([g for _, g in texts])
        seen /= np.sqrt(np.maximum(1, seen.sum(axis=1, keepdims=True)))
        kernel = (seen @ marks.T).astype(np.float64)
        between = (marks @ marks.T).astype(np.float64)
        target = np.where(np.array([[lang == x for x in languages] for lang, _ in texts]), 1.0, -1.0)
        # Each language weighs the same however many of its texts were drawn.
        share = np.array([1.0 / sum(name == lang for name, _ in texts) for lang, _ in texts])
        share *= len(texts) / len(languages)
        bias = (target * share[:, None]).sum(axis=0) / share.sum()
        left = kernel.T @ (kernel * share[:, None]) + ridge * len(texts) * (between + 1e-6 * np.eye(len(between)))
        alpha = np.linalg.solve(left, kernel.T @ ((target - bias) * share[:, None]))
        return Model(vocabulary, (marks.T @ alpha).astype(np.float32), bias, languages)

    def table(self) -> np.ndarray:
        """Place of every possible n-gram in the vocabulary, or one past its end."""
        kind = np.uint16 if len(self.vocabulary) < 1 << 16 else np.int32
        places = np.full(SPECTRUM, len(self.vocabulary), kind)
        places[self.vocabulary] = np.arange(len(self.vocabulary), dtype=kind)
        return places

    def margins(self, data: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One margin per text and language; texts are laid end to end. A text may be of any length."""
        width = len(self.vocabulary) + 1
        present = np.zeros(len(ends) * width, bool)
        step = 4 * BATCH_BYTES
        for at in range(0, len(data), step):
            low, high = max(0, at - len(ORDERS) + 1), min(len(data), at + step)
            part = np.searchsorted(ends, low, side="right")
            inner = np.clip(ends[part:], low, high) - low
            for code, text in grams(data[low:high], inner):
                present[(text + part) * np.int64(width) + places[code]] = True
        present = present.reshape(len(ends), width)[:, :-1].astype(np.float32)
        norm = np.sqrt(np.maximum(1, present.sum(axis=1, keepdims=True)))
        return (present @ self.weights) / norm + self.bias


def held_out() -> F.Column:
    """Whether the checksum of the doc_id leaves 2 modulo 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, texts: int = FIT_TEXTS, landmarks: int = LANDMARKS, languages: int = LANGUAGES) -> Model:
    """Model of the labelled documents that are not held out.

    The ``texts`` documents of each language with the smallest hashes teach, for the ``languages`` most
    frequent languages, so the sample has at most ``texts`` x ``languages`` documents; one
    without doc_id, language or letters teaches nothing. First the languages are counted, then texts
    are drawn by their whole 64-bit hash at a rate that leaves about three times as many as needed, so no language is
    sorted as a whole at any size. N-grams are taken in the tasks; what is collected is bounded by the sample.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return Model.fit([])
    mark = F.xxhash64("text", "doc_id")
    odds = {r["lang"]: min(1.0, 3.0 * texts / r["count"]) for r in counts}
    rate = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])[F.col("lang")]
    drawn = usable.withColumn("_mark", mark).filter(F.col("lang").isin(list(odds)))
    drawn = drawn.filter((F.col("_mark") / F.lit(2.0**64) + F.lit(0.5) <= rate) & has_letter())
    drawn = stage(drawn.select("lang", "_mark", F.lower("text").alias("text")), "drawn")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_mark", "text"))
    some = drawn.withColumn("_nth", order).filter(F.col("_nth") <= texts).orderBy("lang", "_nth").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in text_groups(batches, 0):
            found = presence(data[: ends[0]]).astype("<i4").tobytes()
            yield record(_GRAMS, {"lang": rows.column(0), "grams": [found]})

    sample = map_arrow(some, run, "lang string, grams binary").collect()
    sample = sorted(((r["lang"], np.frombuffer(r["grams"], "<i4")) for r in sample), key=lambda x: (x[0], x[1].tobytes()))
    return Model.fit(sample, landmarks)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of every row, and the columns of ``keep``.

    The whole text is read. Texts that are null, empty or without a letter are ``und``
    with score 0, and so is everything if no language could be learned. Ties go to the
    language first in order. The score is half of one plus the margin, cut to 0 and 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.when(has_letter(), F.lower("text"))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *keep, lettered.alias("_text"))
    kept = [rows.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        places = _places(learned)
        for batch in batches:
            for rows, data, ends in text_groups(_cut(batch), BATCH_BYTES):
                known = np.array(rows.column(rows.num_columns - 1).is_valid())
                names, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if learned.languages and known.any():
                    margins = learned.margins(data, ends, places)
                    best = margins.argmax(axis=1)
                    names[known] = np.array(learned.languages, object)[best][known]
                    score[known] = np.clip((margins.max(axis=1) + 1) / 2, 0, 1)[known]
                columns = [rows.column(0), rows.column(1), *rows.columns[2:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", *keep, "lang_pred", "score"],
                )

    extra = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return map_arrow(rows, run, f"doc_id long, held_out boolean, {extra}lang_pred string, score double")


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_TEXTS):
        yield batch.slice(at, BATCH_TEXTS)


_PLACES: dict[bytes, np.ndarray] = {}


def _places(model: Model) -> np.ndarray:
    """The model's table, kept by the Python worker for its next tasks."""
    key = model.vocabulary.tobytes()
    if key not in _PLACES:
        _PLACES.clear()
        _PLACES[key] = model.table()
    return _PLACES[key]


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the documents' own labels and predicts all of them; see :func:`fit` and :func:`predict`."""
    return predict(docs, fit(docs))


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is known; columns stay as they are.

    Rejected are texts without a letter and those that look like none of the learned
    languages: a score below ``least``, where 0.5 is the border of a language. If nothing could be
    learned, every text with a letter stays.
    """
    model = fit(docs)
    if not model.languages:
        return docs.filter(has_letter())
    names = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*names).alias("_row"))
    found = predict(rows, model, keep=("_row",))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
