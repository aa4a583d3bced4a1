"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import laid, map_arrow, record, slices
from feedloom.llm.licence_texts import GNU_KINDS, GNU_NOTICE, NOTICES, PARAGRAPHS, SPDX_ONLY, WHOLE
from feedloom.session import stage

# A block carries a notice at this cosine; an SPDX line must hold the words of the identifier and no others.
LEAST_COSINE = 0.7
SPDX_COSINE = 0.999
# A file holds a licence's own text if the mean cosine of its best blocks to the licence's paragraphs, or its whole
# text's to a short licence, is this. It is a licence file, too, if notices hold this share of its words.
TEXT_COSINE = 0.7
WHOLE_COSINE = 0.8
FILE_SHARE = 0.2
# The notice that names no licence.
RESERVED = "Proprietary"
# Names of files that are for a whole directory.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"
# Words and blocks looked at together.
GROUP_WORDS = 400_000
GROUP_BLOCKS = 4096

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_TOKEN = re.compile(_WORD.pattern + "|\n")
_COUNTS = pa.schema([("word", pa.int32()), ("n", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("path", pa.string()), ("licence", pa.string()), ("cosine", pa.float64())]
    + [("licence_words", pa.int64()), ("n_words", pa.int64()), ("is_text", pa.bool_())]
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _templates() -> list[tuple[str, str, str]]:
    """Kind, licence and wording of every template."""
    listed = [("notice", name, text) for name, text in NOTICES]
    listed += [("notice", name, GNU_NOTICE.format(kind, version)) for name, kind, version in GNU_KINDS]
    for name in dict.fromkeys([*WHOLE, *PARAGRAPHS, *SPDX_ONLY]):
        forms = ("", "-only", "-or-later") if "GPL-" in name else ("",)
        listed += [("spdx", name, f"SPDX-License-Identifier: {name}{form}") for form in forms]
    listed += [("paragraph", name, text) for name, texts in PARAGRAPHS.items() for text in texts]
    return listed + [("whole", name, "\n".join(texts)) for name, texts in WHOLE.items()]


TEMPLATES = _templates()
VOCABULARY = tuple(sorted({w for _, _, t in TEMPLATES for w in words(t)}))
_CODE = {w: n for n, w in enumerate(VOCABULARY)}
_OTHER, _BREAK = -1, -2
_TOKEN_CODE = _CODE | {"\n": _BREAK}


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold each template word, over all documents, and how many there are.

    Words are counted in the tasks; a row per task and word is summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(VOCABULARY) + 1, np.int64)
        for batch in slices(batches, 500):
            for text in batch.column(0):
                here = _CODE.keys() & set(words(text.as_py() or ""))
                seen[[_CODE[w] for w in here]] += 1
                seen[-1] += 1
        at = np.flatnonzero(seen)
        yield record(_COUNTS, {"word": at.astype(np.int32), "n": seen[at]})

    rows = map_arrow(docs.select(F.col("text").cast("string")), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(VOCABULARY) + 1, np.int64)
    for row in rows.collect():
        counts[row["word"]] = row["n"]
    return counts[:-1], int(counts[-1])


class Matcher:
    """Cosine of texts to the templates. Words of no template count as the rarest there can be, each different."""

    def __init__(self, frequencies: np.ndarray, total: int):
        self.idf = np.log((1 + total) / (1 + frequencies)) + 1
        self.rare = float(np.log(1 + total) + 1)
        self.vectors = np.zeros((len(VOCABULARY), len(TEMPLATES)))
        for n, (_, _, text) in enumerate(TEMPLATES):
            for w in words(text):
                self.vectors[_CODE[w], n] += self.idf[_CODE[w]]
        self.vectors /= np.linalg.norm(self.vectors, axis=0)
        kinds = np.array([kind for kind, _, _ in TEMPLATES])
        self.least = np.select([kinds == "notice", kinds == "spdx"], [LEAST_COSINE, SPDX_COSINE], 2.0)
        self.noticed, self.paragraphs, self.whole = (np.flatnonzero(k) for k in (self.least < 2, kinds == "paragraph", kinds == "whole"))
        # Mean over the paragraphs of each long licence.
        self.long = tuple(PARAGRAPHS)
        owner = np.array([self.long.index(TEMPLATES[n][1]) for n in self.paragraphs])
        self.mean = (owner[:, None] == np.arange(len(self.long))) / np.bincount(owner)

    def cosines(self, block: np.ndarray, code: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of blocks and their cosines to all templates, in groups; ``code`` is a word of ``block``.

        A block's cosine is at most the share that template words have of its length, so
        blocks are left out whose share is under every threshold.
        """
        known = code >= 0
        key, count = np.unique(block[known] * len(VOCABULARY) + code[known], return_counts=True)
        at, word = np.divmod(key, len(VOCABULARY))
        weight = count * self.idf[word]
        inside = np.bincount(at, weight**2, minlength=n)
        norm = inside + np.bincount(block[~known], minlength=n) * self.rare**2
        left = np.flatnonzero((inside > 0) & (inside >= (min(LEAST_COSINE, WHOLE_COSINE) - 1e-9) ** 2 * norm))
        ends = np.searchsorted(at, left, side="right")
        starts = np.searchsorted(at, left)
        for low in range(0, len(left), GROUP_BLOCKS):
            some = left[low : low + GROUP_BLOCKS]
            start, length = starts[low : low + GROUP_BLOCKS], (ends - starts)[low : low + GROUP_BLOCKS]
            dense = np.zeros((len(some), len(VOCABULARY)))
            row = np.repeat(np.arange(len(some)), length)
            dense[row, laid(word, start, length)] = laid(weight, start, length)
            yield some, np.round(dense @ self.vectors / np.sqrt(norm[some])[:, None], 9)

    def judge(self, texts: list[np.ndarray]) -> list[tuple[str | None, float, int, int, bool]]:
        """For each text of word codes: licence, cosine, words in notices, all words, whether it is the licence's own text."""
        line_ends = np.array([np.count_nonzero(t == _BREAK) + 1 for t in texts], np.int64)
        codes = np.concatenate([part for t in texts for part in (t, [_BREAK])]).astype(np.int64)
        ended = codes == _BREAK
        line = (np.cumsum(ended) - ended)[~ended]
        code = codes[~ended]
        n_lines = int(line_ends.sum())
        doc = np.repeat(np.arange(len(texts)), line_ends)
        size = np.bincount(line, minlength=n_lines)
        first = np.zeros(n_lines, bool)
        first[np.cumsum(line_ends) - line_ends] = True
        # A line without words, such as one that only marks a comment, ends a paragraph.
        paragraph = np.cumsum(first | (size == 0)) - 1
        several = np.bincount(paragraph[size > 0], minlength=paragraph[-1] + 1) > 1
        shared = several[paragraph[line]]
        whole_from = n_lines + len(several)
        block = np.concatenate((line, n_lines + paragraph[line][shared], whole_from + doc[line]))
        paragraph_doc = doc[np.flatnonzero(first | (size == 0))]
        block_doc = np.concatenate((doc, paragraph_doc, np.arange(len(texts))))

        notices = np.zeros((len(texts), len(TEMPLATES)))
        hit = np.zeros(whole_from, bool)
        best = np.zeros((len(texts), len(TEMPLATES)))
        for some, cosine in self.cosines(block, np.concatenate((code, code[shared], code)), whole_from + len(texts)):
            whole = some >= whole_from
            np.maximum.at(best, some[whole] - whole_from, np.where(np.isin(np.arange(len(TEMPLATES)), self.whole), cosine[whole], 0.0))
            part, cosine = some[~whole], cosine[~whole]
            over = cosine >= self.least
            hit[part[over.any(axis=1)]] = True
            top = np.argmax(np.where(over, cosine, 0.0), axis=1)
            kept = over.any(axis=1)
            np.maximum.at(notices, (block_doc[part[kept]], top[kept]), cosine[np.arange(len(part)), top][kept])
            near = np.flatnonzero((cosine[:, self.paragraphs] >= LEAST_COSINE).any(axis=1))
            np.maximum.at(best, (block_doc[part[near]][:, None], self.paragraphs), np.where(cosine >= LEAST_COSINE, cosine, 0.0)[near][:, self.paragraphs])
        return self._verdicts(notices, best, np.bincount(doc, size * (hit[:n_lines] | hit[n_lines + paragraph])), np.bincount(doc, size))

    def _verdicts(self, notices: np.ndarray, best: np.ndarray, held: np.ndarray, sizes: np.ndarray) -> list[tuple[str | None, float, int, int, bool]]:
        """A licence's own text goes before notices, and notices of a named licence before reserved rights."""
        long = np.round(best[:, self.paragraphs] @ self.mean, 9)
        found = []
        for n in range(len(notices)):
            own = [(-c, at, name) for at, (c, name) in enumerate(zip(long[n], self.long, strict=True)) if c >= TEXT_COSINE]
            own += [(-best[n, t], t, TEMPLATES[t][1]) for t in self.whole if best[n, t] >= WHOLE_COSINE]
            noted = [(TEMPLATES[t][1] == RESERVED, -notices[n, t], t) for t in np.flatnonzero(notices[n])]
            if own:
                cosine, _, name = min(own)
            else:
                _, cosine, t = min(noted, default=(False, 0.0, None))
                name = None if t is None else TEMPLATES[t][1]
            found.append((name, round(abs(float(cosine)), 6), int(held[n]), int(sizes[n]), bool(own)))
        return found


def coded(text: str | None) -> np.ndarray:
    """Codes of the words and line ends of a text."""
    return np.array([_TOKEN_CODE.get(w, _OTHER) for w in _TOKEN.findall((text or "").lower())], np.int32)


def scan(docs: DataFrame, path: Column, matcher: Matcher) -> DataFrame:
    """Per document: ``path``, ``dir``, best ``licence`` and ``cosine``, words in notices, all words, ``is_licence_file``.

    Every line and paragraph of the whole text is compared with notices and SPDX
    identifiers, so a header is found wherever it stands; paragraphs with those of
    long licences and the whole text with short ones, so that licence files are told by their own text.
    Of several licences the one whose text it is goes first, then the nearest notice, reserved rights last; ties go to
    the template that comes first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found, texts = [], []
            for value in batch.column(2):
                texts.append(coded(value.as_py()))
                if sum(map(len, texts)) > GROUP_WORDS:
                    found += sent.value.judge(texts)
                    texts = []
            found += sent.value.judge(texts) if texts else []
            judged = dict(zip(_FOUND.names[2:], zip(*found, strict=True), strict=True)) if found else dict.fromkeys(_FOUND.names[2:], ())
            yield record(_FOUND, {"doc_id": batch.column(0), "path": batch.column(1), **judged})

    rows = docs.select(F.col("doc_id").cast("long"), path.alias("path"), F.col("text").cast("string"))
    schema = "doc_id long, path string, licence string, cosine double, licence_words long, n_words long, is_text boolean"
    whole = F.col("is_text") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (F.col("licence_words") >= FILE_SHARE * F.col("n_words"))
    up = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return map_arrow(rows, run, schema).withColumns({"dir": up, "is_licence_file": F.col("licence").isNotNull() & whole}).drop("is_text")


def path_of(source: Column, lang: Column, doc_id: Column) -> Column:
    """Path that the table's columns give a document: source, language and one of 64 folders, then the file.

    One file in 16 lies in its source's folder and two in that of the language, as files
    for a whole tree do.
    """
    name = F.coalesce(doc_id.cast("string"), F.lit("none"))
    mark = F.crc32(name.cast("binary"))
    part = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), "/", "_"), F.lit("none"))
    level = F.pmod(mark, F.lit(16))
    language = F.when(level > 0, part(lang))
    return F.concat_ws("/", part(source), language, F.when(level > 2, (F.floor(mark / 16) % 64).cast("string")), name)


def inherited(files: DataFrame) -> DataFrame:
    """The nearest licence for every directory: ``dir``, ``origin``, ``inherited``.

    ``files`` has ``dir``, ``path``, ``licence`` and ``is_file``. A directory's licence is
    that of its licence file, by the first path if there are several; a directory without
    one takes that of the nearest directory above that has one. Directories are made
    different before they are joined by path prefixes, so their number counts, not
    that of files; nothing is broadcast.
    """
    first = F.min(F.struct("path", "licence"))
    owners = files.filter("is_file").groupBy("dir").agg(first.alias("f")).select(F.col("dir").alias("origin"), F.col("f.licence").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    dirs = files.select("dir").distinct().withColumn("origin", F.explode(above))
    depth = F.when(F.col("origin") == "", 0).otherwise(F.size(F.split("origin", "/")))
    near = F.max(F.struct(depth.alias("depth"), "origin", "inherited")).alias("near")
    return dirs.join(owners, "origin").groupBy("dir").agg(near).select("dir", "near.origin", "near.inherited")


def licences(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """Licence of every document: its own, or that of the nearest licence file in or above its directory.

    Returns doc_id, path, licence (its own, else null), cosine, licence_words, n_words,
    is_licence_file, origin (the directory it inherits from), effective (its own, else the
    inherited one, else null). ``path`` gives a document's path; the default is derived
    from source, language and doc_id. A licence file has a licence's own text, the name of one
    (``FILE_NAME``) and a notice, or notices in ``FILE_SHARE`` of its words. An SPDX line names one licence; expressions
    of several are not taken apart. Inverse document frequencies are counted over all
    documents. Null and empty texts have no licence of their own but inherit. Repeated
    rows are files of their own; other columns are ignored; an empty table gives no rows.
    """
    where = path if path is not None else path_of(F.col("source"), F.col("lang"), F.col("doc_id"))
    matcher = Matcher(*document_frequencies(docs))
    own = stage(scan(docs, where, matcher), "licences")
    dirs = inherited(own.select("dir", "path", "licence", F.col("is_licence_file").alias("is_file")))
    return own.join(dirs, "dir", "left").select(
        "doc_id",
        "path",
        "licence",
        "cosine",
        "licence_words",
        "n_words",
        "is_licence_file",
        F.when(F.col("licence").isNull(), F.col("origin")).alias("origin"),
        F.coalesce("licence", "inherited").alias("effective"),
    )
