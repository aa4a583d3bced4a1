"""The licence scan against a plain version, on whole licences and on headers."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm import licenses
from feedloom.llm.licence_texts import PARAGRAPHS, WHOLE

FOLDER = "/root/testdata/sf0.001"
SYSTEM = "/usr/share/common-licenses"
SYSTEM_NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
FILLER = "the parts of a long file that say nothing at all about who may use it and how\n"


def wrapped(text, mark="", width=9):
    listed = text.split()
    return "\n".join(mark + " ".join(listed[n : n + width]) for n in range(0, len(listed), width))


def plain(texts):
    """Licence, cosine, words in notices, all words, own text; one block at a time."""
    total = len(texts)
    seen = Counter(w for t in texts for w in set(licenses.words(t or "")))
    idf = {w: math.log((1 + total) / (1 + seen[w])) + 1 for w in licenses.VOCABULARY}
    rare = math.log(1 + total) + 1
    templates = [(kind, name, Counter(licenses.words(t))) for kind, name, t in licenses.TEMPLATES]

    def cosine(block, template):
        dot = sum(n * template.get(w, 0) * idf[w] ** 2 for w, n in block.items() if w in idf)
        own = sum((n * idf[w]) ** 2 if w in idf else n * rare**2 for w, n in block.items())
        return round(dot / math.sqrt(own * sum((n * idf[w]) ** 2 for w, n in template.items())), 9) if own else 0.0

    results = []
    for text in texts:
        listed = [licenses.words(line) for line in (text or "").split("\n")]
        paragraphs, at = [[]], 0
        for n, line in enumerate(listed):
            if line:
                paragraphs[-1].append(n)
            else:
                paragraphs.append([])
        blocks = [[n] for n, line in enumerate(listed) if line] + [p for p in paragraphs if len(p) > 1]
        notices, held, best = [], set(), Counter()
        for block in blocks:
            counts = Counter(w for n in block for w in listed[n])
            found = []
            for at, (kind, name, template) in enumerate(templates):
                c = cosine(counts, template) if kind != "whole" else 0.0
                if kind == "paragraph" and c >= licenses.LEAST_COSINE:
                    best[at] = max(best[at], c)
                if c >= {"notice": licenses.LEAST_COSINE, "spdx": licenses.SPDX_COSINE}.get(kind, 2):
                    found.append((-c, at))
            if found:
                held.update(block)
                c, at = min(found)
                notices.append((templates[at][1] == "Proprietary", c, at))
        own = []
        for order, name in enumerate(PARAGRAPHS):
            mine = [best[at] for at, t in enumerate(templates) if t[:2] == ("paragraph", name)]
            own.append((-round(sum(mine) / len(mine), 9), order, name))
        own = [o for o in own if -o[0] >= licenses.TEXT_COSINE]
        for at, (kind, name, template) in enumerate(templates):
            if kind == "whole":
                c = cosine(Counter(w for line in listed for w in line), template)
                own += [(-c, at, name)] if c >= licenses.WHOLE_COSINE else []
        words = [len(line) for line in listed]
        if own:
            name, c = min(own)[2], -min(own)[0]
        else:
            _, c, at = min(notices, default=(False, 0.0, None))
            name, c = None if at is None else templates[at][1], abs(c)
        results.append((name, round(c, 6), sum(words[n] for n in held), sum(words), bool(own)))
    return results


def samples():
    own = ["\n\n".join(texts) for texts in [*WHOLE.values(), *PARAGRAPHS.values()]]
    commented = ["# a file\n" + wrapped("\n".join(texts), "# ") + "\n\n" + FILLER * 3 for texts in WHOLE.values()]
    headers = [wrapped(text, " * ") + "\n" + FILLER * 5 for _, _, text in licenses.TEMPLATES]
    odd = [None, "", "\n\n", "...", "All rights reserved.\nReleased under the MIT License.", "SPDX-License-Identifier: Unknown-7", FILLER * 200]
    return own + commented + headers + odd


def test_judgements_equal_the_plain_version(spark):
    texts = samples() + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licences(df, F.concat(F.lit("d/"), F.col("doc_id"))).collect()}
    expected = plain(texts)
    assert len(got) == len(texts)
    for n, (name, cosine, held, size, own) in enumerate(expected):
        row = got[n]
        assert (row["licence"], row["licence_words"], row["n_words"]) == (name, held, size), texts[n]
        assert row["cosine"] == pytest.approx(cosine, abs=2e-6)
        assert row["is_licence_file"] == (name is not None and (own or held >= licenses.FILE_SHARE * size))


def test_batches_and_groups_do_not_change_judgements(spark, monkeypatch):
    texts = [licenses.coded(t) for t in samples()]
    matcher = licenses.Matcher(licenses.np.zeros(len(licenses.VOCABULARY), int), 5)
    once = matcher.judge(texts)
    assert once == [matcher.judge([t])[0] for t in texts]
    monkeypatch.setattr(licenses, "GROUP_BLOCKS", 3)
    assert matcher.judge(texts) == once


def test_texts_of_licences_are_told_apart(spark):
    rows = [(f"{name}/any.txt", "\n\n".join(texts), name) for name, texts in [*WHOLE.items(), *PARAGRAPHS.items()]]
    rows += [(f"c-{name}/any.txt", wrapped("\n".join(texts), "// "), name) for name, texts in WHOLE.items()]
    if os.path.isdir(SYSTEM):
        rows += [(f"s-{f}/{f}", open(f"{SYSTEM}/{f}").read(), name) for f, name in SYSTEM_NAMES.items() if os.path.exists(f"{SYSTEM}/{f}")]
    below = [(re.sub("/[^/]*$", "/src/code.c", path), FILLER, name) for path, _, name in rows]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows + below)], "doc_id long, path string, text string, expected string")
    found = {r["doc_id"]: r for r in licenses.licences(df, F.col("path")).collect()}
    for n, (_, _, name) in enumerate(rows + below):
        assert found[n]["effective"] == name
        assert found[n]["is_licence_file"] == (n < len(rows))


def test_named_files_and_identifiers(spark):
    header = "/* SPDX-License-Identifier: LGPL-2.1-or-later */\n" + FILLER * 4
    rows = [
        (1, "a/LICENSE.md", "Read on.\n" + FILLER * 9 + "Licensed under the MIT License."),
        (2, "a/b/c.py", FILLER),
        (3, "a/b/d.py", header),
        (4, "a/e/mylicense", "Read on.\n" + FILLER * 9 + "Licensed under CC BY 4.0."),
        (5, "a/e/f", FILLER),
        (6, "a/g/COPYING", FILLER),
        (7, None, header),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in licenses.licences(df, F.col("path")).collect()}
    effective = {1: "MIT", 2: "MIT", 3: "LGPL-2.1", 4: "CC-BY-4.0", 5: "MIT", 6: "MIT", 7: "LGPL-2.1"}
    assert {i: r["effective"] for i, r in found.items()} == effective
    assert [i for i, r in sorted(found.items()) if r["is_licence_file"]] == [1]
