"""Near-duplicate vectors, periodic runs and spelling variants against plain versions, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import crosspolytope, queries, runs, spelling

FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    """A table of documents with extra columns whose names the operators use inside."""
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "word", "runs", "key", "root", "form", "side", "cell"):
        table = table.withColumn(name, F.lit("x"))
    return table


# --- vectors ---------------------------------------------------------------------


def plain_vectors(rows, cosine=0.93):
    valid = []
    for n, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid.append((n, label, np.array(v) / np.abs(v).max()))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, (a, label, v) in enumerate(valid):
        for b, other, w in valid[i + 1 :]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for n, (vec_id, _, _) in enumerate(rows):
        group = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        low = min(group, default=None)
        out.append((vec_id, links[n], low, vec_id == low))
    return Counter(out)


def around(random, center, cosine):
    side = random.normal(size=len(center))
    side -= side @ center * center
    return (cosine * center + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)).tolist()


def vectors(spark, rows, kind="double"):
    table = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    for name in ("mark", "node", "n", "low", "key", "slot", "cell"):
        table = table.withColumn(name, F.lit("x"))
    return table


def test_vectors_against_all_pairs(spark):
    random = np.random.default_rng(5)
    rows = []
    for group in range(12):
        center = random.normal(size=48)
        center /= np.linalg.norm(center)
        for cosine in (1.0, 0.995, 0.97, 0.96, 0.94, 0.9, 0.5):
            rows.append((1000 - len(rows), group % 3, around(random, center, cosine)))
    rows += [(2000, 0, rows[0][2]), (2000, 0, rows[0][2]), (2001, 0, [3 * x for x in rows[0][2]]), (2002, 1, rows[0][2])]
    got = Counter(tuple(r) for r in crosspolytope.components(vectors(spark, rows)).collect())
    assert got == plain_vectors(rows)


def test_odd_vectors(spark):
    unit, inf, nan = [1.0, 0.0], float("inf"), float("nan")
    rows = [
        (1, 0, unit), (2, 0, [2.0, 0.1]), (3, 0, None), (4, 0, []), (5, 0, [0.0, -0.0]), (6, 0, [1.0, None]), (7, 0, [1.0, nan]),
        (8, 0, [1.0, inf]), (9, None, unit), (10, 0, [1.0, 0.0, 0.0]), (11, 0, [1e300, 1e299]), (12, 0, [1e-300, 0.0]),
        (None, 0, unit), (None, 1, unit), (13, 2, [5.0]), (14, 2, [7.0]), (15, 2, [-7.0]),
    ]
    got = Counter(tuple(r) for r in crosspolytope.components(vectors(spark, rows)).collect())
    assert got == plain_vectors(rows)
    assert crosspolytope.components(vectors(spark, rows).filter("false")).count() == 0


def test_large_buckets_lose_nothing(spark, monkeypatch):
    random = np.random.default_rng(8)
    center = random.normal(size=32)
    center /= np.linalg.norm(center)
    rows = [(n, 0, around(random, center, 0.975)) for n in range(150)] + [(n, 0, rows) for n, rows in enumerate([center.tolist()] * 60, 500)]
    want = plain_vectors(rows)
    monkeypatch.setattr(crosspolytope, "AT_ONCE", 20)
    got = Counter(tuple(r) for r in crosspolytope.components(vectors(spark, rows)).collect())
    assert got == want


def test_recall_at_the_threshold():
    random = np.random.default_rng(9)
    one = random.normal(size=(3000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = np.array([around(random, v, 0.93) for v in one])
    tables = crosspolytope.tables_needed(64, 0.93, 3, 4, 5e-4)
    met = np.zeros(len(one), bool)
    for t in range(tables):
        a, b = (crosspolytope.table_codes(x, t, 3, 4) for x in (one, other))
        met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.mean() > 0.995 and tables < 12


def test_bad_parameters(spark):
    table = vectors(spark, [(1, 0, [1.0])])
    for wrong in ({"probes": 0}, {"probes": 8}, {"cosine": 0}):
        with pytest.raises(ValueError):
            crosspolytope.components(table, **wrong)


# --- runs ------------------------------------------------------------------------


def plain_runs(words):
    found, seen = [], set()
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i + q - start
                if length >= max(24, 3 * q) and (start, length) not in seen:
                    seen.add((start, length))
                    found.append((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    random = np.random.default_rng(3)

    def some():
        kind, n = random.integers(0, 5), int(random.integers(0, 300))
        if kind < 2:
            return random.integers(0, 2 + 3 * kind, n)
        if kind == 2:
            return np.tile(random.integers(0, 3, int(random.integers(1, 60))), 20)[:n]
        if kind == 3:  # runs inside runs
            inner = np.tile(random.integers(0, 2, int(random.integers(1, 6))), int(random.integers(2, 9)))
            whole = np.concatenate((inner, random.integers(0, 3, int(random.integers(0, 5)))))
            return np.concatenate((random.integers(0, 2, 5), np.tile(whole, int(random.integers(2, 7)))))
        x, y = [0], [0, 1]
        while len(y) < n:  # Fibonacci words are full of runs
            x, y = y, y + x
        return np.array(y * 3)[:400]

    for _ in range(150):
        texts = [some() for _ in range(int(random.integers(1, 7)))]
        ends = np.cumsum([len(t) for t in texts])
        want = [[s + e - len(t), s + e - len(t) + n, q] for t, e in zip(texts, ends, strict=True) for s, n, q in plain_runs(t.tolist())]
        assert runs.find_runs(np.concatenate(texts).astype(np.int32), ends).tolist() == want


def test_run_digest_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, FOLDER).collect()]
    want = [plain_digest(*r) for r in rows]
    assert Counter(got) == Counter(want) and sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_texts(spark):
    line = "one two three four five six seven eight nine ten\x0beleven "
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, line * 5), (4, line * 5), (None, "a " * 30), (5, "x" * 100_000), (6, "b " * 23), (7, "É é " * 40)]
    got = Counter(tuple(r) for r in runs.report(documents(spark, rows)).collect())
    assert got == Counter(plain_digest(*r) for r in rows)
    whole = {r["doc_id"]: r for r in runs.periodic_runs(documents(spark, rows)).collect()}
    assert whole[4]["collapsed"] == " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
    assert whole[None]["collapsed"] == "a" and whole[1]["n_words"] == 0
    assert runs.report(documents(spark, rows).filter("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(documents(spark, rows), times=2)


def test_run_over_a_long_text(spark):
    random = np.random.default_rng(1)
    base = [f"w{n}" for n in random.integers(0, 5000, 70_000)]
    text = " ".join(["start", *base * 3, "end"])  # 1.2 MB, cut into words in two stretches
    row = runs.periodic_runs(documents(spark, [(1, text)])).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 210_000, 70_000)]
    assert row["collapsed"] == " ".join(["start", *base, "end"])


# --- words -----------------------------------------------------------------------


def plain_variants(rows, least=7, count=2, times=10):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                seen[run] += 1
    seen = {w: n for w, n in seen.items() if n >= count}
    near = {w: set() for w in seen}
    holes = {}
    for w in seen:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
            if (short := w[:k] + w[k + 1 :]) in seen:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, some in near.items():
        if some and seen[best := min(some, key=lambda v: (-seen[v], v))] >= times * seen[w]:
            form[w] = best

    def end(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), seen[form[w]] if w in form else None, end(w)) for w, n in seen.items()}


def as_rows(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_variants_of_the_given_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = plain_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    df = queries.op13_spelling_variants(spark, FOLDER)
    got = as_rows(df)
    assert got == want and df.count() == len(want)
    assert sum(r[3] is not None for r in got) > 5


def odd_words():
    long = "x" * 200
    texts = [
        "Receive receive RECEIVE received recieve recieve receve receve receive " * 12,
        "recieves recieves received Étudiant Étudiants étudiant étudiants Étudiant étudiant",
        f"{long} {long} {long}y {long}y {long[1:]}z {long[1:]}z don't_stop123going stoppingĀstopping stopping÷stopping",
        "listen1 tensile tensile enlistss enlistss silents silents tinsels tinsels aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa",
    ]
    return [(1, texts[0]), (2, texts[1]), (2, texts[1]), (3, None), (4, ""), (5, texts[2]), (None, texts[2]), (6, texts[3] * 3), (7, "ab cd 12")]


def test_variants_of_odd_texts(spark):
    table = documents(spark, odd_words())
    assert as_rows(spelling.variants(table, plant=True)) == plain_variants(odd_words())
    assert spelling.variants(table.filter("false")).count() == 0


def test_large_signatures_lose_nothing(spark, monkeypatch):
    random = np.random.default_rng(2)
    # Anagrams share all their signatures.
    words = sorted({"".join(random.permutation(list("abcdefgh"))) for _ in range(300)} | {"abcdefgh"[:k] + "abcdefgh"[k + 1 :] for k in range(8)})
    text = " ".join(words * 2)
    table = documents(spark, [(1, text), (2, "abcdefgh " * 40)])
    monkeypatch.setattr(spelling, "AT_ONCE", 30)
    assert as_rows(spelling.variants(table, plant=True)) == plain_variants([(1, text), (2, "abcdefgh " * 40)])


def test_chains_of_forms_lead_to_their_end(spark):
    counts = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000), ("zzzzzzzz", 5)]
    text = " ".join(" ".join([w] * n) for w, n in counts)
    got = {r["word"]: r["root"] for r in spelling.variants(documents(spark, [(1, text)])).collect()}
    assert got == {w: "abcdefghijk" if w[0] == "a" else w for w, _ in counts}


def test_edits_of_words_of_all_lengths():
    random = np.random.default_rng(4)
    words = []
    for _ in range(120):
        word = "".join(random.choice(list("abé"), int(random.integers(1, 50))))
        at = int(random.integers(0, len(word)))
        words += [word, word[:at] + word[at + 1 :], word[:at] + "ÿ" + word[at + 1 :], word[:at] + "q" + word[at:], word[::-1]]
    words = [w for w in dict.fromkeys(words) if w]
    flat, lengths = spelling.letters_of(pa.array(words))
    pairs = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words))]
    a, b = np.array(pairs).T

    def edits(v, w):
        if len(v) == len(w):
            return sum(x != y for x, y in zip(v, w, strict=True)) == 1
        v, w = sorted((v, w), key=len)
        return len(w) == len(v) + 1 and any(w[:k] + w[k + 1 :] == v for k in range(len(w)))

    want = [edits(words[x], words[y]) for x, y in pairs]
    assert spelling.Edits(flat, lengths)(a, b).tolist() == want
    bits = spelling.folded(flat, lengths)
    assert np.bitwise_count(bits[a] ^ bits[b])[np.array(want)].max() <= 2
    keys = [set(k) for k in spelling.signatures(flat, lengths).tolist()]
    assert all(keys[x] & keys[y] for (x, y), near in zip(pairs, want, strict=True) if near)
