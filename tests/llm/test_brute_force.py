"""Operators without SQL against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, html, langid, linededup, packing, queries, simhash
from feedloom.llm.common import connected_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# --- SimHash ---------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_query(spark, docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    place = {i: n for n, i in enumerate(order)}
    root = plain_components(range(len(rows)), [(place[i], place[j]) for i, j in linked])
    want = {(rows[i]["doc_id"], f"{prints[i]:016x}", rows[order[root[place[i]]]]["doc_id"]) for i in range(len(rows))}
    assert {tuple(r) for r in queries.op6_simhash(spark, FOLDER).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_links_connect_dense_and_sparse_fingerprints(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(6):
        fp = rng.getrandbits(64)
        for _ in range(60):  # a walk: neighbours are close, its ends are not
            fp ^= 1 << rng.randrange(64)
            fp ^= 1 << rng.randrange(64) if rng.random() < 0.5 else 0
            prints.add(fp)
    prints |= {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 7, 2**63}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    want = plain_components(prints, linked)
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert plain_components(prints, got) == want


def test_large_runs_are_split_without_losing_links():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 4000, np.uint64) | np.uint64(1) << rng.integers(0, 64, 4000, np.uint64)]))
    split = simhash._near(fps, 3)
    roots = plain_components(range(len(fps)), list(zip(*map(np.ndarray.tolist, split), strict=True)))
    assert set(roots.values()) == {0}
    at_once, simhash.AT_ONCE = simhash.AT_ONCE, 100
    try:
        parts = simhash._near(fps, 3)
    finally:
        simhash.AT_ONCE = at_once
    assert set(plain_components(range(len(fps)), list(zip(*map(np.ndarray.tolist, parts), strict=True))).values()) == {0}


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts(seed, bases, copies):
    """Texts with copies of theirs in which some words are others."""
    rng = random.Random(seed)
    made = []
    for _ in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((4, 40, 150, 400)))]
        made.append(" ".join(words))
        for _ in range(copies):
            share = rng.choice((0.005, 0.01, 0.02, 0.03, 0.1))
            made.append(" ".join(f"x{rng.randrange(3000)}" if rng.random() < share else w for w in words))
    return [*dict.fromkeys(made), "", " \n", "One Two", "one  two"]


def test_similar_texts_are_linked_like_all_pairs(spark):
    texts = edited_texts(3, 30, 12)
    sets = [plain_shingles(t) for t in texts]
    marks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS mark")
    place = {r["mark"]: r["doc_id"] for r in marks.collect()}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(place[r["a"]], place[r["b"]]) for r in simhash.similar_links(docs).collect()]
    assert all(plain_jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if plain_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(linked) > 200
    assert plain_components(range(len(texts)), got) == plain_components(range(len(texts)), linked)


def test_large_sets_of_sketches_are_split_without_losing_links():
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(f"x{rng.randrange(9999)}" if rng.random() < 0.01 else w for w in base) for _ in range(300)]
    sketches = np.array([(simhash.signature(t) >> np.uint64(16)).astype(np.uint8) for t in texts])
    at_once, simhash.AT_ONCE = simhash.AT_ONCE, 100
    try:
        split = simhash._alike(sketches)
    finally:
        simhash.AT_ONCE = at_once
    for found in (simhash._alike(sketches), split):
        pairs = [(int(a), int(b)) for p, q in found for a, b in zip(p, q, strict=True)]
        assert set(plain_components(range(300), pairs).values()) == {0}


def similar_components(spark, texts):
    """Roots by all pairs and by similar_links, as lists of links between places."""
    sets = [plain_shingles(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = {r["mark"]: r["doc_id"] for r in df.selectExpr("doc_id", "xxhash64(text) AS mark").collect()}
    got = [(place[r["a"]], place[r["b"]]) for r in simhash.similar_links(df.select("text")).collect()]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if plain_jaccard(sets[i], sets[j]) >= 0.8]
    assert all(plain_jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
    return plain_components(range(len(texts)), linked), plain_components(range(len(texts)), got)


def loose_copies(seed, copies):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    return [" ".join(f"x{rng.randrange(9999)}" if rng.random() < 0.018 else w for w in base) for _ in range(copies)]


def test_a_group_in_many_parts_is_linked_like_a_small_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 40)
    want, got = similar_components(spark, loose_copies(1, 160))
    assert got == want


def test_texts_of_a_large_key_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 40)
    monkeypatch.setattr(simhash, "TEXTS_AT_ONCE", 25)
    want, got = similar_components(spark, loose_copies(3, 120))
    assert got == want


def test_a_cell_returns_links_that_connect_and_no_pairs():
    texts = loose_copies(4, 90) + ["", " "]
    sets = [plain_shingles(t) for t in texts]
    batch = pa.RecordBatch.from_pydict(
        {"cell": [1] * 92, "side": np.zeros(92, np.int32), "mark": range(92), "root": range(92), "text": texts}
    )
    found = [(a, b) for out in simhash._exact_links(5, 0.8)(iter([batch])) for a, b in zip(*out.to_pydict().values(), strict=True)]
    linked = [(i, j) for i in range(92) for j in range(i) if plain_jaccard(sets[i], sets[j]) >= 0.8]
    assert all(plain_jaccard(sets[a], sets[b]) >= 0.8 for a, b in found)
    assert plain_components(range(92), found) == plain_components(range(92), linked)
    assert len(linked) > 300 and len(found) < 92


def test_pipeline_stage_links_what_fingerprints_do_not(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts = [" ".join(f"x{n}" if k % 130 == 10 * n else w for k, w in enumerate(base)) for n in range(6)]  # J 0.86
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_duplicates(df).select("component_id").distinct().count() > 1
    assert [r["doc_id"] for r in simhash.keep_one(df).collect()] == [0]


def test_links_near_the_bound_are_sought_until_none_is_left(spark):
    want, got = similar_components(spark, loose_copies(2, 240))
    assert got == want


def test_hot_fingerprint_keys_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5)))) for _ in range(400)})
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    seen = []
    monkeypatch.setattr(simhash, "AT_ONCE", 8)
    cells = simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert plain_components(prints, got) == plain_components(prints, linked)
    assert seen and max(r["count"] for r in seen[0].groupBy("cell").count().collect()) <= 60


def test_keep_one_takes_near_copies_and_leaves_others(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(20, 280, 20)]  # J 0.967 to the first
    far = " ".join(w if i % 8 else "gap" for i, w in enumerate(words))
    texts = [" ".join(words), *near, far]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, len(texts) - 1]


def test_components_of_a_long_path(spark):
    nodes = list(range(-40, 160))
    random.Random(1).shuffle(nodes)
    edges = list(zip(nodes, nodes[1:], strict=False)) + [(1000, 1001), (1002, 1001), (5000, 5000)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert {root[n] for n in nodes} == {-40} and root[1002] == root[1001] == root[1000] == 1000
    assert found.count() == len(nodes) + 3


# --- decontamination --------------------------------------------------------------


def plain_report(texts, items):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = defaultdict(set)
    for item, text in items:
        listed = words(text)
        n = min(10, len(listed))
        for at in range(len(listed) - n + 1 if n else 0):
            windows[tuple(listed[at : at + n])].add(str(item))
    for doc, text in texts:
        listed = words(text)
        hit, found = [False] * len(listed), set()
        for n in {len(w) for w in windows}:
            for at in range(len(listed) - n + 1):
                if owners := windows.get(tuple(listed[at : at + n])):
                    hit[at : at + n] = [True] * n
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(listed), sum(hit), len(found), digest, any(hit)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination_query(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = set(plain_report([(r["doc_id"], r["text"]) for r in docs.collect()], items))
    assert {tuple(r) for r in queries.op7_decontamination(spark, FOLDER).select(*COLUMNS).collect()} == want
    assert sum(w[-1] for w in want) > 0


def test_repetitive_texts_and_benchmark_blocks(spark):
    rng = random.Random(7)
    texts = [(n, " ".join(rng.choice("aab") for _ in range(rng.randrange(500)))) for n in range(40)]
    items = [(n, " ".join(rng.choice("aab") for _ in range(rng.randrange(1, 16)))) for n in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set(plain_report(texts, items))
    assert {tuple(r) for r in decontaminate.report(docs, bench).select(*COLUMNS).collect()} == want
    one = {r["doc_id"]: r for r in decontaminate.spans(docs, bench).collect()}
    many = {r["doc_id"]: r for r in decontaminate.spans(docs, bench, block_bytes=1000).collect()}
    for doc, row in one.items():
        assert (row["starts"], row["lengths"], sorted(row["items"])) == (many[doc]["starts"], many[doc]["lengths"], many[doc]["items"])


def test_positions_come_from_sampled_suffixes():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 700, 3, 1, 900])
    ids = rng.integers(0, 3, sizes.sum())
    index = decontaminate.FmIndex(ids, sizes)
    assert len(index.samples) < index.n / 6
    pattern = ids[100:104][None, :]
    low, high = index.search(pattern, np.array([4]))
    got = np.unique(index.locate(np.arange(low[0], high[0])))
    ends = np.cumsum(sizes)
    want = [i for i in range(len(ids) - 3) if (ids[i : i + 4] == pattern[0]).all() and np.searchsorted(ends, i, "right") == np.searchsorted(ends, i + 3, "right")]
    assert got.tolist() == want


# --- line dedup -------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_lines(texts):
    seen, found = [], {}
    for doc, text in texts:
        kept, near, split = [], 0, text.split("\n")
        for line in split:
            if not re.search(r"[^\W_]", line):
                kept.append(line)
            elif line not in seen:
                close = len(line) >= 32 and any(len(s) >= 32 and within_one(s, line) for s in seen)
                seen.append(line)
                near += close
                kept += [] if close else [line]
        found[doc] = ("\n".join(kept), len(split), len(kept), near)
    return found


def test_edited_lines(spark, docs):
    rng = random.Random(3)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())[:100]
    pool = [line for _, t in rows for line in t.split("\n") if len(line) > 31][:50]
    texts = []
    for doc, text in rows:
        split = text.split("\n")[:3]
        for _ in range(4):
            line = rng.choice(pool)
            for _ in range(rng.choice((0, 1, 1, 2))):
                at, kind = rng.randrange(len(line)), rng.choice("sid")
                line = line[:at] + ("é" if kind == "s" else "x" + line[at] if kind == "i" else "") + line[at + 1 :]
            split.append(line)
        texts.append((doc, "\n".join([*split, rng.choice(["---", "", "Short one."])])))
    found = linededup.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = plain_lines(texts)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"], r["n_near"]) for r in found} == want
    assert sum(w[3] for w in want.values()) > 50


def test_line_dedup_query(spark, docs):
    found = queries.op9_line_dedup(spark, FOLDER).collect()
    want = plain_lines(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"], r["n_near"]) for r in found} == want


# --- packing ----------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "tokenizer"):
        plain_ids.tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*plain_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def holds(texts, pieces):
    pieces = pieces.sort_values(["doc_id", "start"])
    for doc, text in texts:
        ids, at = plain_ids(text), 0
        for p in pieces[pieces.doc_id == doc].itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, some in pieces.sort_values("offset").groupby("sequence_id"):
        assert some.offset.tolist() == [0, *np.cumsum(some.length)[:-1].tolist()]
    return pieces.groupby("sequence_id").length.sum()


def test_packing_query(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = holds(texts, queries.op10_packing(spark, FOLDER).toPandas())
    assert sizes.max() <= 4096
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padding < 0.02 * sizes.sum()


def test_packing_of_odd_texts(spark):
    texts = [
        (1, None),
        (2, ""),
        (3, "a<|endoftext|>b <|startoftext|>"),
        (4, "It's 12.5%, isn't it?! Ünïcode İstanbul ẞ ſ… «x».y,z \x1cA B﻿ é ͅ"),
        (5, "x" * 5000 + " " + "中文字。" * 3000),
        (6, "word. " * 9000),
        (7, "\n\t\r"),
        (8, "emoji 👍🏽 👨‍👩‍👧 ok... a.b,c;d:e!f?g 1.2 3,4 é.è …. x…."),
    ]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, start string").coalesce(1)
    assert holds(texts, packing.pack(df, chunk=5000).toPandas()).max() <= 4096
    assert holds(texts, packing.pack(df, window=64, chunk=500).toPandas()).max() <= 64


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        places = np.array(sorted(rng.sample(range(1, 120), 14)))
        places = np.union1d(places, np.arange(8, places[-1], 8))
        fees = np.array([rng.choice((0, 8, 64)) for _ in places])
        cuts = packing.cut(places, fees, 16)
        price = dict(zip(places.tolist(), (fees + packing.PER_SEQUENCE).tolist(), strict=True))

        def pad(n, end, last=int(places[-1])):
            free = n & (n - 1) == 0 and (n >= packing.SHORT or end >= last - 16 or n == 16)
            return 0 if free else 16 - n

        best = {0: 0}
        for j in places.tolist():
            best[j] = min(best[i] + pad(j - i, j) + price[j] for i in best if 0 < j - i <= 16)
        assert sum(pad(b - a, b) + price[b] for a, b in zip([0, *cuts], cuts, strict=False)) == best[int(places[-1])]


# --- language and pages -----------------------------------------------------------


def test_held_out_languages_are_found(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op5_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    held = found[found.held_out & found.lang.notna()]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() >= 0.97


def test_the_sample_is_the_smallest_hashes_of_each_language(spark):
    """The draw before the sort changes nothing, and the bound on languages is the caller's."""
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "IF(id % 2 = 0, 'a', IF(id % 3 = 0, 'b', 'c')) AS lang",
        "concat_ws(' ', sha2(cast(id AS STRING), 256), lang, 'é') AS text",
    )
    usable = docs.filter(~langid.held_out()).withColumn("mark", F.xxhash64("text", "doc_id")).collect()
    for languages, wanted in ((200, "abc"), (2, "ac"), (1, "a")):
        chosen = []
        for name in wanted:
            first = sorted((r for r in usable if r["lang"] == name), key=lambda r: r["mark"])[:20]
            chosen += [(name, langid.presence(np.frombuffer(r["text"].lower().encode(), np.uint8)).astype("<i4")) for r in first]
        plain = langid.Model.fit(sorted(chosen, key=lambda x: (x[0], x[1].tobytes())), 8)
        model = langid.fit(docs, 20, 8, languages)
        assert list(model.languages) == list(wanted)
        assert np.array_equal(model.vocabulary, plain.vocabulary) and np.allclose(model.weights, plain.weights)


def test_margins_do_not_depend_on_batches():
    rng = random.Random(6)
    texts = [("".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 400)))).encode() for _ in range(40)]
    model = langid.Model.fit([(f"l{n % 3}", langid.presence(np.frombuffer(t, np.uint8))) for n, t in enumerate(texts)], 8)
    places = model.table()
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = model.margins(data, ends, places)
    batch, langid.BATCH_BYTES = langid.BATCH_BYTES, 7
    try:
        assert np.allclose(model.margins(data, ends, places), whole)
    finally:
        langid.BATCH_BYTES = batch
    # The same by kernel values with the landmarks' coefficients.
    present = np.stack([np.isin(model.vocabulary, langid.presence(np.frombuffer(t, np.uint8))) for t in texts]).astype(float)
    assert np.allclose(present @ model.weights / np.sqrt(np.maximum(1, present.sum(axis=1, keepdims=True))) + model.bias, whole, atol=1e-4)


def test_articles_are_extracted(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for row in queries.op8_html_extraction(spark, FOLDER).collect():
        inner = re.search("<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split("</?(?:p|h1)>", inner)]
        assert row["text"] == "\n".join(p for p in parts if p) and row["n_chars"] == len(row["text"])


def test_sample_pages_are_learned(spark):
    tree = html.train(spark)
    rows = html.labelled()
    assert (tree.predict(np.array([x for _, x in rows])) == np.array([y > 0.5 for y, _ in rows])).all()
    page = '<div class="ads">Buy now</div><p>One <a href=x>two</a> three.</p><script>if (a < b) "</p>"</script><!-- <p>no</p> --><footer>End</footer>'
    assert html.main_text(f"<article>{page}</article>", tree) == "One two three."
