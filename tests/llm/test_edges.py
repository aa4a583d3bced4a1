"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm import decontaminate, html, langid, licenses, linededup, packing, sharding, simhash, topk, urls

LONG = " ".join(f"word{n % 977} und{n % 31}" for n in range(60_000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog\nthe second line of this text is long enough to be compared", "en"),
    (2, "the cat sat on the mat and looked at the dog\nthe second line of this text is long enough to be compared", "en"),
    (2, "the cat sat on the mat and looked at the dog\nthe second line of this text is long enough to be compared", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\n ", "de"),
    (6, "123 456 !!", "de"),
    (7, "der hund und die katze sitzen auf der matte und sehen sich an", "de"),
    (None, "der hund und die katze liegen auf dem boden und schlafen", "de"),
    (8, LONG, "en"),
    (9, "The Second line of this text is long enough to be compared\nLicensed under CC BY-NC 4.0.", "en"),
    (9, "une autre phrase avec des mots et le chat dort dans la maison", "fr"),
    (10, "the second line of this text is long enough to be compareds", None),
]
# Names that the operators use inside.
CLASHING = ["row", "n", "rank", "shard", "fp", "mark", "line", "ord", "kept", "path", "licence", "_text", "_row", "_kept", "_mark", "score", "count"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHING]
    )
    rows = [(i, t, lang, None if i == 1 else f"src{(i or 0) % 2}", None if t is None else len(t), *("x",) * len(CLASHING)) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, schema)


def none(df):
    return df.filter("false")


OPERATORS = {
    "licences": licenses.licences,
    "shards": sharding.assign,
    "languages": langid.identify,
    "accepted": langid.accepted,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "lines": linededup.report,
    "dedup_lines": linededup.dedup_lines,
    "packing": packing.pack,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](none(docs)).count() == 0


@pytest.mark.parametrize("name", ["licences", "shards", "languages", "simhash", "lines", "dedup_lines"])
def test_every_row_comes_back(docs, name):
    found = [r["doc_id"] for r in OPERATORS[name](docs).select("doc_id").collect()]
    assert Counter(found) == Counter(i for i, _, _ in TEXTS)


@pytest.mark.parametrize("name", ["accepted", "keep_one", "dedup_lines"])
def test_stages_keep_the_columns(docs, name):
    assert OPERATORS[name](docs).dtypes == docs.dtypes


def test_language_of_odd_texts(docs):
    found = langid.identify(docs).collect()
    for row in found:
        assert 0 <= row["score"] <= 1
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert by[7]["lang_pred"] in ("de", "en", "fr") and not by[None]["held_out"]
    for row in found:
        assert row["held_out"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)


def test_language_without_labels(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(bare).collect()} == {"und"}
    assert langid.accepted(bare).count() == sum(bool(t and re.search(r"[^\W\d_]", t)) for _, t, _ in TEXTS)


def test_accepted_drops_texts_without_letters_only(docs):
    kept = Counter(r["doc_id"] for r in langid.accepted(docs).collect())
    assert kept == Counter(i for i, t, _ in TEXTS if t and re.search(r"[^\W\d_]", t))


def test_keep_one_leaves_one_of_each_group(docs):
    kept = simhash.keep_one(docs).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and sum(ids[i] for i in (3, 4, 5)) == 1 and ids[3] == 1
    assert ids[9] == 2 and ids[None] == 1


def test_keep_one_of_rows_alike_in_all(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 3 + [(None, "x y z")] * 2, "doc_id long, text string")
    assert Counter(r["doc_id"] for r in simhash.keep_one(df).collect()) == {1: 1, None: 1}


def test_lines_of_repeated_rows(docs):
    cleaned = linededup.dedup_lines(docs).collect()
    texts = [r["text"] for r in cleaned if r["doc_id"] in (1, 2)]
    assert sorted(map(len, texts))[:2] == [0, 0] and max(map(len, texts)) == len(TEXTS[0][1])
    assert [r["text"] for r in cleaned if r["doc_id"] == 3] == [None]
    assert [r["text"] for r in cleaned if r["doc_id"] == 5] == ["   \n\n "]
    assert [r["text"] for r in cleaned if r["doc_id"] == 10] == [""]
    for r in cleaned:
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_order_of_lines_depends_on_no_other_row(spark):
    line = "one long line that two documents have in common, word for word"
    kept = lambda rows: {
        r["doc_id"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"]
    }
    pair = [(2, line), (1, line)]
    assert kept(pair) == {1}
    for odd in [(None, "other"), (7, "seven"), (-3, "minus")]:
        assert kept([odd, *pair, odd]) - {odd[0]} == {1}
        assert kept([*pair, odd, odd][::-1]) - {odd[0]} == {1}
    assert 1 in kept([(None, line), *pair]) and 2 not in kept([(None, line), *pair])
    assert kept([(-3, line), *pair]) == {-3}
    many = [(None, f"{line} {n % 9}0000") for n in range(300)]
    assert sum(r["n_kept"] for r in linededup.report(spark.createDataFrame(many, "doc_id long, text string").repartition(7)).collect()) == 1


def test_shards_hold_their_law(docs):
    found = sharding.assign(docs, 4).collect()
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts


def test_a_hot_group_is_dealt_over_shards(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('text ', id % 1500)) as text")
    found = sharding.assign(df).toPandas()
    assert found.groupby("shard").size().nunique() == 1
    groups = found.groupby("text_crc32").agg(n=("doc_id", "size"), k=("shard", "nunique"))
    assert (groups.k[(groups.n > 1) & (groups.n < 100)] > 1).mean() < 0.15
    assert groups.k.max() <= 8


def test_a_group_that_fits_a_shard_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 200)
    df = spark.range(8000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'same', concat('text ', id)) AS text")
    found = sharding.assign(df).toPandas()
    assert found[found.doc_id % 10 == 0].shard.nunique() == 1
    assert found.groupby("shard").size().tolist() == [1000] * 8
    assert all(sorted(some) == list(range(1000)) for _, some in found.groupby("shard").slot)


def test_licences_are_inherited_from_the_nearest_folder(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/LICENSE", "All rights reserved."),
        (3, "a/b/c/d.txt", "plain words without any notice at all"),
        (4, "a/x/y.txt", None),
        (5, "z/q.txt", ""),
        (6, "a/b/own.txt", "some words\nLicensed under CC BY-NC 4.0.\n" + "more words here " * 20),
        (7, "top.txt", "nothing"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in licenses.licences(df, F.col("path")).collect()}
    assert {i: r["effective"] for i, r in found.items()} == {
        1: "MIT", 2: "Proprietary", 3: "Proprietary", 4: "MIT", 5: None, 6: "CC-BY-NC-4.0", 7: None
    }
    assert found[3]["origin"] == "a/b" and not found[6]["is_licence_file"]


def test_decontamination_of_odd_tables(docs, spark):
    items = [(1, "THE cat, sat; on the mat"), (2, None), (3, ""), (None, "der hund"), (4, "und die katze"), (4, "und die katze"), (5, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, bench).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _, _ in TEXTS)
    by = {r["doc_id"]: r for r in found}
    assert (by[1]["n_hit"], by[1]["n_items"]) == (6, 1) and (by[7]["n_hit"], by[7]["n_items"]) == (5, 1)
    assert by[3]["n_words"] == 0 and not by[3]["contaminated"]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench).collect()}
    assert cut[1].startswith(" and looked") and cut[7] == " sitzen auf der matte und sehen sich an" and cut[3] is None
    assert decontaminate.remove(docs, bench).dtypes == docs.dtypes
    assert not decontaminate.report(docs, none(bench)).filter("contaminated").count()
    assert decontaminate.report(none(docs), bench).count() == 0


def test_pages_of_odd_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50_000), (4, "u", "<article><p>A &amp; B &#233; <b>c</b><br>d</p>"), (4, "u", "<p")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    texts = Counter((r["page_id"], r["n_chars"]) for r in found)
    assert texts[(1, 0)] == texts[(2, 0)] == 1 and texts[(None, 249_999)] == 1
    assert {r["text"] for r in found if r["page_id"] == 4} == {"A & B é c d", ""}
    assert html.extract(none(pages)).count() == 0


def test_text_after_unclosed_svg_or_object_is_kept():
    texts = lambda page: [b[0] for b in html.blocks(page)]
    assert texts("<div>one<svg><path d='x'><text>drawn</text><p>two</p></div>three") == ["one", "two", "three"]
    assert texts("<section><svg><text>drawn</section>after <svg><g/></svg>end") == ["after", "end"]
    assert texts("a<object data=x><p>kept</p><object>fallback</object>b") == ["a", "kept", "b"]
    assert texts("a<svg><foreignObject><div>drawn</div></foreignObject></svg>b") == ["a", "b"]


MEGA = 1_000_000
TORN = {
    "torn tags": "<a " * (MEGA // 3),
    "torn tags with quotes": '<a href="' * (MEGA // 9),
    "two kinds of quotes": "<a b='\"" * (MEGA // 7),
    "a long name": "<" + "a" * MEGA,
    "a long attribute": "<div " + "a" * MEGA + ">",
    "a torn end of a script": "<script>" + "</script " * (MEGA // 9),
    "deep": "<div><svg></svg>" * (MEGA // 16),
    "ends without a start": "<div>" * (MEGA // 10) + "</section>" * (MEGA // 20),
    "brackets": "<" * MEGA,
}


@pytest.mark.parametrize("name", TORN)
def test_long_torn_pages_take_linear_time(name):
    start = time.process_time()
    found = html.blocks(TORN[name] + "<p>the end of it</p>")
    assert time.process_time() - start < 10  # measured: 0.8 s at most
    assert found[-1][0].endswith("the end of it")


def test_torn_tags_and_quotes_lose_no_text():
    texts = lambda page: [b[0] for b in html.blocks(page)]
    assert texts("<p>one</p><div <p>two</p>") == ["one", "two"]
    assert texts('<p>one</p><p class="x>two</p><p>three') == ["one", "two", "three"]
    assert texts('<p title="a > b" lang=\'<\'>one</p>') == ["one"]
    assert texts("<p>it's <b class=x'y>bold</b> isn't</p>") == ["it's bold isn't"]
    assert texts("<p>1 < 2</p><p>3 <4 </") == ["1 < 2", "3 <4"]
    assert texts("<p>one</p><a href='x") == ["one"]


def test_urls_of_odd_tables(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?y", "org/", "block"),
        (2, "http://example.org/en/12", "example.org/en/1", "block"),
        (3, "https://org", None, "allow"),
        (4, None, None, "allow"),
        (5, "no scheme/at all", None, "allow"),
        (5, "ftp://borg/x", None, "allow"),
        (None, "http://x.com/fr/#a", "com/fr/", "allow"),
        (8, "http://x.com/de/?q=://org/", "com/de/", "block"),
        (9, "http://my.org/", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, _, _ in rows], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, None, None), (77, 0, 0)], "doc_id long, quality int, toxic int")
    found = {(r["page_id"], r["host"], r["path"]): r for r in urls.judge(pages, labels).collect()}
    assert len(found) == len(rows)
    assert found[(1, "a.example.org", "/es/x")]["rule"] == "example.org/es/"
    assert found[(3, "org", "")]["rule"] is None and found[(4, "", "")]["rule"] is None
    assert found[(8, "x.com", "/de/")]["verdict"] == "block" and found[(None, "x.com", "/fr/")]["rule"] == "com/fr/"
    assert urls.judge(none(pages), labels).count() == 0 and urls.judge(pages, none(labels)).count() == len(rows)


def test_a_bad_host_is_blocked_and_a_bad_page_is_not(spark):
    rows = [(i, f"http://bad.site.net/{i}") for i in range(60)] + [(i, f"http://h{i % 20}.fine.net/{i}") for i in range(60, 460)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 60 or i == 60)) for i, _ in rows], "doc_id long, quality int, toxic int")
    verdicts = urls.judge(pages, labels).toPandas().groupby("host").verdict.agg(set)
    assert verdicts["bad.site.net"] == {"block"} and all(v == {"allow"} for h, v in verdicts.items() if h != "bad.site.net")


def test_vectors_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [2.0]), (8, []), (9, [-1.0, 0.0, 9.0]), (None, [1.0, 1.0]), (50, [1e30, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = topk.top_k(df).toPandas().sort_values(["query_id", "rank"])
    zero = found[found.query_id == 0]
    assert zero.vec_id.tolist() == [50, 7, 1, 2, 8] and zero["rank"].tolist() == [1, 2, 3, 4, 5]
    assert zero.score.tolist()[1:] == [256 * 512, 81920, 81920, 0]
    assert set(found.query_id) == {0, 50} and topk.top_k(none(df)).count() == 0
    assert topk.top_k(df.filter("vec_id % 50 <> 0")).count() == 0


def test_top_k_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 24)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, k=5, every=9, block=16).toPandas()
    whole = np.floor(vectors * 256)
    for q, got in found.groupby("query_id"):
        score = whole @ whole[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:5]
        got = got.sort_values("rank")
        assert got.vec_id.tolist() == best.tolist() and got.score.tolist() == score[best].tolist()
    assert found.query_id.nunique() == 100


def test_variants_of_a_line_are_cut_inside_a_segment_and_come_once(spark):
    line = "x" * 30 + "one long line of plain words that goes on and on until it ends here" + "y" * 30
    longer, other = line[:60] + "Q" + line[60:], line[:60] + "Z" + line[61:]
    docs = spark.createDataFrame([(1, longer), (2, line), (3, other), (4, "something else that has no partner at all in here")], "doc_id long, text string")
    rows = linededup.numbered(docs).select(F.col("_row"), "text")
    first = linededup.first_lines(rows).cache()
    texts = linededup.with_texts(rows, linededup.suspects(first))
    assert {f.name for f in texts.schema["segments"].dataType.elementType.fields} == {"i", "key"}
    made = linededup.variants(texts)
    assert made.filter("whole").count() and made.filter("NOT whole").count() <= 3 * (len(longer) + 3)
    gone = {r["ord"] >> linededup.LINE_BITS for r in linededup.near_lines(rows, first).select(F.col("ord").cast("long").alias("ord")).collect()}
    assert gone == {2, 3}
