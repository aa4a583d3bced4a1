"""Line deduplication with a deletion-neighbourhood join; the earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, unused
from feedloom.operators.skew import small_enough
from feedloom.session import stage

# Lines are near copies at this edit distance. Shorter lines, in characters, are compared exactly only:
# one edit turns one short line (a year, a number, a key) into another.
EDITS = 1
NEAR_CHARS = 32
# Segments of a line. One edit changes one of them, so the rest must be equal.
SEGMENTS = 3
LINE_BITS = 32
BROADCAST_ROWS = 200_000


def _order(row: str = "row", line: str = "line_no") -> Column:
    """Rank of a line in the table: its row, then its place."""
    return F.col(row).cast("decimal(19,0)") * F.lit(1 << LINE_BITS).cast("decimal(11,0)") + F.col(line)


def _bound(s: int, n: str) -> str:
    return f"cast(floor({s} * ({n}) / {SEGMENTS}) as int)"


def _segment_keys(line: str, n: str) -> list[Column]:
    """Hashes of a line without one segment, for partners of its own length and one shorter than itself.

    A line and a longer one meet in the keys that cut both by the shorter length, the
    longer with one more character in the segment left out.
    """
    keys = []
    for extra in (0, 1):
        m = f"({n} - {extra})"
        for s in range(SEGMENTS):
            before = f"substring({line}, 1, {_bound(s, m)})"
            after = f"substring({line}, {_bound(s + 1, m)} + {1 + extra}, {n})"
            keys.append(F.expr(f"xxhash64({s}, {m}, {before}, {after})"))
    return keys


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """The documents with a unique long ``name`` in the order that decides which line is earliest.

    That is the doc_id. If doc_ids repeat, are null or negative, the rows are sorted once by
    doc_id, nulls last, rows of one doc_id by a hash of the text, so the order of two
    rows depends on them alone; only rows alike in both follow their place in the table.
    """
    doc_id = F.col("doc_id").cast("long")
    repeated = docs.select(doc_id.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL OR id < 0")
    if not repeated.limit(1).count():
        return docs.withColumn(name, doc_id)
    place = unused(docs, "_place")
    marked = docs.withColumn(place, F.monotonically_increasing_id())
    # The hash and the place are part of the sort's ranges, so a repeated doc_id is no hot key.
    ordered = marked.orderBy(doc_id.asc_nulls_last(), F.xxhash64(F.col("text").cast("string")), place).drop(place)
    return stage(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered")


def lines(rows: DataFrame) -> DataFrame:
    """``row``, ``line_no``, ``line`` of all texts; null texts have no lines."""
    split = F.split(F.col("text").cast("string"), "\n", -1)
    return rows.select(F.col("_row").alias("row"), F.posexplode(split).alias("line_no", "line"))


def first_lines(rows: DataFrame) -> DataFrame:
    """One row per different line: the ``ord`` of its first place, its length ``n`` and its segment keys ``k0`` to ``k5``.

    Lines without a letter or digit only lay out the text: each is taken as different.
    Lines meet by 128 bits of hash; repeats are combined before the shuffle.
    """
    cut = lines(rows).withColumn("n", F.length("line")).withColumn("said", F.col("line").rlike(r"[\p{L}\p{N}]"))
    keys = _segment_keys("line", "n")
    near = F.col("said") & (F.col("n") >= NEAR_CHARS)
    one = F.when(F.col("said"), F.xxhash64("line")).otherwise(F.col("row"))
    two = F.when(F.col("said"), F.xxhash64(F.lit(1), "line")).otherwise(F.col("line_no").cast("long"))
    keyed = cut.select(
        "said",
        one.alias("h1"),
        two.alias("h2"),
        _order().alias("ord"),
        F.when(near, F.col("n")).alias("n"),
        *[F.when(near, k).alias(f"k{i}") for i, k in enumerate(keys)],
    )
    same = [F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))]
    return keyed.groupBy("said", "h1", "h2").agg(F.min("ord").alias("ord"), F.min("n").alias("n"), *same)


def suspects(first: DataFrame) -> DataFrame:
    """Lines that agree with another one in all but one segment: ``ord`` and, in ``segments``, the keys that say so.

    Key i < 3: segment i, partner of equal length or one longer. Key i + 3: segment i, partner one shorter.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("key")) for i in range(2 * SEGMENTS)])
    keyed = first.filter("n IS NOT NULL").select("ord", F.explode(listed).alias("k")).select("ord", "k.i", "k.key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keyed.join(shared, "key", "left_semi").groupBy("ord").agg(F.collect_list(F.struct("i", "key")).alias("segments"))


def with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the ``line`` itself to rows that carry an ``ord``."""
    place = found.withColumn("_at", F.floor(F.col("ord") / F.lit(1 << LINE_BITS).cast("decimal(11,0)")).cast("long"))
    wanted = place.select(F.col("_at").alias("_row")).distinct()
    if small_enough(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    some = lines(rows.join(wanted, "_row", "left_semi")).select(_order().alias("ord"), "line")
    return some.join(found, "ord")


def variants(texts: DataFrame) -> DataFrame:
    """Deletion variants of the suspects within the segments in question: ``key``, ``ord``, ``whole``.

    Two lines of one length that differ in one character agree once it is deleted from
    both, at the same place, which is part of the key. A line agrees with one that has one
    character more once that is deleted from the longer; the shorter comes ``whole``. The rest of
    the line stands in the key as the hash that made the line a suspect, so only the segment is cut.
    """
    extra, s = f"cast(i / {SEGMENTS} as int)", f"(i % {SEGMENTS})"
    m = f"(length(line) - {extra})"
    low, end = _bound(s, m), f"({_bound(f'({s} + 1)', m)} + {extra})"
    cut = texts.select("ord", "line", F.inline("segments")).select("ord", "i", "key", F.expr(f"substring(line, {low} + 1, {end} - {low})").alias("part"))
    places = F.sequence(F.when(F.col("i") < SEGMENTS, -1).otherwise(0), F.length("part") - 1)
    one = cut.select("*", F.explode(places).alias("p")).withColumn("kind", F.when((F.col("i") < SEGMENTS) & (F.col("p") >= 0), 0).otherwise(1))
    rest = F.expr("if(p < 0, part, concat(substring(part, 1, p), substring(part, p + 2, length(part))))")
    key = F.when(F.col("kind") == 0, F.xxhash64("kind", "p", "key", rest)).otherwise(F.xxhash64("kind", "key", rest))
    return one.select(key.alias("key"), "ord", (F.col("p") < 0).alias("whole"), "kind")


def near_lines(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``ord`` of the lines that have an earlier different line within one edit.

    Of all lines that share a variant only the earliest is paired with each, so no group
    gives all its pairs. What shares a variant differs in one character of one place, so
    such a group is no larger than the alphabet times the length of the line. The pair's
    edit distance is verified on the texts.
    """
    texts = stage(with_texts(rows, suspects(first)), "suspects")
    met = Window.partitionBy("key")
    earliest_whole = F.min(F.when(F.col("whole"), F.col("ord"))).over(met)
    earliest_cut = F.min(F.when(~F.col("whole"), F.col("ord"))).over(met)
    partner = F.when((F.col("kind") == 0) | F.col("whole"), earliest_cut).otherwise(earliest_whole)
    pairs = variants(texts).select("ord", partner.alias("partner")).filter("partner < ord")
    best = pairs.groupBy("ord").agg(F.min("partner").alias("partner"))
    mine = texts.select("ord", F.col("line").alias("mine"))
    theirs = texts.select(F.col("ord").alias("partner"), F.col("line").alias("theirs"))
    checked = best.join(mine, "ord").join(theirs, "partner")
    return checked.filter(F.levenshtein("mine", "theirs", EDITS).between(0, EDITS)).select("ord")


def _rebuilt(schema, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column lists the lines that stay."""
        for batch in batches:
            texts = []
            for text, kept in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None:
                    split = text.split("\n")
                    text = text if len(kept or ()) == len(split) else "\n".join(split[i] for i in sorted(kept or ()))
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def kept_lines(rows: DataFrame) -> DataFrame:
    """``_row`` and the sorted numbers of its lines that stay, ``kept``; also how many near copies went, ``near``."""
    first = stage(first_lines(rows), "lines")
    gone = stage(near_lines(rows, first).withColumn("near", F.lit(1)), "near")
    marked = first.select("ord").join(gone, "ord", "left")
    row = F.floor(F.col("ord") / F.lit(1 << LINE_BITS).cast("decimal(11,0)")).cast("long")
    line = (F.col("ord") % F.lit(1 << LINE_BITS).cast("decimal(11,0)")).cast("int")
    stays = F.collect_list(F.when(F.col("near").isNull(), F.col("line")))
    return (
        marked.select(row.alias("_row"), line.alias("line"), "near")
        .groupBy("_row")
        .agg(stays.alias("kept"), F.count("near").alias("near"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without lines that an earlier line equals or is one edit from.

    Lines are cut at line feeds. The order is that of doc_ids and, inside, of the text;
    see :func:`numbered` for repeated or null doc_ids. A line of ``NEAR_CHARS`` characters
    or more also goes if any earlier different line is within one inserted, deleted or
    replaced character, whether or not that line stays itself. Lines without letters or
    digits stay. A text that loses all lines becomes empty, a null text stays null, no row
    is dropped. Columns and types stay; ``n_chars`` follows the text where the table has it.
    """
    row, stay, names = unused(docs, "_row"), unused(docs, "_kept"), docs.columns
    rows = numbered(docs, row)
    kept = kept_lines(rows.select(F.col(row).alias("_row"), "text")).select(F.col("_row").alias(row), F.col("kept").alias(stay))
    joined = rows.join(kept, row, "left").select(*names, stay)
    cleaned = map_arrow(joined, _rebuilt(docs.schema, names.index("text")), docs.schema)
    if "n_chars" not in names:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines kept, near copies dropped, and the text that stays."""
    names = ["doc_id", "text", "n_lines", "n_kept", "n_near"]
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    joined = rows.join(kept_lines(rows), "_row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("kept").isNotNull(), F.size("kept")), F.lit(0)).cast("long").alias("n_kept"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        "kept",
    )
    schema = joined.select(*names).schema
    return map_arrow(joined, _rebuilt(schema, 1), schema)
