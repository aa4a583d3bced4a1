"""Sentiment scores in [-1, 1]: word list, trained model, or a caller's function."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.text import tokens
from feedloom.operators.flatten import post_rows
from feedloom.operators.skew import BROADCAST_ROWS, join_unique, small_enough
from feedloom.session import stage

# A word list up to this size travels inside the plan as literals, a longer one as a hash table, and
# one of over BROADCAST_ROWS words is joined.
INLINE_LEXICON = 2_000


def polarity(positive: Column, negative: Column) -> Column:
    """(pos - neg) / (pos + neg), and 0 when no listed word occurs."""
    total = positive + negative
    return F.when(total == 0, F.lit(0.0)).otherwise((positive - negative) / total)


def _tallied(text: Column, listed: Callable[[Column], Column], up: Callable[[Column], Column]) -> Column:
    """One pass over the words; listed words are picked first, then tallied."""
    start = F.struct(F.lit(0).alias("ups"), F.lit(0).alias("downs"))

    def tally(seen: Column, token: Column) -> Column:
        hit = up(token).cast("int")
        return F.struct((seen["ups"] + hit).alias("ups"), (seen["downs"] + 1 - hit).alias("downs"))

    return F.aggregate(F.filter(tokens(text), listed), start, tally, lambda seen: polarity(seen["ups"], seen["downs"]))


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    return _tallied(text, lambda t: t.isin(positive + negative), lambda t: t.isin(positive))


def _table_score(text: Column, words: list) -> Column:
    """:func:`lexicon_score` with the words in a hash table of short lists, one constant of the plan.

    ``words`` are rows of token, whether it is positive, and hash. A word is compared with those
    of its slot only, and no row is moved, so it serves batches and streams alike.
    """
    slots = 1 << len(words).bit_length()

    def among(up: bool) -> Callable[[Column], Column]:
        lists: list[list[str]] = [[] for _ in range(slots)]
        for word in words:
            if not up or word["up"]:
                lists[word["hash"] % slots].append(word["token"])
        table = F.from_json(F.lit(json.dumps(lists, ensure_ascii=False)), "array<array<string>>")
        return lambda t: F.array_contains(F.get(table, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")), t)

    return _tallied(text, among(False), among(True))


def _split_tally(text: Column, words: list) -> tuple[Column, Column]:
    """What the common ``words`` say of a text, and its tokens that are none of them.

    The first is an array with 1 for every positive token, -1 for every negative one, 0 for a common word
    that is not listed and NULL for all other tokens. ``words`` are as for :func:`_table_score`, with ``up`` NULL if not listed.
    """
    slots = 1 << len(words).bit_length()
    names: list[list[str]] = [[] for _ in range(slots)]
    marks: list[list[int]] = [[] for _ in range(slots)]
    for word in words:
        names[word["hash"] % slots].append(word["token"])
        marks[word["hash"] % slots].append(0 if word["up"] is None else 1 if word["up"] else -1)
    name = F.from_json(F.lit(json.dumps(names, ensure_ascii=False)), "array<array<string>>")
    mark = F.from_json(F.lit(json.dumps(marks)), "array<array<int>>")

    def says(token: Column) -> Column:
        slot = F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")
        return F.get(F.get(mark, slot), (F.array_position(F.get(name, slot), token) - 1).cast("int"))

    return F.transform(tokens(text), says), tokens(text)


def _common_words(counted: DataFrame, words: DataFrame) -> list:
    """The words that occur most, up to ``BROADCAST_ROWS``, listed or not: token, ``up`` and hash.

    Counts are put into eight classes per power of two; a class is taken whole or not at all.
    """
    level = F.floor(F.log2("n") * 8)
    classes = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    lowest, taken = None, 0
    for row in classes:
        taken += row["words"]
        if taken > BROADCAST_ROWS:
            break
        lowest = row["level"]
    if lowest is None:
        return []
    common = counted.filter(level >= lowest).select("token")
    up = words.join(F.broadcast(common), "token", "left_semi")
    return common.join(F.broadcast(up), "token", "left").select("token", "up", F.xxhash64("token").alias("hash")).collect()


def _joined_score(df: DataFrame, words: DataFrame, text_col: str, spread: str, out: str) -> DataFrame:
    """The same scores for a word list of any size.

    The words that occur most in the texts are tallied in place, like those of a short list. Only tokens that are
    none of them, few by nature, are joined to the list. What is common is counted, and never changes a score.
    Texts are told apart by a 128-bit hash, and repeats of a text are dropped once they are narrow.
    """
    key = unused(df, "_text_key")
    marked = df.withColumn(key, F.md5(text_col))
    words = stage(words, "lexicon")
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counted = stage(texts.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    marks, found = _split_tally(F.col("text"), _common_words(counted, words))
    rest = F.filter(F.arrays_zip(F.col("marks").alias("mark"), F.col("tokens").alias("token")), lambda t: t["mark"].isNull())
    tallied = texts.select(F.md5("text").alias("key"), marks.alias("marks"), found.alias("tokens")).select(
        "key",
        F.size(F.filter("marks", lambda m: m == 1)).cast("long").alias("ups"),
        F.size(F.filter("marks", lambda m: m == -1)).cast("long").alias("downs"),
        F.transform(rest, lambda t: t["token"]).alias("rest"),
    )
    once = stage(stage(tallied, "tallies").dropDuplicates(["key"]), "texts")
    rare = once.select("key", F.explode("rest").alias("token"))
    rare = join_unique(rare, words, ["token"], "inner", "key").select("key", F.when(F.col("up"), 1).otherwise(0).alias("ups"))
    rare = rare.select("key", F.col("ups").cast("long").alias("ups"), (1 - F.col("ups")).cast("long").alias("downs"))
    both = once.select("key", "ups", "downs").unionByName(rare).groupBy("key").agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs"))
    scores = both.select(F.col("key").alias(key), polarity(F.col("ups"), F.col("downs")).alias("_score"))
    joined = join_unique(marked, stage(scores, "scores"), [key], "left", spread)
    score = F.when(F.col(key).isNotNull(), F.coalesce("_score", F.lit(0.0)))
    return joined.select(*[c for c in df.columns if c != out], score.alias(out))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def score_sentiment(
    df: DataFrame, lexicon: DataFrame, text_col: str = "event_text", key: str = "id", out: str = "sentiment_score"
) -> DataFrame:
    """Score ``text_col`` with a lexicon of ``token`` and ``polarity`` (+1 or -1).

    A token listed several times counts once per occurrence in a text, and as positive if any of its
    entries is. Entries without a token or a polarity, or of polarity 0, are left out. A NULL
    text has no score, one without listed words 0; ids may repeat or be NULL. The size of
    the lexicon chooses the plan and never changes a score: up to ``BROADCAST_ROWS`` words
    are read (never more than one beyond that) and scored in place without a shuffle, on streams
    too. Of longer lists the words that occur most are scored so, and the others joined to the texts, which a stream
    cannot do: score it in ``foreachBatch`` then. ``key`` is a column that spreads rows of one text.
    """
    entries = lexicon.filter(F.col("token").isNotNull() & (F.col("polarity") != 0))
    listed = entries.groupBy("token").agg((F.max("polarity") > 0).alias("up"))
    if small_enough(listed):
        words = listed.select("token", "up", F.xxhash64("token").alias("hash")).collect()
        if len(words) > INLINE_LEXICON:
            return df.withColumn(out, _table_score(F.col(text_col), words))
        positive = [w["token"] for w in words if w["up"]]
        return df.withColumn(out, lexicon_score(F.col(text_col), positive, [w["token"] for w in words if not w["up"]]))
    if df.isStreaming:
        raise ValueError(f"a lexicon of over {BROADCAST_ROWS} words cannot score a stream; score each batch in foreachBatch")
    return _joined_score(df, listed, text_col, key, out)


def score_with(
    df: DataFrame, fn: Callable, text_col: str = "event_text", out: str = "sentiment_score"
) -> DataFrame:
    """Score with ``fn``, a function from a pandas Series of texts to one of scores."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return fn(texts).clip(-1.0, 1.0)

    return df.withColumn(out, scored(F.col(text_col)))


def train_scorer(labelled: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 18):
    """Fit hashed TF-IDF features and a logistic regression on 0/1 labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern="[^\\p{L}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label_col, regParam=0.01, maxIter=30),
    ]
    return Pipeline(stages=stages).fit(labelled)


def model_score(df: DataFrame, model, out: str = "sentiment_score") -> DataFrame:
    """Score = 2p - 1 with the model's probability ``p`` of the label 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    chance = vector_to_array(F.col("probability"))[1]
    return scored.select(*df.columns, (chance * 2 - 1).alias(out))


def posts(base: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scored posts; ``scorer`` adds ``sentiment_score`` to a DataFrame with ``event_text``."""
    return scorer(post_rows(base)).select(*schemas.POST_COLUMNS)


def lexicon_scorer(lexicon: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda df: score_sentiment(df, lexicon)
