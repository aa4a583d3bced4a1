"""One Spark query per operator. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import feedback, text, time
from feedloom.operators import answers, changes, flatten, incremental, score_cache, sentiment, summaries, threads, weekly
from feedloom.plans import marts, pipeline, views
from feedloom.session import stage, staging_path
from feedloom.sources import driver_tables as given
from feedloom.sources import raw_events as raw_source
from feedloom.sources import tables
from feedloom.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MID_MONTH = "2024-01-15 00:00:00"
OVERLAP_END = "2024-01-20 00:00:00"
CLOSED_AT = "2024-01-24 12:00:00"
EMITTED_WEEK = "2024-01-09"
INGESTED = "2024-02-01 00:00:00"
# Bytes of the stored tables whose events make one file of a feed.
FEED_BYTES = 32 << 20


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        cores = spark.sparkContext.defaultParallelism
        if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
            # The default suits a cluster; each stream keeps that many state stores.
            spark.conf.set("spark.sql.shuffle.partitions", cores)
        return printable(fn(spark, folder))

    REGISTRY[fn.__name__] = run
    return run


def printable(df: DataFrame) -> DataFrame:
    """Times and decimals as text and rounded doubles, so engines compare equal."""
    shown = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "decimal":
            col = col.cast("string")
        elif kind == "double":
            col = F.round(col, 6)
        shown.append(col.alias(field.name))
    return df.select(*shown)


def raw(spark, folder):
    return given.raw_events(spark, folder)


def base(spark, folder):
    return flatten.base_events(raw(spark, folder))


def scorer(spark):
    return sentiment.lexicon_scorer(given.lexicon(spark))


def events(spark, folder):
    return marts.staged_events(raw(spark, folder), scorer(spark))


def scored(spark, folder):
    return sentiment.posts(base(spark, folder), scorer(spark))


def opinion_rows(spark, folder):
    return marts.summary_input(events(spark, folder))


def summary(spark, folder):
    return stage(marts.post_summary(events(spark, folder)), "summary")


# --- sources and JSON -----------------------------------------------------------


@query
def raw_scan(spark, folder):
    path = staging_path(spark, "raw")
    raw_source.append_raw_events(raw(spark, folder), path)
    rows = raw_source.read_raw_events(spark, path)
    return rows.select("id", "event_time", F.get_json_object("raw_event", "$.text").alias("text"))


@query
def event_append(spark, folder):
    payload = given.read(spark, folder, "documents").select("doc_id", F.lit("message").alias("type"), "text", "lang")
    rows = raw_source.to_raw_events(payload, ingest_ts=INGESTED, id_cols=["doc_id"])
    field = {c: F.get_json_object("raw_event", f"$.{c}").alias(c) for c in ("type", "text", "lang")}
    return rows.select("id", "event_time", *field.values())


@query
def pack_json(spark, folder):
    rows = given.read(spark, folder, "documents")
    packed = raw_source.pack_json("doc_id", "text", "lang").alias("packed")
    return rows.select("doc_id", packed).select(
        "doc_id",
        F.get_json_object("packed", "$.text").alias("text"),
        F.get_json_object("packed", "$.doc_id").cast("long").alias("packed_id"),
    )


@query
def json_paths(spark, folder):
    return base(spark, folder).select(
        "id",
        "event_ts",
        "event_channel",
        "event_type",
        "event_user",
        "event_thread_ts",
        "team_id",
        "reaction",
        "bot_id",
        "reaction_item_channel",
        "reaction_item_ts",
        "reaction_item_type",
        "bot_profile_id",
        "bot_profile_updated",
    )


@query
def json_array_paths(spark, folder):
    return base(spark, folder).select(
        "id", "is_bot", "auth_team_id", "auth_user_id", "block_id", "block_text", "block_text_type", "blocks"
    )


@query
def malformed_events(spark, folder):
    rows = given.read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("event_time"), F.col("text").alias("raw_event")
    )
    good = given.read(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.lit(None).cast("timestamp").alias("event_time"), F.col("props").alias("raw_event")
    )
    return flatten.malformed(rows.unionByName(good)).select("id", "raw_event")


@query
def base_events(spark, folder):
    return base(spark, folder)


@query
def strip_prefix(spark, folder):
    return base(spark, folder).select("id", "event_text", "anonymous_feedback_text")


@query
def anonymise(spark, folder):
    rows = given.read(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("user"))
    return changes.anonymise(rows)


# --- typed subsets, threads and weights ------------------------------------------


@query
def posts(spark, folder):
    return scored(spark, folder)


@query
def replies(spark, folder):
    return flatten.replies(base(spark, folder))


@query
def reactions(spark, folder):
    return flatten.reactions(base(spark, folder))


@query
def thread_events(spark, folder):
    return marts.thread_reconstruction(events(spark, folder))


@query
def reply_counts(spark, folder):
    return threads.thread_reply_counts(flatten.replies(base(spark, folder)))


@query
def reaction_counts(spark, folder):
    return threads.thread_reaction_counts(flatten.reactions(base(spark, folder)))


@query
def weighted_posts(spark, folder):
    return marts.weighted_posts(events(spark, folder))


@query
def scoped_weights(spark, folder):
    rows = events(spark, folder)
    weighed = threads.weigh(rows.posts, rows.replies, rows.reactions, scope=["team_id"])
    return weighed.select("id", "num_replies", "num_reactions", "weight")


@query
def posts_with_weights(spark, folder):
    rows = events(spark, folder)
    weights = marts.weighted_posts(rows).select("post_id", "weight")
    joined = rows.posts.join(weights, F.col("id") == F.col("post_id"))
    return joined.select("id", "team_id", "event_text", "sentiment_score", "weight")


# --- weekly feedback --------------------------------------------------------------


@query
def drop_neutral(spark, folder):
    kept = weekly.drop_neutral(scored(spark, folder))
    return kept.select("id", "sentiment_score", feedback.sentiment_category(F.col("sentiment_score")).alias("category"))


@query
def week_labels(spark, folder):
    at = F.col("event_time")
    return raw(spark, folder).select(
        "id",
        "event_time",
        time.week_bucket(at).alias("bucket"),
        time.week_start(at).alias("feedback_start_date"),
        time.week_end(at).alias("feedback_end_date"),
    )


@query
def number_posts(spark, folder):
    rows = weekly.number_posts(opinion_rows(spark, folder))
    return rows.select("id", *weekly.GROUP, "post_number", "weighted_text")


@query
def number_posts_heavy_groups(spark, folder):
    rows = weekly.number_posts(opinion_rows(spark, folder), hot_rows=20)
    return rows.select("id", *weekly.GROUP, "post_number", "weighted_text")


@query
def weekly_feedback(spark, folder):
    rows = weekly.weekly_feedback(opinion_rows(spark, folder))
    texts = F.array_join("feedback_texts", "|").alias("feedback_texts")
    return rows.select(*weekly.GROUP, "part_no", "avg_sentiment_score", "number_of_posts", texts)


@query
def numbered_posts_string(spark, folder):
    rows = weekly.numbered_posts_string(weekly.weekly_feedback(opinion_rows(spark, folder)))
    return rows.select(*weekly.GROUP, "part_no", "numbered_posts_string")


@query
def text_parts_heavy_groups(spark, folder):
    """Texts cut every 2,000 characters, numbered by ranges."""
    rows = weekly.weekly_feedback(opinion_rows(spark, folder), hot_rows=20, part_chars=2_000)
    rows = weekly.numbered_posts_string(rows)
    return rows.select(*weekly.GROUP, "part_no", "avg_sentiment_score", "number_of_posts", "numbered_posts_string")


@query
def prompts(spark, folder):
    rows = weekly.numbered_posts_string(weekly.weekly_feedback(opinion_rows(spark, folder)))
    posts_text = F.col("numbered_posts_string")
    return rows.select(
        *weekly.GROUP,
        "part_no",
        text.summary_prompt(posts_text).alias("summary_prompt"),
        text.question_prompt(posts_text).alias("question_prompt"),
    )


@query
def extractive_summary(spark, folder):
    return summaries.extractive_summary(weekly.top_posts(opinion_rows(spark, folder)))


@query
def open_question(spark, folder):
    return summaries.open_question(weekly.top_posts(opinion_rows(spark, folder), 1))


def answered(rows):
    done = summaries.summarise_groups(rows, generator=lambda prompts: prompts.str.len().astype(str))
    return done.select(*weekly.GROUP, "part_no", "detailed_summary")


@query
def generated_summary(spark, folder):
    return answered(weekly.weekly_feedback(opinion_rows(spark, folder)))


@query
def generated_summary_parts(spark, folder):
    return answered(weekly.weekly_feedback(opinion_rows(spark, folder), part_chars=2_000))


@query
def resumed_summary(spark, folder):
    """Summaries of a model that failed on every second prompt, ended by another run with the same answers."""
    rows = weekly.weekly_feedback(opinion_rows(spark, folder))
    asked = stage(rows.select(*weekly.GROUP, F.array_join("numbered_posts", " ").alias("posts")), "prompts")
    book = answers.Answers(spark, staging_path(spark, "book"), "model")

    def failing(prompts):
        if len(prompts[0]) % 2:
            raise ValueError("no answer to prompts of odd length")
        return "first " + prompts.str.len().astype(str)

    try:
        answers.ask(asked, F.col("posts"), failing, "detailed_summary", book, batch=1, tries=1, keep=weekly.GROUP)
    except answers.Unanswered:
        pass
    second = lambda prompts: "second " + prompts.str.len().astype(str)
    return answers.ask(asked, F.col("posts"), second, "detailed_summary", book, keep=weekly.GROUP)


@query
def post_summary(spark, folder):
    return marts.post_summary(events(spark, folder))


@query
def post_summary_parts(spark, folder):
    """Groups in many parts: each carries the summary and question of its group."""
    return marts.post_summary(events(spark, folder), part_chars=2_000)


@query
def incremental_summary(spark, folder):
    emitted = spark.sql(f"SELECT DATE'{EMITTED_WEEK}' AS feedback_start_date")
    done = marts.post_summary(events(spark, folder), emitted, CLOSED_AT, "closed")
    return done.select("team_id", "sentiment_category", "feedback_start_date", "part_no", "numbered_weighted_posts")


@query
def emit_closed_weeks(spark, folder):
    rows = raw(spark, folder).select("id", time.week_start(F.col("event_time")).alias("feedback_start_date"))
    return incremental.emit_closed_weeks(rows, None, CLOSED_AT)


# --- read views -------------------------------------------------------------------


@query
def feedback_table(spark, folder):
    return views.feedback_table(summary(spark, folder))


@query
def full_refresh(spark, folder):
    path = staging_path(spark, "weighted")
    tables.write_full(marts.weighted_posts(events(spark, folder)), path)
    return tables.read_table(spark, path).select("post_id", "num_replies", "num_reactions", "weight")


@query
def json_export(spark, folder):
    path = staging_path(spark, "json")
    tables.export_json(views.feedback_table(summary(spark, folder)), path)
    schema = "part_no BIGINT, sentiment_category STRING, avg_sentiment_score DOUBLE, numbered_weighted_posts STRING"
    return spark.read.schema(f"{schema}, detailed_summary STRING, open_ended_question STRING").json(path)


@query
def sentiment_series(spark, folder):
    series = views.sentiment_series(scored(spark, folder))
    return series.withColumn("day", time.fmt_date(F.col("event_time"), "M/d/yyyy"))


@query
def sentiment_series_range(spark, folder):
    return views.sentiment_series(scored(spark, folder), range=(MID_MONTH, OVERLAP_END))


@query
def bot_post_counts(spark, folder):
    return views.bot_post_counts(flatten.post_rows(base(spark, folder)))


@query
def latest_summary(spark, folder):
    return views.latest_summary(summary(spark, folder), "negative", "EN")


@query
def latest_per_key(spark, folder):
    return views.latest_summaries(summary(spark, folder))


@query
def summary_message(spark, folder):
    return views.with_message(views.latest_summaries(summary(spark, folder))).select(
        "team_id", "sentiment_category", "message"
    )


@query
def weekly_digest(spark, folder):
    return views.weekly_digest(summary(spark, folder))


@query
def digest_deliveries(spark, folder):
    digest = views.weekly_digest(summary(spark, folder))
    return views.digest_deliveries(digest, given.members(spark, folder))


@query
def weekly_question(spark, folder):
    return views.weekly_question(summary(spark, folder))


@query
def date_formats(spark, folder):
    at = F.col("event_time")
    return raw(spark, folder).select(
        "id",
        time.fmt_date(at).alias("short_date"),
        time.fmt_date(at, "MM-dd-yyyy hh:mma").alias("clock"),
        time.iso_date(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso_date"),
    )


@query
def capitalise(spark, folder):
    rows = given.read(spark, folder, "events")
    return rows.select("event_id", text.capitalise(F.col("event_type")).alias("label"))


# --- events, changes and merges -----------------------------------------------------


def all_changes(spark, folder):
    return raw(spark, folder).unionByName(given.change_events(spark, folder))


@query
def route_events(spark, folder):
    stored, control = changes.route_events(all_changes(spark, folder))
    none = F.lit(None)
    kept = stored.select(F.lit("stored").alias("kind"), "id", "event_time", none.alias("target_ts"), none.alias("reaction"))
    return kept.unionByName(control.withColumn("id", none).drop("user"))


def doubtful_events(spark, folder):
    """Reactions whose item timestamp is a number, a word or missing."""
    rows = given.read(spark, folder, "events")
    stamp = F.when(F.col("event_type") == "click", F.col("value").cast("string")).when(
        F.col("event_type") != "view", F.col("event_type")
    )
    item = F.struct(stamp.alias("ts"))
    payload = raw_source.pack_json(
        F.lit("reaction_added").alias("type"), F.lit("1704067200.000000").alias("event_ts"), item.alias("item")
    )
    at = F.col("ts").cast("timestamp").alias("event_time")
    return rows.select(F.col("event_id").alias("id"), at, payload.alias("raw_event"))


@query
def split_valid(spark, folder):
    valid, rejected = changes.split_valid(doubtful_events(spark, folder))
    return valid.select("id", F.lit("valid").alias("verdict")).unionByName(
        rejected.select("id", F.lit("rejected").alias("verdict"))
    )


def every_kind_of_event(spark, folder):
    """Events to store, deletions, events without usable timestamps, and texts that are no JSON."""
    no_time = F.lit(None).cast("timestamp").alias("event_time")
    texts = given.read(spark, folder, "documents").select(F.col("doc_id").alias("id"), no_time, F.col("text").alias("raw_event"))
    return all_changes(spark, folder).unionByName(doubtful_events(spark, folder)).unionByName(texts)


@query
def event_verdicts(spark, folder):
    tagged = changes.tagged_events(every_kind_of_event(spark, folder))
    return tagged.select("tag", F.when(F.col("tag") != "control", F.col("id")).alias("id"))


@query
def ts_convert(spark, folder):
    stamp = F.coalesce("reaction_item_ts", "event_ts")
    return base(spark, folder).select(
        "id",
        time.is_valid_ts(stamp).alias("valid"),
        time.iso_text(stamp).alias("iso"),
        F.unix_micros(time.ts_to_timestamp(stamp)).alias("micros"),
    )


def control(spark, folder):
    return changes.route_events(given.change_events(spark, folder))[1]


@query
def message_deletes(spark, folder):
    return changes.apply_message_deletes(raw(spark, folder), control(spark, folder)).select("id")


@query
def reaction_removals(spark, folder):
    return changes.apply_reaction_removals(raw(spark, folder), control(spark, folder)).select("id")


@query
def reaction_removals_by_user(spark, folder):
    kept = changes.apply_reaction_removals(raw(spark, folder), control(spark, folder), match_user=True)
    return kept.select("id")


@query
def deletes_in_flat_tables(spark, folder):
    known = changes.removals(control(spark, folder))
    return changes.delete_flattened(base(spark, folder), known).select("id", "event_type")


@query
def deletes_hot_keys(spark, folder):
    """The same deletions through the shuffled join that splits hot keys."""
    known = replace(changes.removals(control(spark, folder)), small=False, hot_rows=2)
    return changes.delete_flattened(base(spark, folder), known).select("id", "event_type")


@query
def upsert(spark, folder):
    target = given.read(spark, folder, "labels")
    source = given.read(spark, folder, "documents").select(
        "doc_id", F.length("text").alias("quality"), F.lit(2).alias("toxic")
    )
    return changes.upsert(target, source, ["doc_id"], update_cols=["quality"])


@query
def update_columns(spark, folder):
    errors = given.read(spark, folder, "events").filter(F.col("event_type") == "error")
    source = errors.groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("toxic"))
    return changes.update_columns(given.read(spark, folder, "labels"), source, ["doc_id"], ["toxic"])


@query
def merge_incremental(spark, folder):
    rows = base(spark, folder).select("id", "event_time", "team_id")
    existing = rows.filter(F.col("event_time") < F.lit(OVERLAP_END).cast("timestamp"))
    incoming = rows.filter(F.col("event_time") >= F.lit(MID_MONTH).cast("timestamp"))
    incoming = incoming.withColumn("team_id", F.lower("team_id"))
    return incremental.merge_incremental(existing, incoming, ["id"])


@query
def sync_schema(spark, folder):
    incoming = given.read(spark, folder, "documents").select("doc_id", F.lit(1).alias("quality"), "lang")
    return incremental.sync_schema(given.read(spark, folder, "labels"), incoming)


@query
def incremental_base(spark, folder):
    rows = raw(spark, folder)
    first = stage(
        flatten.base_events(rows.filter(F.col("event_time") < F.lit(MID_MONTH).cast("timestamp"))), "first"
    )
    strict = incremental.newer_than(rows, first, "event_time", inclusive=False, keep_null=False)
    return first.unionByName(flatten.base_events(strict)).select("id", "event_time", "event_type", "team_id")


@query
def incremental_ties(spark, folder):
    """Two loads of events whose times are whole days or missing: ties with the mark lie in both."""
    at = F.when(F.col("id") % 7 > 0, F.date_trunc("day", "event_time"))
    rows = flatten.base_events(raw(spark, folder)).withColumn("event_time", at)
    early = (F.col("event_time") <= F.lit(MID_MONTH).cast("timestamp")) | F.col("event_time").isNull()
    first = stage(rows.filter(early & (F.col("id") % 2 == 0)), "first")
    done = incremental.merge_incremental(first, stage(incremental.newer_than(rows, first, "event_time"), "second"), ["id"])
    return done.select("id", "event_time", "event_type", "team_id")


@query
def high_water_mark(spark, folder):
    rows = given.read(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    mark = incremental.high_water_mark(rows, "at")
    return rows.filter(F.col("at") == mark)


@query
def pipeline_run(spark, folder):
    """Two runs of the incremental pipeline, deletes included."""
    store = pipeline.Store(spark, staging_path(spark, "store"))
    rows = raw(spark, folder)
    first = rows.filter(F.col("event_time") < F.lit(MID_MONTH).cast("timestamp"))
    pipeline.run_pipeline(store, first, scorer(spark))
    pipeline.run_pipeline(store, rows, scorer(spark), control(spark, folder))
    return store.read("posts").select("id", "event_text", "sentiment_score")


def length_scorer(rows):
    """A second model: a score from the length of the text."""
    return rows.withColumn("sentiment_score", F.pmod(F.length("event_text"), F.lit(201)) / 100 - 1)


@query
def rescored_posts(spark, folder):
    """All posts loaded with one model, then rescored week by week with another."""
    store = pipeline.Store(spark, staging_path(spark, "store"))
    pipeline.load_events(store, raw(spark, folder), scorer(spark), model="words")
    pipeline.rescore(store, length_scorer, "length")
    return store.read("posts").select("id", "sentiment_score")


# --- streaming and windows ------------------------------------------------------------


@query
def weekly_window(spark, folder):
    rows = base(spark, folder).groupBy(time.weekly_window(F.col("event_time")).alias("w"), "team_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("week"), "team_id", "n")


def feed(spark, folder, rows=all_changes) -> tuple[str, int]:
    """The raw events as a folder of files, for the file stream source, and a quarter of their number.

    A file is written by one task. There are four, or as many more as keep each to the events of
    ``FEED_BYTES`` of the tables; a batch takes quarters, so the batches stay as many.
    """
    path = staging_path(spark, "feed")
    quarter = max(1, -(-given.stored_bytes(spark, folder) // (4 * FEED_BYTES)))
    rows(spark, folder).repartition(4 * quarter).write.parquet(path)
    return path, quarter


@query
def stream_base(spark, folder):
    path, quarter = feed(spark, folder)
    out = feeds.stream_base(spark, path, staging_path(spark, "stream-base"), max_files=2 * quarter)
    return out.select("id", "event_time", "event_type", "event_text", "team_id", "reaction")


@query
def stream_changes(spark, folder):
    log = feeds.ChangeLog(spark, staging_path(spark, "change-log"))
    path, quarter = feed(spark, folder)
    feeds.stream_apply_changes(log, path, max_files=2 * quarter)
    return log.current().select("id", "event_time")


@query
def stream_event_verdicts(spark, folder):
    """The tables of the change log hold what came in, each event once."""
    path, quarter = feed(spark, folder, every_kind_of_event)
    log = feeds.ChangeLog(spark, staging_path(spark, "change-log"))
    feeds.stream_apply_changes(log, path, max_files=2 * quarter)
    none = F.lit(None).cast("long").alias("id")
    stored = log.stored().select(F.lit("store").alias("tag"), "id")
    control = log.control().select(F.lit("control").alias("tag"), none)
    return stored.unionByName(control).unionByName(log.dead().select("tag", "id"))


@query
def stream_dedup(spark, folder):
    path, quarter = feed(spark, folder)
    raw(spark, folder).repartition(2 * quarter).write.mode("append").parquet(path)
    out = feeds.stream_deduplicated(spark, path, staging_path(spark, "dedup"))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_weekly_sentiment(spark, folder):
    out = staging_path(spark, "stream-weekly")
    path, quarter = feed(spark, folder)
    done = feeds.stream_weekly_sentiment(spark, path, out, scorer(spark), max_files=2 * quarter)
    return done.select("feedback_start_date", "team_id", "sentiment_category", "avg_sentiment_score", "number_of_posts")


@query
def stream_late_rows(spark, folder):
    """Posts in time, as the stream counted them, and those in the log of late ones."""
    out = staging_path(spark, "stream-totals")
    path, quarter = feed(spark, folder)
    totals = feeds.stream_weekly_totals(spark, path, out, scorer(spark), delay="1 hour", max_files=quarter)
    category = feedback.sentiment_category(F.col("sentiment_score")).alias("sentiment_category")
    keys = ["feedback_start_date", "team_id", "sentiment_category"]
    late = totals.late().groupBy(time.week_start(F.col("event_time")).alias(keys[0]), "team_id", category).agg(F.count(F.lit(1)).alias("n"))
    both = totals.current().join(late, keys, "left")
    posts = F.col("number_of_posts") - F.col("late_posts") + F.coalesce("n", F.lit(0))
    return both.select(*keys, "avg_sentiment_score", posts.alias("number_of_posts"))


@query
def stream_closed_weeks(spark, folder):
    out = staging_path(spark, "stream-closed")
    path, _ = feed(spark, folder)
    done = feeds.stream_weekly_sentiment(spark, path, out, scorer(spark), delay="1 hour", closed_only=True)
    return done.select("feedback_start_date", "team_id", "sentiment_category", "avg_sentiment_score", "number_of_posts")


@query
def stream_thread_engagement(spark, folder):
    out = staging_path(spark, "stream-threads")
    path, quarter = feed(spark, folder)
    return feeds.stream_thread_engagement(spark, path, out, max_files=2 * quarter)


# --- text models -----------------------------------------------------------------------


@query
def lexicon_sentiment(spark, folder):
    docs = given.read(spark, folder, "documents").select("doc_id", "text")
    return sentiment.score_sentiment(docs, given.lexicon(spark), "text", "doc_id").drop("text")


@query
def remembered_sentiment(spark, folder):
    """Scores of all documents from the cache that a first pass filled; the second scorer finds none itself."""
    docs = given.read(spark, folder, "documents").select("doc_id", F.col("text").alias("event_text"))
    _, known = score_cache.cached_scores(docs, scorer(spark), None, "words", spread="doc_id")
    no_score = lambda rows: rows.withColumn("sentiment_score", F.lit(None).cast("double"))
    done, _ = score_cache.cached_scores(docs, no_score, known, "words", spread="doc_id")
    return done.select("doc_id", "sentiment_score")


def corpus_lexicon(spark, folder):
    """Every word of the conversations: good if users say it more than others do."""
    words = given.read(spark, folder, "conversations").select("role", F.explode(text.tokens(F.col("text"))).alias("token"))
    lead = F.sum(F.when(F.col("role") == "user", 1).otherwise(-1))
    return (
        words.filter(F.col("token") != "").groupBy("token").agg(F.when(lead > 0, 1).otherwise(-1).alias("polarity"))
    )


@query
def large_lexicon_sentiment(spark, folder):
    docs = given.read(spark, folder, "documents").select("doc_id", "text")
    done = sentiment.score_sentiment(docs, corpus_lexicon(spark, folder), "text", "doc_id")
    return done.select("doc_id", "sentiment_score")


@query
def function_sentiment(spark, folder):
    docs = given.read(spark, folder, "documents").select("doc_id", "text")

    def question_rate(texts):
        return (texts.str.count("and") - texts.str.count("the")) / 100.0

    return sentiment.score_with(docs, question_rate, "text").drop("text")


@query
def ml_sentiment(spark, folder):
    docs = given.read(spark, folder, "documents").select("doc_id", "text")
    labels = given.read(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model = sentiment.train_scorer(stage(docs.join(labels, "doc_id"), "labelled"))
    scored = stage(sentiment.model_score(docs, model).drop("text"), "scored")
    area = BinaryClassificationEvaluator(rawPredictionCol="sentiment_score", labelCol="label", metricName="areaUnderROC")
    better = area.evaluate(scored.join(labels, "doc_id").filter("label IS NOT NULL")) > 0.5
    in_range = F.coalesce(F.col("sentiment_score").between(-1, 1), F.lit(False)).alias("in_range")
    return scored.select("doc_id", in_range, F.lit(better).alias("auc_above_half"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
