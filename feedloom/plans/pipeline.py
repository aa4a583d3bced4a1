"""The incremental pipeline over stored, week-partitioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom import schemas
from feedloom.functions.text import strip_prefix
from feedloom.functions.time import week_start
from feedloom.operators.answers import Answers
from feedloom.operators.changes import Removals, delete_flattened, mark_flattened, removals
from feedloom.operators.flatten import base_events, post_rows, reactions, replies
from feedloom.operators.incremental import emit_closed_weeks, merge_incremental, newer_than, one_per_key, replaced_keys
from feedloom.operators.score_cache import CACHE_SCHEMA, cached_scores
from feedloom.operators.sentiment import posts
from feedloom.operators.skew import BROADCAST_IDS, HOT_ROWS, anti_join
from feedloom.plans.marts import Events, post_summary, thread_reconstruction, weighted_posts
from feedloom.session import scratch, stage
from feedloom.sources.snapshots import Snapshots, folder_of
from feedloom.sources.tables import partition_values, touched_partitions

WEEK = "week"
NO_TIME = "1970-01-01"


def _with_week(df: DataFrame) -> DataFrame:
    """Partition column: the feedback week, or a fixed day for rows without a time."""
    week = F.coalesce(week_start(F.col("event_time")), F.lit(NO_TIME).cast("date"))
    return df.withColumn(WEEK, week)


def _plain_text() -> Column:
    """``event_text``, as :func:`~feedloom.operators.flatten.base_events` cuts it out of the text with its marker."""
    return strip_prefix(F.col("anonymous_feedback_text"))


@dataclass(frozen=True)
class Purge:
    """The rows of one table that deletions take. Ids, where not NULL, are unique in it."""

    known: Removals
    weeks: list  # that lose rows
    lost: DataFrame | None  # ids of the rows lost, if there are too many deletions to look up in place
    loose: bool  # rows without an id are among them

    def apply(self, rows: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda moved: moved) -> DataFrame:
        """``rows`` without those lost.

        Ids are sent to the rows, those of messages, which hold the texts, apart from those of reactions if
        there are many. Only rows that too many ids would have to be sent to are moved; they pass through ``settle``.
        """
        if self.lost is None:
            return delete_flattened(rows, self.known)
        if self.loose:
            named = F.col("id").isNotNull()
            rows = rows.filter(named).unionByName(delete_flattened(rows.filter(~named), self.known))
        parts = [(rows, self.lost)]
        if "reaction" in rows.columns and not _few(self.lost):
            of_reaction, lost = F.col("reaction").isNotNull(), F.col("_of_reaction")
            parts = [(rows.filter(~of_reaction), self.lost.filter(~lost)), (rows.filter(of_reaction), self.lost.filter(lost))]
        kept = [anti_join(part, ids, ["id"], True) if _few(ids) else settle(anti_join(part, ids, ["id"])) for part, ids in parts]
        return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])


def _few(ids: DataFrame) -> bool:
    """Whether stored ids may be sent to every executor."""
    return ids.count() <= BROADCAST_IDS


def _purge(table: DataFrame | None, known: Removals) -> Purge | None:
    """What deletions take from a table, found on narrow columns; None if it loses no row."""
    if table is None:
        return None
    of_reaction = F.col("reaction").isNotNull() if "reaction" in table.columns else F.lit(False)
    found = mark_flattened(table, known).filter("_removed").select("id", WEEK, of_reaction.alias("_of_reaction"))
    lost = None if known.small else stage(found, "removed")
    loose = lost is not None and lost.filter(F.col("id").isNull()).limit(1).count() > 0
    weeks = partition_values(found if lost is None else lost, WEEK)
    return Purge(known, weeks, lost, loose) if weeks else None


class Store:
    """Versioned tables: base, posts, replies, reactions, control, scores, summary, threads and weighted.

    A store shows the version it was opened at, by default the last one, until
    :meth:`refresh`. Changes are made inside :meth:`change`; the store sees its own at once,
    others all together when the block ends. A block that fails leaves nothing behind, and
    tables staged inside one are dropped with it.

    The files of base hold a text once: their ``event_text`` is NULL where it follows from
    ``anonymous_feedback_text``, and :meth:`find` puts it back.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark = spark
        self.root = root
        self.snapshots = Snapshots(spark, root)
        self.refresh(version)

    def refresh(self, version: int | None = None) -> None:
        """Move to a version, by default the last one."""
        self.version = max(self.snapshots.versions(), default=0) if version is None else version
        self._folders = self.snapshots.manifest(self.version)

    @contextmanager
    def change(self) -> Iterator[None]:
        """Publish all that is changed inside as the next version."""
        before = dict(self._folders)
        try:
            with scratch(self.spark):
                yield
            if self._folders != before:
                self.snapshots.publish(self.version + 1, self._folders)
                self.version += 1
        except BaseException:
            self._folders = before
            raise

    def path(self, name: str) -> str:
        """Folder of a table that is written whole."""
        folders = self._folders.get(name, [])
        return f"{self.root}/data/{name}/{folders[0]}" if len(folders) == 1 else f"{self.root}/{name}"

    @cached_property
    def _schemas(self) -> dict[str, StructType]:
        base = base_events(self.spark.createDataFrame([], schemas.RAW_SCHEMA))
        scored = post_rows(base).withColumn("sentiment_score", F.lit(0.0)).select(*schemas.POST_COLUMNS)
        tables = {"base": base, "posts": scored, "replies": replies(base), "reactions": reactions(base)}
        known = {name: _with_week(df).schema for name, df in tables.items()}
        return {**known, "control": schemas.CONTROL_SCHEMA, "scores": StructType.fromDDL(CACHE_SCHEMA)}

    def find(self, name: str, schema: StructType | None = None) -> DataFrame | None:
        """The table, or None before its first write."""
        folders = self._folders.get(name)
        if folders is None:
            return None
        schema = self._schemas.get(name, schema)
        if schema is None:  # what the first folder holds, besides its own name
            found = self.spark.read.option("basePath", f"{self.root}/data/{name}").parquet(f"{self.root}/data/{name}/{folders[0]}")
            schema = found.drop("run").schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        table = self.snapshots.read(name, folders, schema)
        return table.withColumn("event_text", F.coalesce("event_text", _plain_text())) if name == "base" else table

    def read(self, name: str) -> DataFrame:
        """The table, empty before its first write."""
        table = self.find(name)
        return self.spark.createDataFrame([], self._schemas[name]) if table is None else table

    def events(self) -> Events:
        return Events(self.read("posts"), self.read("replies"), self.read("reactions"))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the whole table."""
        self._folders = {**self._folders, name: self.snapshots.write(name, rows)}

    def append(self, name: str, rows: DataFrame) -> None:
        self._folders = {**self._folders, name: self._folders.get(name, []) + self.snapshots.write(name, rows)}

    def replace(self, name: str, rows: DataFrame, partition: str, touched: list) -> None:
        """Let ``rows`` be all that the ``touched`` partitions hold."""
        if name == "base":
            rows = rows.withColumn("event_text", F.when(~F.col("event_text").eqNullSafe(_plain_text()), F.col("event_text")))
        new = self.snapshots.write(name, rows, partition)
        gone = {folder_of(partition, v) for v in touched} | {f.split("/")[-1] for f in new}
        kept = [f for f in self._folders.get(name, []) if f.split("/")[-1] not in gone]
        self._folders = {**self._folders, name: kept + new}

    def merge(self, name: str, incoming: DataFrame, keys: list[str], partition: str, purge: Purge | None = None) -> None:
        """Merge rows by key into new folders of the partitions that change, without the stored rows that ``purge`` takes.

        A partition is written once, whether it loses rows, receives some, or both.
        """
        existing = self.find(name, incoming.schema)
        if existing is None:
            self.replace(name, one_per_key(incoming, keys), partition, [])
            return
        replaced = replaced_keys(existing, incoming, keys, partition, stored=True)
        touched, inside = touched_partitions(incoming, replaced, partition, purge.weeks if purge else [])
        if touched:
            rows = existing.filter(inside)
            rows = rows if purge is None else purge.apply(rows)
            self.replace(name, merge_incremental(rows, incoming, keys, replaced), partition, touched)


def load_events(
    store: Store,
    raw: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    control: DataFrame | None = None,
    propagate_deletes: bool = True,
    match_user: bool = False,
    inclusive: bool = True,
    strict_null_hwm: bool = False,
    hot_rows: int = HOT_ROWS,
    model: str | None = None,
) -> None:
    """Bring base, posts, replies and reactions up to date with ``raw``, as one new version.

    Only rows from the base table's high-water mark on, and those without a time whose id
    is new, are parsed and scored; the merge by id takes each once. With ``inclusive`` off
    rows tied with the mark count as loaded. After a failure the store is as before
    and the run can be repeated. With the name of a ``model``, scores are remembered by text under it, and
    ``scorer`` sees only texts it has not scored; see :func:`rescore`. ``control`` deletes from the new rows
    and, unless ``propagate_deletes`` is off, from the tables loaded earlier.
    """
    with store.change():
        _load(store, raw, scorer, control, propagate_deletes, match_user, inclusive, strict_null_hwm, hot_rows, model)


def _not_loaded(raw: DataFrame, base: DataFrame | None, inclusive: bool, strict_null_hwm: bool) -> DataFrame:
    """Rows from the high-water mark on, and rows without a time whose id is not there yet."""
    if base is None or strict_null_hwm:
        return newer_than(raw, base, "event_time", strict_null_hwm, inclusive, keep_null=True)
    timed = newer_than(raw.filter(F.col("event_time").isNotNull()), base, "event_time", inclusive=inclusive, keep_null=False)
    loaded = base.filter(F.col(WEEK) == F.lit(NO_TIME).cast("date"))
    return timed.unionByName(anti_join(raw.filter(F.col("event_time").isNull()), loaded, ["id"]))


def _load(
    store: Store,
    raw: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    control: DataFrame | None = None,
    propagate_deletes: bool = True,
    match_user: bool = False,
    inclusive: bool = True,
    strict_null_hwm: bool = False,
    hot_rows: int = HOT_ROWS,
    model: str | None = None,
) -> None:
    known, purges = None, {}
    if control is not None:
        store.append("control", control.select(*schemas.CONTROL_SCHEMA.names))
    all_control = store.find("control")
    if all_control is not None:
        known = removals(all_control, match_user, hot_rows)
        if propagate_deletes and control is not None:
            purges = {name: _purge(store.find(name), known) for name in ("posts", "replies", "reactions", "base")}
    loaded, purge = store.find("base"), purges.get("base")
    fresh = _not_loaded(raw, loaded if purge is None else purge.apply(loaded), inclusive, strict_null_hwm)
    base = _fresh_base(fresh, known)
    scored = posts(base, _remembering(store, scorer, model))
    incoming = {
        # A first load reads ids and writes once, so the scorer runs once; a merge reads more often.
        "posts": scored if store.find("posts") is None else stage(scored, "posts"),
        "replies": replies(base),
        "reactions": reactions(base),
        "base": base.select(*schemas.BASE_COLUMNS),
    }
    for name, rows in incoming.items():
        store.merge(name, _with_week(rows), ["id"], WEEK, purges.get(name))


def _fresh_base(raw: DataFrame, known: Removals | None) -> DataFrame:
    """Parsed rows, staged, one for each id and without those that are deleted already.

    The text is staged with its marker only, as the one without is cut out of it.
    """
    parsed = _with_week(base_events(raw))

    def slim(rows: DataFrame) -> DataFrame:
        return rows.drop("event_text")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_text", _plain_text()).select(*parsed.columns)

    with scratch(raw.sparkSession) as own:
        fresh = stage(slim(parsed), "fresh")
        every = whole(fresh)
        once = one_per_key(every, ["id"])
        if once is not every:  # else nothing is shuffled to read it again
            fresh = stage(slim(once), "base")
        own.keep(fresh)
    if known is None:
        return whole(fresh)
    if known.small:
        return whole(delete_flattened(fresh, known))
    purge = _purge(fresh, known)
    return whole(fresh if purge is None else purge.apply(fresh, lambda moved: stage(moved, "base")))


def _remembering(store: Store, scorer: Callable[[DataFrame], DataFrame], model: str | None) -> Callable[[DataFrame], DataFrame]:
    """``scorer`` for texts without a score by ``model``, adding what it finds to the store."""
    if model is None:
        return scorer

    def scored(rows: DataFrame) -> DataFrame:
        done, fresh = cached_scores(rows, scorer, store.find("scores"), model)
        if fresh.limit(1).count():
            store.append("scores", fresh)
        return done

    return scored


def rescore(store: Store, scorer: Callable[[DataFrame], DataFrame], model: str) -> int:
    """Give all stored posts the scores of ``model``, week by week; returns how many weeks changed.

    Each week is one new version, so a run that dies can be repeated and goes on where it
    stopped: texts that ``model`` has scored are not scored again, and weeks whose posts have its scores
    are not written. Summaries emitted before stay as they are.
    """
    table = store.find("posts")
    if table is None:
        return 0
    changed = 0
    for (week,) in sorted(table.select(WEEK).distinct().collect()):
        with store.change():
            rows = store.read("posts").filter(F.col(WEEK) == F.lit(week))
            # The scores are stored, so the check reads just these and the posts are written once.
            done = _remembering(store, scorer, model)(rows.withColumnRenamed("sentiment_score", "_before"))
            if done.filter(~F.col("sentiment_score").eqNullSafe(F.col("_before"))).limit(1).count():
                store.replace("posts", done.select(*rows.columns), WEEK, [week])
                changed += 1
    return changed


def compact_scores(store: Store, models: list[str] | None = None) -> None:
    """Write the remembered scores as one folder, as a new version; with ``models`` only theirs are kept."""
    table = store.find("scores")
    if table is not None:
        with store.change():
            kept = table if models is None else table.filter(F.col("model").isin(models))
            store.write("scores", kept)


def emit_summaries(
    store: Store,
    now: str | None = None,
    mode: str = "closed",
    generator: Callable | None = None,
    hot_rows: int = HOT_ROWS,
    generator_model: str | None = None,
) -> DataFrame | None:
    """Summarise the weeks due and add them to the summary table, as one new version.

    The posts of weeks that are not due are pruned by partition before weights
    are computed. Returns the whole summary table. With a ``generator_model`` the answers of ``generator`` are
    kept under that name beside the versions: a run repeated after a failure asks only what is not answered.
    """
    with store.change():
        _emit(store, now, mode, generator, hot_rows, generator_model)
    return store.find("summary")


def _emit(store: Store, now: str | None, mode: str, generator: Callable | None, hot_rows: int, model: str | None) -> None:
    book = Answers(store.spark, f"{store.root}/answers", model) if model else None
    emitted = store.find("summary")
    events = store.events()
    due = emit_closed_weeks(events.posts.withColumn("feedback_start_date", F.col(WEEK)), emitted, now, mode)
    with scratch(store.spark) as own:
        fresh = post_summary(Events(due, events.replies, events.reactions), generator=generator, hot_rows=hot_rows, book=book)
        fresh = own.keep(stage(fresh, "summary"))
    store.merge("summary", fresh, ["team_id", "sentiment_category", "feedback_start_date", "part_no"], "feedback_start_date")


def run_pipeline(
    store: Store,
    raw: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    control: DataFrame | None = None,
    now: str | None = None,
    mode: str = "closed",
    generator: Callable | None = None,
    generator_model: str | None = None,
    **load_options,
) -> DataFrame | None:
    """One run, from raw events to newly emitted summaries, published as one version."""
    with store.change():
        with scratch(store.spark):
            _load(store, raw, scorer, control, **load_options)
        _emit(store, now, mode, generator, load_options.get("hot_rows", HOT_ROWS), generator_model)
    return store.find("summary")


def refresh_marts(store: Store, hot_rows: int = HOT_ROWS) -> None:
    """Rebuild the thread and weight tables in full, as one new version."""
    events = store.events()
    with store.change():
        store.write("threads", thread_reconstruction(events))
        store.write("weighted", weighted_posts(events, hot_rows))
