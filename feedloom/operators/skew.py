"""Joins that stay balanced when a few keys, or NULL, hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import stage

# Rows of one key that a single task may hold.
HOT_ROWS = 500_000
# Counters of a sketch for each key that may be heavy.
SKETCH_ROOM = 16
# Tasks over which one key's rows go where its heavy keys are too many to be sent everywhere.
SPREAD = 64
# Rows of a narrow lookup table that may be sent to every executor.
BROADCAST_ROWS = 200_000
# Ids that may be sent to every executor: 64 MB or so as a hash table.
BROADCAST_IDS = 1_000_000
# Bytes of a table of any width that may be broadcast.
BROADCAST_BYTES = 64 << 20


def any_null(keys: Sequence[str]) -> Column:
    test = F.col(keys[0]).isNull()
    for key in keys[1:]:
        test = test | F.col(key).isNull()
    return test


def _fused(keys: Sequence[str]) -> Column:
    """Join key as one string; a single key keeps its own value.

    Several keys are written with their lengths, so different keys never collide.
    """
    texts = [F.col(k).cast("string") for k in keys]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*[part for t in texts for part in (F.length(t).cast("string"), F.lit(":"), t)])


def heavy_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """``key`` and its number of ``rows``, for every key of more than ``limit`` rows.

    A count-min sketch comes first: keys are hashed twice to a table of counters, combined
    in each map task before the shuffle. A key is a candidate if both its counters pass
    ``limit``. Counters are never too low, so no heavy key is missed, whatever the size of
    the table; only candidates are then counted exactly. The sketch grows with rows /
    ``limit``, so that heavy keys fill counters and chance does not, and at most
    2 * rows / ``limit`` of them are full. NULL is no key.
    """
    keyed = df.select(key).filter(F.col(key).isNotNull())
    total = keyed.count()
    if total <= limit:
        return keyed.limit(0).withColumn("rows", F.lit(0).cast("long"))
    slots = 1 << max(10, (SKETCH_ROOM * total // limit).bit_length())
    hashed = [F.pmod(F.xxhash64(F.col(key), F.lit(n)), F.lit(slots)) for n in (0, 1)]
    marked = keyed.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), h.alias("slot")) for n, h in enumerate(hashed)])).alias("c"))
    full = stage(marked.groupBy("c.n", "c.slot").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > limit).select("n", "slot"), "sketch")
    if not full.limit(1).count():
        return keyed.limit(0).withColumn("rows", F.lit(0).cast("long"))
    suspects = keyed
    if small_enough(full):  # otherwise all keys are counted: each is one row per map task
        for n, h in enumerate(hashed):
            side = full.filter(F.col("n") == n).select(F.col("slot").alias("_slot"))
            suspects = suspects.withColumn("_slot", h).join(F.broadcast(side), "_slot", "left_semi").drop("_slot")
    return stage(suspects.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit), "heavy")


def _fanned(keyed: DataFrame, fan: DataFrame, spread: str) -> DataFrame:
    """``keyed`` with the ``_fan`` of its heavy keys; too many of these for a broadcast are met over spread rows."""
    if small_enough(fan):
        return keyed.join(F.broadcast(fan), F.col("_key") == F.col("_hot"), "left")
    copies = fan.withColumn("_there", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = keyed.withColumn("_here", F.pmod(F.xxhash64(F.col(spread)), F.lit(SPREAD)))
    return rows.join(copies, (F.col("_key") == F.col("_hot")) & (F.col("_here") == F.col("_there")), "left")


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a narrow table may be broadcast; reads at most ``limit`` + 1 rows."""
    return df.limit(limit + 1).count() <= limit


def broadcastable(df: DataFrame, keys: Sequence[str], limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table of any width may be broadcast: few rows, counted on ``keys`` alone, and few bytes.

    Texts count with their bytes, nested values with those of their JSON, all else with eight.
    The bytes of up to ``limit`` rows are added up in the tasks that read them.
    """
    if not small_enough(df.select(*keys), limit):
        return False
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("array", "map", "struct", "variant"):
            wide = F.octet_length(F.to_json(F.struct(col)))
        elif kind in ("string", "binary", "varchar", "char"):
            wide = F.octet_length(col)
        else:
            wide = F.lit(8)
        total = total + F.coalesce(wide, F.lit(0)).cast("long")
    return (df.agg(F.sum(total)).first()[0] or 0) <= size


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: str = "id",
    hot_rows: int = HOT_ROWS,
    small_right: bool = False,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Left or inner equi-join with a right side that is unique on ``on``.

    A right side known to be small (see :func:`small_enough`) is broadcast and
    the left side is not shuffled. Otherwise both are shuffled. Left rows with a
    NULL key cannot match; each gets a key of its own so that they spread over
    all tasks. A left key with too many rows is split over salts, and its single
    right row is repeated once per salt. ``spread`` is a left column that varies
    between the rows of one key. Heavy keys are counted on ``narrow``, where the caller has stored
    the key columns of ``left`` on their own, so that ``left`` is read only by the join.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    on = list(on)
    extra = [c for c in right.columns if c not in on]
    if small_right:
        return left.join(F.broadcast(right), on, how).select(*left.columns, *extra)
    # NULL-key rows get a filler that spreads them; `_ok` keeps it from matching.
    filler = F.coalesce(F.col(spread).cast("string"), F.lit(""))
    keyed = left.withColumn("_ok", ~any_null(on)).withColumn("_key", F.when(F.col("_ok"), _fused(on)).otherwise(filler))
    lookup = right.filter(~any_null(on)).select(_fused(on).alias("_right"), *extra)
    match = (F.col("_key") == F.col("_right")) & F.col("_ok")

    known = keyed if narrow is None else narrow.withColumns({"_ok": ~any_null(on), "_key": _fused(on)})
    hot = heavy_keys(known.filter("_ok"), "_key", hot_rows)
    if not hot.limit(1).count():
        return keyed.join(lookup, match, how).select(*left.columns, *extra)

    fan = hot.select(F.col("_key").alias("_hot"), F.ceil(F.col("rows") / hot_rows).cast("long").alias("_fan"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("_fan")), F.lit(0))
    salted = _fanned(keyed, fan, spread).withColumn("_salt", salt)
    repeats = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_fan"), F.lit(1)) - 1)
    repeated = lookup.join(fan, F.col("_right") == F.col("_hot"), "left").select(
        "_right", *extra, F.explode(repeats).alias("_copy")
    )
    return salted.join(repeated, match & (F.col("_salt") == F.col("_copy")), how).select(*left.columns, *extra)


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str], small_right: bool = False) -> DataFrame:
    """Rows of ``left`` without a partner; NULL-key rows never match and skip the shuffle.

    A right side known to be small is broadcast, and no row of ``left`` is shuffled.
    """
    keys = list(keys)
    partners = right.select(*keys).filter(~any_null(keys)).distinct()
    if small_right:
        return left.join(F.broadcast(partners), keys, "left_anti")
    kept = left.filter(~any_null(keys)).join(partners, keys, "left_anti")
    return kept.unionByName(left.filter(any_null(keys)).select(*kept.columns))
