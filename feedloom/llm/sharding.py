"""Balanced shards of linked documents by label propagation under capacity quotas."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gapless
from feedloom.session import stage

SHARDS = 8
ROUNDS = 12
# Rows of one group that a task numbers at a time; a larger group is numbered part by part.
GROUP_ROWS = 50_000
# A round that moves a smaller share of the linked documents is the last one.
SETTLED = 0.0005
# How far a shard may overfill while labels still move; the last step restores the law with whole groups.
SLACK = 0.1
LAW = "rows"


def capacities(total: int, shards: int) -> list[int]:
    """Rows of each shard: counts are at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def quotas(held: list[int], wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of the documents that may move, for each pair of shards (from, to).

    A shard takes in what it has room for and as much more as leaves it. The shares start
    at one and shrink where a shard would overflow, until none does.
    """
    share = dict.fromkeys(wants, 1.0)
    for _ in range(200):
        flow = {k: wants[k] * share[k] for k in wants}
        worst = 1.0
        for s in range(len(held)):
            inward = sum(v for (_, to), v in flow.items() if to == s)
            outward = sum(v for (origin, _), v in flow.items() if origin == s)
            free = max(0.0, room[s] - held[s] + outward)
            if inward > free + 1e-9:
                factor = free / inward
                worst = min(worst, factor)
                for k in wants:
                    if k[1] == s:
                        share[k] *= factor
        if worst > 0.9999:
            break
    return share


def _documents(docs: DataFrame) -> DataFrame:
    """Narrow rows: what a shard must know of a document, and the hash of its text as its group."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )


def _groups(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows with ``linked`` (their text comes again) and ``node``, the group they are linked in.

    Only a group that fits no shard is dealt over as many nodes as it needs. The rows of a
    node of more than ``GROUP_ROWS`` are dealt over ``parts`` for the work: ``large`` is
    the node (else 0) and ``part`` the row's part.
    """
    most = max(2, total // shards)
    sizes = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    fan = F.ceil(F.col("n") / most).cast("long")
    parts = F.ceil(F.col("n") / fan / GROUP_ROWS).cast("long")
    fans = sizes.select("text_hash", fan.alias("fan"), parts.alias("parts"))
    joined = rows.join(fans, "text_hash", "left")
    salt = F.when(F.col("fan") > 1, F.pmod(F.xxhash64("row"), "fan")).otherwise(F.lit(0))
    dealt = joined.select(*rows.columns, F.col("fan").isNotNull().alias("linked"), F.xxhash64("text_hash", salt).alias("node"), "parts")
    many = F.col("parts") > 1
    part = F.when(many, F.pmod(F.xxhash64("row", F.lit("part")), "parts")).otherwise(F.lit(0).cast("long"))
    large = F.when(many, F.col("node")).otherwise(F.lit(0).cast("long"))
    return dealt.withColumn("large", large).withColumn("part", part).withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def propagate(linked: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Moves linked rows (``row``, ``node``, ``large``, ``part``, ``parts``, ``shard``) towards the shard of most of their neighbours.

    One round: the neighbours of every node are counted by shard, each row is joined to its
    node's fullest shard, and of the rows that want from one shard to another a share moves
    that leaves no shard over its capacity. Nodes move as a whole, chosen by hash. Only
    counts between shards reach the driver.
    """
    shards = len(capacity)
    for turn in range(rounds):
        near = linked.groupBy("node", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
        ranked = F.struct("n", F.xxhash64("node", "shard").alias("tie"), "shard")
        aims = near.groupBy("node").agg(F.max(ranked).alias("top"), F.max("parts").alias("most"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("part")
        aimed = stage(linked.join(aims.select("node", every, F.col("top.shard").alias("aim")), ["node", "part"]), "aims")
        flows = {(r["shard"], r["aim"]): r["count"] for r in aimed.groupBy("shard", "aim").count().collect()}
        held = [sum(n for (origin, _), n in flows.items() if origin == s) for s in range(shards)]
        wants = {k: n for k, n in flows.items() if k[0] != k[1]}
        if sum(wants.values()) <= SETTLED * sum(held):
            break
        share = quotas(held, wants, capacity)
        if max(share.values()) < SETTLED:
            break
        grid = F.array(*[F.array(*[F.lit(share.get((a, b), 0.0)) for b in range(shards)]) for a in range(shards)])
        odds = grid[F.col("shard")][F.col("aim")]
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1_000_003)) / 1_000_003.0
        kept = ("row", "node", "large", "part", "parts")
        linked = aimed.select(*kept, F.when(draw < odds, F.col("aim")).otherwise(F.col("shard")).alias("shard"))
        linked = stage(linked, "labels")
    return linked


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard and slot of every document under the law ``rows``: counts are at most one apart.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not
    ``key``). Documents with equal texts are linked. They start in the shard of their row's
    hash and move by :func:`propagate`; what overflows its shard in the end, and every
    document without links, fills the places left, so the counts come out exactly. Slots
    run from 0 without gaps in every shard.

    A null text is an empty one of no bytes. Repeated rows are documents of their own; a
    null doc_id is kept. Other columns are ignored. An empty table gives no rows; fewer
    rows than shards leave shards empty.
    """
    rows = stage(_documents(docs), "documents")
    total = rows.count()
    capacity = capacities(total, shards)
    nodes = stage(_groups(rows, total, shards), "groups")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    linked = nodes.filter("linked").select("row", "node", "large", "part", "parts", start.alias("shard"))
    settled = propagate(linked, [math.ceil(c * (1 + SLACK)) for c in capacity], rounds)
    # Linked rows take the first places of their shard, node by node.
    placed = gapless(settled, "shard", ["node", "row"], F.col("node"), total, parts=["large", "part"])
    room = F.array(*[F.lit(c) for c in capacity])[F.col("shard")]
    placed = stage(placed.withColumn("stays", F.col("rank") < room), "placed")
    counted = {r["shard"]: r["count"] for r in placed.filter("stays").groupBy("shard").count().collect()}
    taken = [counted.get(s, 0) for s in range(shards)]
    # All others fill what is left, in one numbering by node that is cut at the shards' free places.
    single = nodes.filter("NOT linked").select("row", "node", "large", "part", F.lit(0).alias("pool"))
    over = placed.filter("NOT stays").select("row", "node", "large", "part", F.lit(0).alias("pool"))
    free = gapless(single.unionByName(over), "pool", ["node", "row"], F.col("node"), total, parts=["large", "part"])
    edges = [0, *accumulate(c - t for c, t in zip(capacity, taken, strict=True))]
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < edges[s + 1], F.lit(s)).otherwise(shard)
    shift = F.array(*[F.lit(int(t - e)) for t, e in zip(taken, edges, strict=False)])
    filled = free.select("row", shard.alias("shard"), "rank").select(
        "row", "shard", (F.col("rank") + shift[F.col("shard")]).alias("slot")
    )
    every = placed.filter("stays").select("row", "shard", F.col("rank").alias("slot")).unionByName(filled)
    return rows.join(every, "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
