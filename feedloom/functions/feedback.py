"""Scalars of the feedback model: thread keys, weights and sentiment classes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of one reply and one reaction, and the neutral band.
REPLY_WEIGHT = Decimal("0.5")
REACTION_WEIGHT = Decimal("0.1")
NEUTRAL_BAND = 0.10


def thread_id(ts: Column, *scope: Column) -> Column:
    """Hash of the root timestamp text; NULL stays NULL.

    ``scope`` columns keep equal timestamps of different teams or channels apart.
    """
    if not scope:
        return F.md5(ts)
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in scope]
    return F.md5(F.concat(ts, *[F.concat(F.lit("\u0001"), p) for p in parts]))


def is_bot_post(bot_id: Column) -> Column:
    return bot_id.isNotNull()


def engagement_weight(
    replies: Column,
    reactions: Column,
    w_reply: Decimal = REPLY_WEIGHT,
    w_reaction: Decimal = REACTION_WEIGHT,
) -> Column:
    """One for the post itself plus its weighted replies and reactions.

    Decimal arithmetic: the value is printed into the numbered text, where
    a double would show rounding noise.
    """
    zero = F.lit(0)
    return (
        F.lit(1)
        + F.coalesce(replies, zero) * F.lit(w_reply)
        + F.coalesce(reactions, zero) * F.lit(w_reaction)
    )


def sentiment_category(score: Column, band: float = NEUTRAL_BAND) -> Column:
    return F.when(score >= F.lit(band), "positive").otherwise("negative")


def is_opinionated(score: Column, band: float = NEUTRAL_BAND) -> Column:
    """Score outside the open neutral band; both edges count as opinions."""
    return (score <= F.lit(-band)) | (score >= F.lit(band))
