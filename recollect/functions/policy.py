"""The tier policy as one CASE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import IDLE_DAYS


# Credits that promote to mid and to long, rejections that demote.
PROMOTE, SUSTAIN, REJECT = 1, 2, 3
DOWN = {"short": "short", "mid": "short", "long": "mid"}


def next_tier(tier: str, credit: int, rejected: int) -> str:
    """tier_decision()'s tier for one memory that is not idle, for ordered folds; a test holds the two against each other."""
    if tier == "short" and credit >= PROMOTE:
        return "mid"
    if tier == "mid" and credit >= SUSTAIN:
        return "long"
    return DOWN[tier] if rejected >= REJECT else tier


def tier_decision(tier: Column, credit: Column, rejected: Column, idle_days: Column, promote: int = PROMOTE, sustain: int = SUSTAIN, reject: int = REJECT) -> Column:
    """(tier, reason) after one pass: one step at most, promotion before idleness before rejection."""
    limit = F.lit(None).cast("double")
    for name, days in IDLE_DAYS.items():
        limit = F.when(tier == name, float(days)).otherwise(limit)
    down = F.when(tier == "long", "mid").otherwise("short")
    to = lambda t, why: F.struct(t.alias("tier"), F.lit(why).alias("reason"))
    return (
        F.when((tier == "short") & (credit >= promote), to(F.lit("mid"), "promoted_distinct_session"))
        .when((tier == "mid") & (credit >= sustain), to(F.lit("long"), "promoted_sustained"))
        .when((idle_days > limit) & (tier == "short"), to(tier, "gc_candidate"))
        .when(idle_days > limit, to(down, "demoted_idle"))
        .when((rejected >= reject) & (tier != "short"), to(down, "demoted_rejected"))
        .otherwise(to(tier, "unchanged"))
    )
