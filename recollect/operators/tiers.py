"""Accesses, settlements and tiers as aggregates over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.constants import TIERS
from ..functions.policy import next_tier, tier_decision


def accesses(log: DataFrame, writers: DataFrame | None = None) -> DataFrame:
    """One row for each (id, session) of the access log (id, session, ts): hits, first and last seen, outcome self where the session wrote the memory."""
    rows = log.groupBy("id", "session").agg(F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    if writers is None:
        return rows.withColumn("outcome", F.lit("provisional"))
    own = writers.select("id", F.col("session").alias("writer"))
    return rows.join(own, "id", "left").withColumn("outcome", F.when(F.col("session").eqNullSafe(F.col("writer")), "self").otherwise("provisional")).drop("writer")


def settle(rows: DataFrame, settles: DataFrame, used: DataFrame) -> DataFrame:
    """Provisional accesses of settled sessions (session, outcome, settled_at, settle_seq): rejected all, or confirmed where used (id, session), else unused; others stay."""
    u = used.select("id", "session").distinct().withColumn("used", F.lit(True))
    joined = rows.drop("settled_at", "settle_seq").join(settles.withColumnRenamed("outcome", "verdict"), "session", "left").join(u, ["id", "session"], "left")
    fresh = F.when((F.col("outcome") != "provisional") | F.col("verdict").isNull(), F.col("outcome")).when(F.col("verdict") == "rejected", "rejected").when(F.col("used"), "confirmed").otherwise("unused")
    return joined.select("id", "session", "hits", "first_seen", "last_seen", fresh.alias("outcome"), F.when(fresh != "provisional", F.col("settled_at")).alias("settled_at"), F.when(fresh != "provisional", F.col("settle_seq")).alias("settle_seq"))


def tier_states(memories: DataFrame, rows: DataFrame, window_start) -> DataFrame:
    """Counts that the policy reads, in one aggregation; memories: (id, tier, created_at, tier_changed_at, credit_watermark, cold)."""
    keys = ["id", "tier", "created_at", "tier_changed_at", "credit_watermark", "cold"]
    confirmed = F.col("outcome") == "confirmed"
    last = rows.where(confirmed).groupBy("id").agg(F.max("settled_at").alias("last_confirmed"))
    joined = memories.select(*keys).join(rows, "id", "left").join(last, "id", "left")
    credit = confirmed & (F.col("settle_seq") > F.col("credit_watermark")) & (F.col("settled_at") >= F.lit(window_start))
    rejected = (F.col("outcome") == "rejected") & (F.col("settled_at") > F.greatest("tier_changed_at", "last_confirmed"))
    return joined.groupBy(*keys).agg(
        F.count_if(confirmed).alias("confirmed_sessions"),
        F.count_if(credit).alias("promotion_credit"),
        F.coalesce(F.max(F.when(credit, F.col("settle_seq"))), F.first("credit_watermark")).alias("credit_seq"),
        F.count_if(rejected).alias("rejected_since"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("access_count"),
        F.max("last_seen").alias("last_accessed"),
    )


def decide(states: DataFrame, now, day) -> DataFrame:
    """states with new_tier and reason; idle days count from the last access, else from the memory's own time."""
    idle = (F.lit(now) - F.coalesce("last_accessed", "created_at")) / F.lit(day)
    d = tier_decision(F.col("tier"), F.col("promotion_credit"), F.col("rejected_since"), idle)
    return states.withColumn("d", d).withColumn("new_tier", F.col("d.tier")).withColumn("reason", F.col("d.reason")).drop("d")


def tier_changes(decided: DataFrame, now) -> DataFrame:
    """(id, tier, reason, tier_changed_at, credit_watermark) of the memories that change their tier; a watermark never goes back."""
    return decided.where(~F.col("new_tier").eqNullSafe(F.col("tier"))).select("id", F.col("new_tier").alias("tier"), "reason", F.lit(now).alias("tier_changed_at"), F.greatest("credit_watermark", "credit_seq").alias("credit_watermark"))


def apply_tier_changes(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories (id, tier, tier_changed_at, credit_watermark, ...) with the changes of those whose tier differs; the rest as they are."""
    new = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in ("tier", "tier_changed_at", "credit_watermark")))
    joined = memories.join(new, "id", "left")
    differs = F.col("new_tier").isNotNull() & ~F.col("new_tier").eqNullSafe(F.col("tier"))
    value = {"tier": F.col("new_tier"), "tier_changed_at": F.col("new_tier_changed_at"), "credit_watermark": F.greatest("credit_watermark", "new_credit_watermark")}
    return joined.select(*(F.when(differs, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in memories.columns))


def touched_by(rows: DataFrame, settles: DataFrame) -> DataFrame:
    """(id) of the memories that still had a provisional access in a settled session: those that a settlement decides on."""
    return rows.where("outcome = 'provisional'").join(settles.select("session").distinct(), "session", "left_semi").select("id").distinct()


def idle_candidates(states: DataFrame, cutoff, limit: int = 1000) -> DataFrame:
    """Short-term memories that are not cold and that nobody has read since the cutoff, or since they could be read."""
    since = F.coalesce("last_accessed", "tier_changed_at")
    return states.where((F.col("tier") == "short") & ~F.col("cold") & (since < F.lit(cutoff))).select("id", since.alias("idle_since")).orderBy("idle_since", "id").limit(limit)


def histogram(memories: DataFrame) -> DataFrame:
    """(tier, n): how many memories each tier holds, tiers without any included."""
    domain = memories.sparkSession.createDataFrame([(x,) for x in TIERS], "tier string")
    return domain.join(memories.groupBy("tier").agg(F.count("*").alias("c")), "tier", "left").select("tier", F.coalesce("c", F.lit(0)).alias("n"))


def _fold(strategy: str):
    def run(key: tuple, rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        tier, credit, rejected, total = "short", 0, 0, 0
        for outcome, relied in rows.sort_values("seq")[["outcome", "relied"]].itertuples(index=False):
            counts = strategy == "raw" or (outcome == "confirmed" and (strategy == "broad" or relied))
            if counts:
                credit, rejected, total = credit + 1, 0, total + 1
            elif strategy != "raw" and outcome == "rejected":
                rejected += 1
            after = next_tier(tier, credit, rejected)
            if after != tier:
                tier, credit, rejected = after, 0, 0
        return pd.DataFrame({"id": [key[0]], "tier": [tier], "credit": [total]})

    return run


def replay_strategy(events: DataFrame, strategy: str) -> DataFrame:
    """(id, tier, credit) after an ordered fold of each memory's sessions (id, seq, outcome, relied): a decision after every settlement, one step each."""
    return events.groupBy("id").applyInPandas(_fold(strategy), "id string, tier string, credit long")
