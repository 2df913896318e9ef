"""From questions to contexts: answers by meaning, staleness verdicts, the newest of the relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import search_text
from ..sources.scratch import Scratch
from . import history, retrieval
from .store import Store


def searchable(store: Store, tiers: DataFrame | None = None, include_cold: bool = False, include_superseded: bool = False) -> DataFrame:
    """What retrieval reads of a store's memories; tiers: (id, tier), short where it says nothing."""
    m = store.current()
    m = m.join(tiers, "id", "left") if tiers is not None else m.withColumn("tier", F.lit(None).cast("string"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return m.select(
        "id", search_text(F.col("task"), F.col("digest"), F.col("observation")).alias("text"), "vec", "ts", F.coalesce("tier", F.lit("short")).alias("tier"),
        F.length(F.coalesce("digest", "observation")).alias("body_length"), (some("anchors") | some("related_nodes")).alias("anchored"),
        retrieval.visible(F.col("cold"), F.col("superseded_by"), include_cold, include_superseded).alias("visible"),
    )


def store_verdicts(store: Store, changes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Staleness of every current memory, or of those named (id), against a change feed; as of its time or its last verification."""
    m = store.current() if only is None else store.current().join(only, "id", "left_semi")
    anchors = m.select("id", F.explode("anchors").alias("a")).select("id", "a.path")
    closure = history.path_closure(anchors.select("path"), history.rename_map(changes))
    return history.verdicts(anchors, m.select("id", F.greatest("ts", "verified_at").alias("as_of"), "suspect", "suspect_reason"), changes, closure)


def mark_suspects(store: Store, changes: DataFrame) -> dict[str, int]:
    """Notes a suspicion for each head that newer changes touch; counts of changed paths, of heads on them, and of those marked."""
    feed = Scratch(store.spark, "suspects")
    changes = feed.keep(changes, "changes")
    paths = feed.keep(history.changed_paths(changes), "paths")
    heads = store.current().where("superseded_by is null")
    candidates = feed.keep(history.on_paths(heads, history.earlier_names(paths, history.rename_map(changes))).select("id"), "candidates")
    found = feed.keep(store_verdicts(store, changes, candidates).where("possibly_stale and n_changes > 0").select("id", F.lit("suspect").alias("kind"), F.col("reason").alias("text")), "found")
    n = found.count()
    if n:
        store.note(found)
    return {"changed_paths": paths.count(), "candidates": candidates.count(), "marked": n}


def build_context(answers: DataFrame, memories: DataFrame, verdicts: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(qid, place, id, ...): the answers (qid, id, rank) within `most` by rank, then newest first; verdicts join by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("ts"), F.asc("id"))
    rows = answers.where(F.col("rank") <= most).select("qid", "id").join(memories, "id").withColumn("place", F.row_number().over(order))
    return rows if verdicts is None else rows.join(verdicts.select("id", "possibly_stale", "reason"), "id", "left")


def read_accesses(answers: DataFrame, sessions: DataFrame, at) -> DataFrame:
    """The access log's rows (id, session, ts) of the answers (qid, id) given in a named session (qid, session); without one, none."""
    return answers.join(sessions.where("session is not null"), "qid").select("id", "session", at.alias("ts"))


def run_pipeline(store: Store, questions: DataFrame, changes: DataFrame | None = None, limit: int = 20, most: int = 10, **options) -> DataFrame:
    """Contexts of all questions (qid, question, vec); without a change feed there are no verdicts, the answers stay."""
    answers = retrieval.by_meaning(questions, searchable(store), limit=min(limit, most), **options)
    memories = store.current().select("id", "task", "result", "lessons", "ts")
    return build_context(answers, memories, advisory_verdicts(store, changes), most)


def advisory_verdicts(store: Store, changes: DataFrame | None) -> DataFrame | None:
    """Verdicts, or none where the change feed can't be read: staleness advises, it never keeps an answer back."""
    if changes is None:
        return None
    try:
        feed = Scratch(store.spark, "feed").keep(changes, "changes")
    except Exception:  # noqa: BLE001 - whatever fails in reading the history
        return None
    return store_verdicts(store, feed)
