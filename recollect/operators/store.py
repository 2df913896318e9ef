"""Memories as append-only logs and their projection: nothing is updated in place."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.scratch import Scratch
from .commits import Commits, Conflict

EXPERIENCE = "id string, task string, observation string, digest string, hypothesis string, action string, result string, lessons array<string>, related_nodes array<string>, anchors array<struct<path:string,symbol:string>>, confidence double, ts timestamp, writer_session string"
NOTE = "seq long, id string, kind string, text string, at timestamp, vec array<float>"
# Event names that a replay skips, and those that it applies.
RETIRED = ["CodeChanged", "SymbolAdded", "SymbolRemoved", "RelationAdded", "RelationInvalidated", "InvariantLearned", "DecisionRecorded", "ExperiencePromoted"]
APPLIED = ["ExperienceRecorded", "ExperienceSuperseded"]


def to_utc_ms(text: Column) -> Column:
    """Any ISO-8601 offset as UTC, cut to milliseconds; what can't be read is an error."""
    return F.date_trunc("millisecond", F.to_timestamp(text))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


class Store:
    """A folder with two logs: facts (memories, never changed) and notes (what is learnt about them).

    Notes of kind digest, embedding, suspect, clear, verified, superseded, cold are ordered by seq; the latest of a
    kind wins. What is written inside together() becomes visible at once when it ends, to the store itself before;
    any other write is a commit of its own. Several writers may share a folder: numbers follow the state that a commit
    is based on, and who comes second starts again (see commits).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, Commits(spark, path)
        self._open: tuple[int, dict[str, list[str]], set[str]] | None = None

    @contextlib.contextmanager
    def together(self):
        """All writes within as one commit; an error commits none of them. Inside another one it adds to that."""
        if self._open is not None:
            yield
            return
        self._open = (self.log.latest(), {}, set())
        try:
            yield
            base, added, replaced = self._open
            if added or replaced:
                self.log.commit(base, added, replaced)
        finally:
            self._open = None

    def committed(self, write: Callable[[], Any], tries: int = 20) -> Any:
        """write(), with all that it writes as one commit, done anew where another writer came first."""
        if self._open is not None:
            return write()
        for left in reversed(range(tries)):
            try:
                with self.together():
                    return write()
            except Conflict:
                if not left:
                    raise

    def _folders(self, name: str) -> list[str]:
        if self._open is None:
            return self.log.tables().get(name, [])
        base, added, replaced = self._open
        return ([] if name in replaced else self.log.tables(base).get(name, [])) + added.get(name, [])

    def _exists(self, name: str) -> bool:
        return bool(self._folders(name))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.log.read(self._folders(name), schema)

    def _put(self, name: str, rows: DataFrame, replace: bool = False) -> None:
        """Add rows to a table, or make them all that it holds."""
        if self._open is None:
            raise RuntimeError("written outside of a commit")
        base, added, replaced = self._open
        folder = self.log.stage(name, rows)
        if replace:
            replaced.add(name)
            added[name] = []
        added.setdefault(name, []).append(folder)

    def _scratch(self, name: str) -> Scratch:
        return Scratch(self.spark, name)

    def facts(self) -> DataFrame:
        return self._read("facts", EXPERIENCE)

    def notes(self) -> DataFrame:
        return self._read("notes", NOTE)

    def record(self, rows: DataFrame) -> int:
        """Append memories whose id isn't there yet; confidence must lie in 0..1. Returns how many were new."""
        return self.committed(lambda: self._record(rows))

    def _record(self, rows: DataFrame) -> int:
        if rows.where("confidence < 0 or confidence > 1").limit(1).count():
            raise ValueError("confidence must lie between 0 and 1")
        fresh = rows.join(self.facts().select("id"), "id", "left_anti").dropDuplicates(["id"])
        fields = self.facts().schema.fields
        n = fresh.count()
        self._put("facts", fresh.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)))
        return n

    def note(self, rows: DataFrame) -> None:
        """Append notes (id, kind, text, at, vec) after the last."""
        self.committed(lambda: self._note(rows))

    def _note(self, rows: DataFrame) -> None:
        last = self.notes().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        full = rows.select("id", "kind", *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("at", "timestamp"), ("vec", "array<float>"))))
        self._put("notes", full.select((F.monotonically_increasing_id() + last + 1).alias("seq"), "*"))

    def supersede(self, old: str, new: str, at: str) -> bool:
        """Link old to its correction; False where the link is there already, an error for self, unknown, fork and cycle."""
        return self.committed(lambda: self._supersede(old, new, at))

    def _supersede(self, old: str, new: str, at: str) -> bool:
        from .history import judge_link

        verdict = judge_link(self.current().select("id", "superseded_by"), old, new)
        if verdict == "same":
            return False
        if verdict != "ok":
            raise ValueError(f"can't supersede {old} by {new}: {verdict}")
        self.note(self.spark.createDataFrame([(old, "superseded", new)], "id string, kind string, text string").withColumn("at", F.to_timestamp(F.lit(at))))
        return True

    def current(self) -> DataFrame:
        return project(self.facts(), self.notes())


def project(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """Current memories: the latest note of each kind; a digest voids an older embedding, verifying or superseding an older suspicion."""
    pick = lambda k, c="text": F.max_by(F.when(F.col("kind") == k, F.col(c)), F.when(F.col("kind") == k, F.col("seq")))
    seq = lambda *ks: F.coalesce(F.max(F.when(F.col("kind").isin(*ks), F.col("seq"))), F.lit(-1))
    state = notes.groupBy("id").agg(
        pick("digest").alias("n_digest"), pick("embedding", "vec").alias("vec"), pick("superseded").alias("superseded_by"), pick("superseded", "at").alias("superseded_at"), pick("verified", "at").alias("verified_at"), pick("suspect").alias("why"),
        seq("suspect").alias("s"), seq("clear", "verified", "superseded").alias("c"), seq("embedding").alias("e"), seq("digest").alias("d"), F.coalesce(F.max(F.col("kind") == "cold"), F.lit(False)).alias("n_cold"),
    )
    out = facts.join(state, "id", "left")
    suspect = F.coalesce(F.col("s") > F.col("c"), F.lit(False))
    return out.select(
        *(c for c in facts.columns if c != "digest"),
        F.coalesce("n_digest", "digest").alias("digest"),
        F.when(F.col("e") > F.col("d"), F.col("vec")).alias("vec"),
        "superseded_by", "superseded_at", "verified_at",
        suspect.alias("suspect"), F.when(suspect, F.col("why")).alias("suspect_reason"),
        F.coalesce("n_cold", F.lit(False)).alias("cold"),
    )


def replay_counts(events: DataFrame) -> DataFrame:
    """applied, retired and unrecognised events of a log (event_type)."""
    t = F.col("event_type")
    return events.agg(F.count_if(t.isin(APPLIED)).alias("applied"), F.count_if(t.isin(RETIRED)).alias("retired"), F.count_if(~t.isin(APPLIED + RETIRED)).alias("unrecognised"))


def replay(events: DataFrame) -> DataFrame:
    """(id, payload, superseded_by) rebuilt from events (event_id, event_type, id, new_id, payload): accesses, tiers and notes are not events and start anew."""
    recorded = events.where("event_type = 'ExperienceRecorded'").groupBy("id").agg(F.min_by("payload", "event_id").alias("payload"))
    links = events.where("event_type = 'ExperienceSuperseded'").groupBy("id").agg(F.max_by("new_id", "event_id").alias("superseded_by"))
    return recorded.join(links, "id", "left")


def export_reports(current: DataFrame) -> DataFrame:
    """Scout reports of any visibility, for another store; embeddings stay behind."""
    return current.where(F.startswith(F.lower("action"), F.lit("scout-report"))).drop("vec").orderBy("ts", "id")


def import_reports(store: Store, rows: DataFrame, version: int = 2) -> dict[str, int]:
    """Idempotent by id: new rows first, then links to memories that are there; a link whose target is missing counts as unlinkable."""
    if version != 2:
        raise ValueError(f"version {version} can't be imported")
    total = rows.count()
    names = [c for c in store.facts().columns if c in rows.columns]
    imported = store.record(rows.select(*names))
    now = store.current().select("id", F.col("superseded_by").alias("has")).persist()
    wanted = rows.where("superseded_by is not null").select("id", "superseded_by").join(now, "id").where("has is null")
    linkable = wanted.join(now.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi")
    n, linked = wanted.count(), linkable.count()
    if linked:
        store.note(linkable.select("id", F.lit("superseded").alias("kind"), F.col("superseded_by").alias("text")))
    now.unpersist()
    return {"imported": imported, "skipped": total - imported, "relinked": linked, "unlinkable": n - linked}


def actions_with(memories: DataFrame, prefix: str) -> DataFrame:
    """(action): the different actions that begin with the prefix, in any case."""
    return memories.where(F.startswith(F.lower("action"), F.lit(prefix.lower()))).select("action").distinct()


def latest_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("ts"), "id").limit(limit)


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows beyond a key, in its order."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def body_budget(rows: DataFrame, budget: int = 3000, least: int = 200) -> DataFrame:
    """(grp, rank, shown): characters of each hit's body (grp, rank, len): what is left of the budget, never less than `least`. An ordered fold, since the floor makes it no running sum."""
    ordered = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("rank", "len"))).alias("hits"))
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<rank:bigint,shown:bigint>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        return F.struct(F.greatest(acc["left"] - h["len"], F.lit(least).cast("long")).alias("left"), F.concat(acc["out"], F.array(F.struct(h["rank"].cast("long").alias("rank"), F.least(h["len"].cast("long"), acc["left"]).alias("shown")))).alias("out"))

    return ordered.select("grp", F.explode(F.aggregate("hits", zero, step)["out"]).alias("o")).select("grp", "o.*")


def render_contexts(rows: DataFrame) -> DataFrame:
    """(qid, context): markdown of each question's newest memories, from rows (qid, question, place, task, result, lessons, staleness, staleness_reason).

    A question without memories has one row with a null place. A context is bounded by what its question returned.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    why = F.when(F.col("staleness_reason").isNotNull(), F.concat(F.lit(" ("), "staleness_reason", F.lit(")")))
    flag = F.when(F.col("staleness").isNotNull(), F.concat(F.lit(" — **"), "staleness", F.lit("**"), text(why)))
    lessons = F.array_join(F.transform(F.coalesce("lessons", F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n  - "), x)), "")
    line = F.concat(F.lit("- ["), "task", F.lit("] "), F.coalesce("result", F.lit("(no recorded outcome)")), text(flag), lessons)
    grouped = rows.select("qid", "question", F.when(F.col("place").isNotNull(), F.struct("place", line.alias("line"))).alias("l")).groupBy("qid", "question").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    body = F.when(F.size("ls") > 0, F.array_join(F.transform("ls", lambda x: x.line), "\n")).otherwise(F.lit("_No prior knowledge recorded for this task._"))
    return grouped.select("qid", F.concat(F.lit("# Context: "), "question", F.lit("\n\n## Prior Experience\n\n"), body).alias("context"))


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the least order for each key, by an aggregate that combines before the shuffle."""
    first = rows.groupBy(key).agg(F.min_by(F.struct("*"), F.col(order)).alias("_row"))
    return first.select("_row.*")
