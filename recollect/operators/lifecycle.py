"""A memory with its whole life: events, accesses, settlements and tiers beside the store's facts and notes, all append-only.

A memory, its event and its link are one commit: readers see all of them or none. rebuild() projects the events anew,
so the event log alone is what must not be lost.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.anchors import anchors_from_nodes
from ..functions.constants import CREDIT_WINDOW_DAYS, TIERS
from ..functions.text import json_items
from ..sources.scratch import shared_dir
from . import history, tiers
from .store import EXPERIENCE, NOTE, Store, iso, replay, replay_counts

EVENT = "event_id long, event_type string, id string, new_id string, payload string, at timestamp"
ACCESS = "id string, session string, ts timestamp"
SETTLE = "settle_seq long, session string, outcome string, settled_at timestamp"
USED = "id string, session string"
TIER = "seq long, id string, tier string, reason string, tier_changed_at timestamp, credit_watermark long"
#: Tables by the step of the layout that brought them, in order; a step is applied once.
MIGRATIONS = [("0001_facts_and_notes", {"facts": EXPERIENCE, "notes": NOTE}), ("0002_events", {"events": EVENT}), ("0003_accesses", {"accesses": ACCESS, "settles": SETTLE, "used": USED, "tiers": TIER})]
DAY_MS = 86_400_000


def instant(at: str | datetime | None) -> datetime:
    """An instant in UTC to the millisecond; None is now; what can't be read is an error."""
    if at is None:
        at = datetime.now(timezone.utc)
    if isinstance(at, str):
        at = datetime.fromisoformat(at.replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return at.astimezone(timezone.utc).replace(microsecond=at.microsecond // 1000 * 1000)


def decode_rows(rows: DataFrame) -> DataFrame:
    """Rows whose lists are JSON text (lessons, related_nodes, anchors) and flags 0 or 1 (suspect, cold), as the engine's types.

    What is no JSON array is an empty list; a row without anchors takes those that its related nodes name.
    """
    nodes = json_items(F.col("related_nodes"))
    own = F.transform(json_items(F.col("anchors")), lambda a: F.from_json(a, "path string, symbol string"))
    typed = {"lessons": json_items(F.col("lessons")), "related_nodes": nodes, "anchors": F.when(F.size(own) > 0, own).otherwise(anchors_from_nodes(nodes)), "suspect": F.col("suspect") == 1, "cold": F.col("cold") == 1}
    return rows.select(*(typed[c].alias(c) if c in typed else F.col(c) for c in rows.columns))


class Memory(Store):
    """A store with events, accesses and tiers; every instant is passed in, and None means now."""

    def migrate(self) -> list[str]:
        """Applies what the layout still lacks, in order; returns the names applied now. Done once, it does nothing."""
        return self.committed(self._migrate)

    def _migrate(self) -> list[str]:
        done = {r.name for r in self._read("schema_migrations", "name string, at timestamp").collect()}
        fresh = [name for name, _ in MIGRATIONS if name not in done]
        for name, tables in MIGRATIONS:
            for table, schema in tables.items() if name in fresh else ():
                if not self._exists(table):
                    self._put(table, self.spark.createDataFrame([], schema))
        if fresh:
            self._put("schema_migrations", self.spark.createDataFrame([(name, instant(None)) for name in fresh], "name string, at timestamp"))
        return fresh

    def events(self) -> DataFrame:
        return self._read("events", EVENT)

    def append_events(self, rows: DataFrame) -> None:
        """Append events (event_type, id, new_id, payload, at) after the last, in their order."""
        self._append("events", rows, EVENT, "event_id")

    def _append(self, table: str, rows: DataFrame, schema: str, number: str | None = None) -> None:
        self.committed(lambda: self._put_rows(table, rows, schema, number))

    def _put_rows(self, table: str, rows: DataFrame, schema: str, number: str | None) -> None:
        kind = self.spark.createDataFrame([], schema).schema
        if number:
            last = self._read(table, schema).agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
            rows = rows.withColumn(number, F.monotonically_increasing_id() + last + 1)
        self._put(table, rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind)))

    def remember(self, rows: DataFrame, now=None, session: str | None = None) -> int:
        """Record memories with their events: a missing id is minted, a missing time is now, the session is the writer's."""
        now = instant(now)
        have = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other
        full = rows.withColumn("id", have("id", F.expr("uuid()"))).withColumn("ts", have("ts", F.lit(now)))
        if session is not None:
            full = full.withColumn("writer_session", F.lit(session))
        held = self._scratch("remember").keep(full.withColumn("_nth", F.monotonically_increasing_id()), "rows")  # minted ids must not be minted twice
        return self.committed(lambda: self._remember(held, now))

    def _remember(self, held: DataFrame, now: datetime) -> int:
        fresh = held.join(self.facts().select("id"), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*(c for c in held.columns if c != "id")), "_nth").alias("r")).select("id", "r.*")
        self.append_events(fresh.orderBy("_nth").select(F.lit("ExperienceRecorded").alias("event_type"), "id", F.to_json(F.struct(*(c for c in fresh.columns if c != "_nth"))).alias("payload"), F.lit(now).alias("at")))
        return self.record(fresh.drop("_nth"))

    def correct(self, row: DataFrame, supersedes: str, now=None, session: str | None = None) -> str:
        """Record one correction and link the memory that it corrects; returns its id.

        Anchors and related nodes that the row leaves null are those of the corrected memory; an empty list stays empty.
        """
        now, new = instant(now), str(uuid.uuid4())
        return self.committed(lambda: self._correct(row, supersedes, new, now, session))

    def _correct(self, row: DataFrame, supersedes: str, new: str, now: datetime, session: str | None) -> str:
        old = self.get(supersedes)
        if old is None:
            raise ValueError(f"there is no memory {supersedes} to supersede")
        if old.superseded_by is not None:
            raise ValueError(f"can't supersede {supersedes}: fork")
        before = self.facts().where(F.col("id") == supersedes).select(F.col("anchors").alias("_anchors"), F.col("related_nodes").alias("_nodes"))
        have = lambda c: F.col(c) if c in row.columns else F.lit(None)
        one = row.crossJoin(F.broadcast(before)).withColumn("anchors", F.coalesce(have("anchors"), "_anchors")).withColumn("related_nodes", F.coalesce(have("related_nodes"), "_nodes")).drop("_anchors", "_nodes")  # one row beside one
        self.remember(one.withColumn("id", F.lit(new)), now, session)
        self.link(supersedes, new, now)
        return new

    def link(self, old: str, new: str, now=None) -> bool:
        now = instant(now)
        return self.committed(lambda: self._link(old, new, now))

    def _link(self, old: str, new: str, now: datetime) -> bool:
        linked = self.supersede(old, new, iso_text(now))
        if linked:
            self.append_events(self.spark.createDataFrame([("ExperienceSuperseded", old, new, now)], "event_type string, id string, new_id string, at timestamp"))
        return linked

    def get(self, id_: str):
        """One memory as it stands, whatever its visibility; None where there is none."""
        return self.current().where(F.col("id") == id_).first()

    def _mark(self, id_: str, kind: str, at: datetime | None = None) -> bool:
        if self.facts().where(F.col("id") == id_).isEmpty():
            return False
        self.note(self.spark.createDataFrame([(id_, kind, at)], "id string, kind string, at timestamp"))
        return True

    def verify(self, id_: str, at=None) -> bool:
        """The memory was checked and holds: clears a suspicion and stamps the instant of the check. False for an unknown id."""
        return self._mark(id_, "verified", instant(at))

    def freeze(self, id_: str) -> bool:
        """Takes a memory out of the answers (cold); False for an unknown id."""
        return self._mark(id_, "cold")

    # --- accesses and tiers ---

    def access_log(self) -> DataFrame:
        return self._read("accesses", ACCESS)

    def access(self, answers: DataFrame, session: str | None, now=None) -> int:
        """Write-on-read: the memories that were returned (id), for a named session. Best effort: a failure counts as none."""
        if session is None:
            return 0
        try:
            rows = answers.select("id").distinct().withColumn("session", F.lit(session)).withColumn("ts", F.lit(instant(now)))
            held = self._scratch("access").keep(rows, "rows")
            self._append("accesses", held, ACCESS)
            return held.count()
        except Exception:  # noqa: BLE001 - an answer must not fail because its accounting did
            return 0

    def access_rows(self) -> DataFrame:
        """One row for each memory and session with its outcome, settled by the session's first settlement."""
        first = self._read("settles", SETTLE).groupBy("session").agg(F.min_by(F.struct("outcome", "settled_at", "settle_seq"), "settle_seq").alias("s")).select("session", "s.*")
        return tiers.settle(tiers.accesses(self.access_log(), self.facts().select("id", F.col("writer_session").alias("session"))), first, self._read("used", USED))

    def tier_log(self) -> DataFrame:
        return self._read("tiers", TIER)

    def tiered(self) -> DataFrame:
        """(id, tier, created_at, tier_changed_at, credit_watermark, cold) of every memory; the latest change holds."""
        last = self.tier_log().groupBy("id").agg(F.max_by(F.struct("tier", "tier_changed_at", "credit_watermark"), "seq").alias("t"))
        m = self.current().select("id", F.col("ts").alias("created_at"), "cold").join(last, "id", "left")
        return m.select("id", F.coalesce("t.tier", F.lit("short")).alias("tier"), "created_at", F.coalesce("t.tier_changed_at", "created_at").alias("tier_changed_at"), F.coalesce("t.credit_watermark", F.lit(0)).cast("long").alias("credit_watermark"), "cold")

    def states(self, now=None) -> DataFrame:
        return tiers.tier_states(self.tiered(), self.access_rows(), instant(now) - timedelta(days=CREDIT_WINDOW_DAYS))

    def decide(self, now=None, ids: DataFrame | None = None) -> DataFrame:
        """The changes of tier that the policy makes now, appended to the tier log; of all memories, or of ids (id)."""
        now = instant(now)
        states = self.states(now) if ids is None else self.states(now).join(ids, "id", "left_semi")
        ms = lambda c: F.unix_millis(c).alias(c)
        timed = states.select(*(ms(c) if c in ("created_at", "last_accessed") else F.col(c) for c in states.columns))
        changes = self._scratch("decide").keep(tiers.tier_changes(tiers.decide(timed, int(now.timestamp() * 1000), DAY_MS), now), "changes")
        if not changes.isEmpty():
            self._append("tiers", changes, TIER, "seq")
        return changes

    def settle(self, session: str, outcome: str, used: list[str] = (), now=None) -> DataFrame:
        """How a session's task ended; the memories that it touched are decided on at once, and their changes returned.

        Only accesses that are still provisional settle, so a session settles once.
        """
        if outcome not in ("confirmed", "rejected"):
            raise ValueError(f"a session is confirmed or rejected, not {outcome}")
        now = instant(now)
        one = self.spark.createDataFrame([(session, outcome, now)], "session string, outcome string, settled_at timestamp")
        touched = self._scratch("settle").keep(tiers.touched_by(self.access_rows(), one), "touched")
        self._append("settles", one, SETTLE, "settle_seq")
        if used:
            self._append("used", self.spark.createDataFrame([(i, session) for i in used], USED), USED)
        return self.decide(now, touched)

    def maintain(self, now=None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
        """The clock's pass over all memories: their changes of tier, and the idle candidates, which nothing acts on."""
        changes = self.decide(now)
        return changes, self.idle(now, limit=limit)

    def idle(self, now=None, days: int = 30, limit: int = 1000) -> DataFrame:
        return tiers.idle_candidates(self.states(now), instant(now) - timedelta(days=days), limit)

    # --- reading ---

    def chain(self, id_: str) -> DataFrame:
        """The chain of a memory, oldest first: (id, depth) and the memory's columns."""
        now = self.current()
        return history.chain_of(now.select("id", "superseded_by", "ts"), id_).drop("ts").join(now, "id").orderBy("depth", "ts", "id")

    def stats(self) -> dict:
        m = self.current().join(self.tiered().select("id", "tier"), "id")
        counts = m.agg(F.count("*").alias("experiences"), *(F.count_if(F.col("tier") == t).alias(t) for t in TIERS), F.count_if(F.col("suspect") & F.col("superseded_by").isNull()).alias("suspect"), F.count("superseded_by").alias("superseded"), F.count_if("cold").alias("cold")).first()
        newest = m.orderBy(F.desc("ts"), "id").limit(5).select(F.substring(F.concat(F.coalesce("action", F.lit("-")), F.lit(" "), "task"), 1, 90).alias("line"))
        return {"experiences": counts.experiences, "tiers": {t: counts[t] for t in TIERS}, **{c: counts[c] for c in ("suspect", "superseded", "cold")}, "newest": [r.line for r in newest.collect()]}

    def rebuild(self) -> dict[str, int]:
        """Projects the event log into facts and links anew, in one commit. Accesses, tiers and other notes are no events and start again."""
        return self.committed(self._rebuild)

    def _rebuild(self) -> dict[str, int]:
        counts = replay_counts(self.events()).first().asDict()
        rebuilt = replay(self.events())
        fields = [f for f in self.facts().schema.fields if f.name != "id"]
        scratch = self._scratch("rebuild")
        facts = scratch.keep(rebuilt.where("payload is not null").select("id", F.from_json("payload", EXPERIENCE).alias("p")).select("id", *(F.col(f"p.{f.name}").cast(f.dataType).alias(f.name) for f in fields)), "facts")
        links = scratch.keep(self.events().where("event_type = 'ExperienceSuperseded'").groupBy("id").agg(F.max_by(F.struct("new_id", "at"), "event_id").alias("l")).select("id", F.lit("superseded").alias("kind"), F.col("l.new_id").alias("text"), F.col("l.at").alias("at")), "links")
        schemas = {table: schema for _, tables in MIGRATIONS for table, schema in tables.items() if table not in ("events", "facts")}
        for table, schema in schemas.items():
            self._put(table, self.spark.createDataFrame([], schema), replace=True)
        self._put("facts", facts, replace=True)
        if not links.isEmpty():
            self.note(links)
        return counts


def iso_text(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


@contextlib.contextmanager
def temporary_memory(spark: SparkSession) -> Iterator[Memory]:
    """A migrated memory in a folder of its own below the shared folder, gone afterwards."""
    memory = Memory(spark, f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}")
    memory.migrate()
    try:
        yield memory
    finally:
        memory.log.drop()


def why_context(hits: DataFrame, root: str) -> DataFrame:
    """(qid, context): what an agent is handed, from hits (qid, rank, action, lessons, observation, related_nodes, confidence)."""
    n = F.size("related_nodes")
    where = F.when(n > 0, F.concat(F.lit(" · touched "), n.cast("string"), F.lit(" file(s)"))).otherwise(F.lit(""))
    body = F.trim(F.coalesce(F.try_element_at("lessons", F.lit(1)), "observation"))
    text = F.concat(F.lit("--- prior knowledge "), F.col("rank").cast("string"), F.lit(" ("), F.coalesce("action", F.lit("unknown source")), where, F.lit(", confidence "), F.col("confidence").cast("string"), F.lit(") ---\n"), body)
    rows = hits.select("qid", F.struct("rank", text.alias("text")).alias("h")).groupBy("qid").agg(F.array_sort(F.collect_list("h")).alias("hs"))  # a question has at most `limit` hits
    return rows.select("qid", F.replace(F.array_join(F.transform("hs", lambda h: h.text), "\n\n"), F.lit(root), F.lit(".")).alias("context"))


def newest_on_anchor(memories: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, rank): the heads anchored on each question's path (qid, anchor), newest first; what recency alone would answer."""
    from pyspark.sql import Window

    m = memories.where("superseded_by is null")
    named = m.select("id", "ts", F.explode(F.array_distinct(F.concat(F.transform("anchors", lambda a: a.path), F.coalesce("related_nodes", F.array().cast("array<string>"))))).alias("anchor"))
    order = Window.partitionBy("qid").orderBy(F.desc("ts"), F.asc("id"))
    return questions.select("qid", "anchor").join(named, "anchor").select("qid", "id", F.row_number().over(order).alias("rank"))


def ask_lines(hits: DataFrame) -> DataFrame:
    """hits (qid, rank, id, task, action, ts, reason, legs, score, body, shown) as text, one row for each."""
    from ..functions.text import heading, shown_body

    return hits.select("qid", "rank", F.concat(heading(F.col("task"), F.col("action"), F.col("ts"), F.col("reason"), F.col("legs"), F.col("score")), F.lit("\n"), shown_body(F.col("body"), F.col("shown"), F.col("id"))).alias("text"))
