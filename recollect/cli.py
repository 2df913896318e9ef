"""The commands of a memory: python -m recollect --memory FOLDER --repo FOLDER COMMAND. Every command migrates first."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.anchors import format_anchor
from .operators import capture, context, retrieval, store
from .operators.lifecycle import Memory, ask_lines, instant, iso_text
from .sources import files, git

ASK_LIMIT, LEAST_COSINE, HISTORY = 3, 0.3, 500
FLAG, HINT = "possibly stale", "check it against the code, then verify or supersede it"


class Commands:
    """Each command returns what it prints: a text, or an object that is printed as JSON."""

    def __init__(self, memory: Memory, repo: str = ".", embedder: capture.Embedder | None = None, distill: bool = False):
        self.memory, self.repo, self.embedder, self.distill = memory, repo, embedder, distill
        self.spark = memory.spark
        memory.migrate()

    def _changes(self) -> DataFrame:
        return git.changed_paths_since(self.spark, self.repo, limit=HISTORY)

    def sync(self) -> dict:
        """Capture what history explains, then mark what it has overtaken: in this order, so that no commit marks its own memory."""
        got = capture.capture_history(self.memory, self.repo, "", HISTORY, self.embedder)
        distilled = capture.distill(self.memory) if self.distill else 0
        again = capture.backfill_vectors(self.memory, self.embedder)
        return {"revision": git.corpus_revision(self.repo), "explanatoryCommits": got["mined"], "experiencesAdded": got["recorded"], "distilled": distilled, "reembedded": again, "staleness": context.mark_suspects(self.memory, self._changes())}

    def ask(self, question: str, session: str | None = None) -> str:
        """The answer as text: hits in rank order share a budget of characters; a flag that most memories carry is told once."""
        m = self.memory
        asked = self.spark.createDataFrame([("q", question)], "qid string, question string")
        if self.embedder is not None:
            asked = asked.withColumn("vec", self.embedder(F.col("question")))
        found = context.searchable(m)
        found = found if self.embedder is not None else found.drop("vec")
        hits = retrieval.by_meaning(asked, found, limit=ASK_LIMIT, min_vector_score=LEAST_COSINE)
        now = m.current().select("id", "task", "action", F.coalesce("digest", "observation").alias("body"))
        rows = m._scratch("ask").keep(hits.select("qid", "id", "rank", "score", "reason", "legs", "ts").join(now, "id"), "hits")
        m.access(rows, session)
        shown = store.body_budget(rows.select(F.col("qid").alias("grp"), "rank", F.length("body").alias("len"))).select(F.col("grp").alias("qid"), "rank", "shown")
        texts = [(r.rank, r.id, r.text) for r in ask_lines(rows.join(shown, ["qid", "rank"])).join(rows.select("rank", "id"), "rank").orderBy("rank").collect()]  # at most ASK_LIMIT
        out = [f"## Why / prior knowledge ({len(texts)})", ""]
        if not texts:
            return "\n".join([*out, "(nothing recorded for this — run `sync`, or the question may be new ground)"])
        rate = m.current().where("superseded_by is null").agg(F.count_if("suspect").alias("flagged"), F.count("*").alias("total")).first()
        banners = rate.flagged * 2 <= rate.total
        if not banners:
            out += [f"_{rate.flagged}/{rate.total} memories are flagged possibly-stale — too many to flag individually; check any memory against the current code before trusting it._", ""]
        judged = context.advisory_verdicts(m, self._changes())
        stale = {r.id: r.reason for r in judged.join(rows.select("id"), "id", "left_semi").where("possibly_stale").collect()} if banners and judged is not None else {}
        for _, id_, text in texts:
            head, _, body = text.partition("\n\n")
            out += [head, "", *([f"> **{FLAG}** ({stale[id_]})", f"> {HINT} — `{id_}`", ""] if id_ in stale else []), body, ""]
        return "\n".join(out)

    def record(self, text: str) -> dict:
        row = files.inline_record(self.spark, text, self.repo)
        held = self.memory._scratch("record").keep(row.withColumn("id", F.expr("uuid()")), "row")
        self.memory.remember(held)
        r = held.select("id", F.coalesce(F.size("anchors"), F.lit(0)).alias("anchors")).first()
        return {"id": r.id, "anchors": max(r.anchors, 0)}

    def scout(self, path: str) -> dict:
        return capture.record_reports(self.memory, files.judged_reports(files.scout_reports(self.spark, path)), iso_text(instant(None)))

    def stale(self) -> dict:
        counts = context.mark_suspects(self.memory, self._changes())
        newest = self.memory.current().where("suspect and superseded_by is null").orderBy(F.desc("ts"), "id").limit(10)
        return {**counts, "examples": [r.e for r in newest.select(F.concat(F.substring("task", 1, 60), F.lit(" :: "), "suspect_reason").alias("e")).collect()]}

    def suspects(self, limit: int = 10) -> list[dict]:
        """The worklist of what history has overtaken, the oldest first."""
        day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
        rows = self.memory.current().where("suspect and superseded_by is null").orderBy("ts", "id").limit(limit)
        shown = rows.select("id", "task", F.col("action").alias("source"), day("ts"), day("verified_at"), F.transform("anchors", format_anchor).alias("anchors"), F.col("suspect_reason").alias("why"))
        return [{"written" if k == "ts" else "verifiedAt" if k == "verified_at" else k: v for k, v in r.asDict().items()} for r in shown.collect()]

    def show(self, id_: str) -> dict:
        """One memory in full, with the ids of its chain, oldest first."""
        chain = self.memory.chain(id_).collect()
        r = next((c for c in chain if c.id == id_), None)
        if r is None:
            return {"error": f"no such memory: {id_}"}
        time = lambda x: x and iso_text(x)
        return {"id": r.id, "task": r.task, "source": r.action, "timestamp": time(r.ts), "verifiedAt": time(r.verified_at), "suspect": r.suspect, "suspectReason": r.suspect_reason, "supersededBy": r.superseded_by, "anchors": [a.asDict() for a in r.anchors or []], "confidence": r.confidence, "chain": [c.id for c in chain], "digest": r.digest, "observation": r.observation, "lessons": r.lessons}

    def verify(self, id_: str, at: str | None = None) -> dict:
        """The instant is that of reading the code, not of this call."""
        when = instant(at)
        return {"id": id_, "verified": self.memory.verify(id_, when), "verifiedAt": iso_text(when), "stampedFrom": "read-instant" if at else "now"}

    def supersede(self, path: str) -> dict:
        one = self.memory._scratch("correction").keep(files.correction_rows(files.corrections(self.spark, path)), "row")
        given = one.first()
        for name in ("supersedes", "task", "observation"):
            if given is None or given[name] is None:
                raise ValueError(f"a correction needs its {name}")
        new = self.memory.correct(one.drop("supersedes"), given.supersedes)
        capture.backfill_vectors(self.memory, self.embedder)
        saved = self.memory.get(new)
        return {"recorded": new, "supersedes": given.supersedes, "anchors": len(saved.anchors or []), "boundTo": len(saved.related_nodes or []), "inheritedBindings": given.anchors is None}

    def history(self, id_: str) -> list[dict]:
        return [{"id": r.id, "timestamp": iso_text(r.ts), "supersededBy": r.superseded_by, "task": r.task, "observation": "\n".join((r.observation or "").split("\n")[:6])} for r in self.memory.chain(id_).collect()]

    def stats(self) -> dict:
        return self.memory.stats()


NAMES = ["sync", "ask", "record", "scout", "stale", "suspects", "show", "verify", "supersede", "history", "stats"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recollect")
    parser.add_argument("--memory", required=True, help="folder of the memory")
    parser.add_argument("--repo", default=".", help="folder of the git repository")
    parser.add_argument("--vectors", action="store_true", help="hash vectors as a third way to find memories")
    parser.add_argument("command", choices=NAMES)
    parser.add_argument("words", nargs="*")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("recollect").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    commands = Commands(Memory(spark, args.memory), args.repo, capture.hash_embedder() if args.vectors else None)
    words = [" ".join(args.words)] if args.command in ("ask", "record") else [int(args.words[0])] if args.command == "suspects" and args.words else args.words
    out = getattr(commands, args.command)(*words)
    print(out if isinstance(out, str) else json.dumps(out, indent=2, ensure_ascii=False))
    return 0
