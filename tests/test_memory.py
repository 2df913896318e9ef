"""A memory's life: events, corrections, accesses, tiers, transfer, streams and commands."""

import os
import json
import subprocess
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recollect import cli
from recollect.operators import evals, lifecycle, store
from recollect.streaming import events

T0 = "2026-01-01T00:00:00Z"
ROW = "id string, task string, observation string, anchors array<struct<path:string,symbol:string>>, related_nodes array<string>, confidence double"


@pytest.fixture
def memory(spark, tmp_path):
    m = lifecycle.Memory(spark, str(tmp_path / "memory"))
    assert m.migrate() == [n for n, _ in lifecycle.MIGRATIONS] and m.migrate() == []
    return m


def remember(m, *ids, **options):
    return m.remember(m.spark.createDataFrame([(i, f"task {i}", f"what {i} says", [("src/a.ts", None)], ["src/a.ts"], 0.7) for i in ids], ROW), T0, **options)


def test_events_and_rebuild(memory):
    assert remember(memory, "a", "b") == 2 and remember(memory, "b", "c") == 1
    new = memory.correct(memory.spark.createDataFrame([("better", "it says more", 0.8)], "task string, observation string, confidence double"), "a", "2026-02-01T00:00:00Z")
    with pytest.raises(ValueError):
        memory.correct(memory.spark.createDataFrame([("x", "y", 0.8)], "task string, observation string, confidence double"), "nobody")
    with pytest.raises(ValueError):
        memory.correct(memory.spark.createDataFrame([("x", "y", 0.8)], "task string, observation string, confidence double"), "a")
    got = memory.get(new)
    assert [x.path for x in got.anchors] == ["src/a.ts"] and got.related_nodes == ["src/a.ts"] and memory.get("nobody") is None
    kinds = [(r.event_type, r.id) for r in memory.events().orderBy("event_id").collect()]
    assert sorted(kinds[:2]) == [("ExperienceRecorded", "a"), ("ExperienceRecorded", "b")] and kinds[2:] == [("ExperienceRecorded", "c"), ("ExperienceRecorded", new), ("ExperienceSuperseded", "a")]
    assert [r.id for r in memory.chain(new).collect()] == ["a", new] == [r.id for r in memory.chain("a").collect()]

    assert memory.verify("b", T0) and not memory.verify("nobody") and memory.freeze("b") and not memory.freeze("nobody")
    assert memory.get("b").cold and memory.get("b").verified_at is not None
    memory.access(memory.spark.createDataFrame([("c",)], "id string"), "s1", T0)
    before = {r.id: (r.task, r.observation, r.superseded_by) for r in memory.current().collect()}
    assert memory.rebuild() == {"applied": 5, "retired": 0, "unrecognised": 0}
    assert {r.id: (r.task, r.observation, r.superseded_by) for r in memory.current().collect()} == before
    assert not memory.get("b").cold and memory.access_log().count() == 0


def test_explicitly_empty_anchors_are_kept(memory):
    remember(memory, "a")
    new = memory.correct(memory.spark.createDataFrame([("t", "o", [], 0.8)], "task string, observation string, anchors array<struct<path:string,symbol:string>>, confidence double"), "a")
    assert memory.get(new).anchors == [] and memory.get(new).related_nodes == ["src/a.ts"]


def test_accesses_and_tiers(memory):
    remember(memory, "a", session="w"), remember(memory, "b")
    ids = lambda *xs: memory.spark.createDataFrame([(x,) for x in xs], "id string")
    assert memory.access(ids("a", "b"), "w", T0) == 2 and memory.access(ids("a", "b"), "s1", T0) == 2
    assert memory.access(ids("a"), None) == 0 and memory.access(ids("a").withColumnRenamed("id", "wrong"), "s") == 0
    outcome = lambda: {(r.id, r.session): r.outcome for r in memory.access_rows().collect()}
    assert outcome() == {("a", "w"): "self", ("b", "w"): "provisional", ("a", "s1"): "provisional", ("b", "s1"): "provisional"}
    changes = {r.id: (r.tier, r.reason) for r in memory.settle("s1", "confirmed", ["a"], "2026-01-02T00:00:00Z").collect()}
    assert changes == {"a": ("mid", "promoted_distinct_session")}
    assert outcome()["a", "s1"] == "confirmed" and outcome()["b", "s1"] == "unused"
    assert memory.settle("s1", "rejected", now="2026-01-03T00:00:00Z").isEmpty() and outcome()["a", "s1"] == "confirmed"  # never opened again
    assert memory.stats()["tiers"] == {"short": 1, "mid": 1, "long": 0}
    late = "2026-04-15T00:00:00Z"
    changes, idle = memory.maintain(late)
    assert {r.id: r.reason for r in changes.collect()} == {"a": "demoted_idle"} and [r.id for r in idle.collect()] == ["a", "b"]
    assert memory.decide(late).isEmpty()  # the watermark keeps spent credit from promoting again
    with pytest.raises(ValueError):
        memory.settle("s2", "maybe")


def test_transfer(memory, spark, tmp_path):
    rows = [("r1", "Scout-Report x", None), ("r2", "scout-report", "r1"), ("r3", "scout-report", "gone"), ("c1", "commit 1", None)]
    facts = spark.createDataFrame([(i, "t", "o", a, 0.5, 1) for i, a, _ in rows], "id string, task string, observation string, action string, confidence double, n int").withColumn("ts", F.to_timestamp(F.lit(T0)))
    memory.remember(facts.drop("n"), T0)
    memory.note(spark.createDataFrame([(i, "superseded", s) for i, _, s in rows if s], "id string, kind string, text string"))
    out = store.export_reports(memory.current())
    assert [r.id for r in out.collect()] == ["r1", "r2", "r3"] and "vec" not in out.columns
    other = store.Store(spark, str(tmp_path / "other"))
    assert store.import_reports(other, out) == {"imported": 3, "skipped": 0, "relinked": 1, "unlinkable": 1}
    assert store.import_reports(other, out) == {"imported": 0, "skipped": 3, "relinked": 0, "unlinkable": 1}
    with pytest.raises(ValueError):
        store.import_reports(other, out, version=1)


def test_instants():
    assert lifecycle.instant("2026-01-01T02:00:00.1239+02:00") == datetime(2026, 1, 1, 0, 0, 0, 123000, timezone.utc)
    with pytest.raises(ValueError):
        lifecycle.instant("yesterday")


def test_temporary_memory(spark):
    with lifecycle.temporary_memory(spark) as m:
        assert remember(m, "a") == 1
    assert not m._exists("facts")


def test_shuffle_and_arm(spark):
    assert sorted(evals.seeded_shuffle(list(range(20)), 7)) == list(range(20)) and evals.seeded_shuffle(list(range(20)), 7) == evals.seeded_shuffle(list(range(20)), 7) != evals.seeded_shuffle(list(range(20)), 11)
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcde")], "qid string, id string, rank int")
    edges = spark.createDataFrame([("a", "x", 0.5), ("y", "b", 0.9), ("a", "b", 1.0), ("e", "z", 1.0)], "source string, target string, confidence double")
    got = [(r.id, r.provenance) for r in evals.linked_arm(ranked, edges, 5, 2).orderBy("place").collect()]
    assert got == [("a", "by_meaning"), ("b", "by_meaning"), ("y", "linked"), ("x", "linked"), ("c", "backfill")]


def test_access_stream(spark, tmp_path):
    """Settled accesses stay settled, late rows within the watermark count, rows beyond it don't."""
    rows = [
        [("s", 1, "access", True, 1, "2026-01-01 10:00:00"), ("s", 2, "access", False, 2, "2026-01-01 10:01:00"), ("s", None, "confirmed", False, 3, "2026-01-01 10:02:00"), ("s", 3, "access", False, 4, "2026-01-01 10:03:00")],
        [("s", 1, "access", False, 5, "2026-01-01 10:04:00"), ("s", None, "rejected", False, 6, "2026-01-01 10:05:00"), ("s", 4, "access", False, 7, "2026-01-01 09:00:00")],
        [("t", 1, "access", False, 8, "2026-02-01 00:00:00")],
        [("t", 9, "access", False, 9, "2026-01-01 00:00:00"), ("t", 1, "access", False, 10, "2026-01-31 20:00:00")],
    ]
    kind = "session string, id long, kind string, used boolean, seq long, at string"
    folder = tmp_path / "log"
    for n, some in enumerate(rows):
        one = spark.createDataFrame(some, kind).withColumn("ts", F.to_timestamp("at")).drop("at").coalesce(1)
        one.write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            f.rename(folder / f"{n}.parquet") if not f.name[0].isdigit() else None
        import os

        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {(r.session, r.id): (r.hits, r.outcome) for r in events.finished(stream, lambda e: events.access_state(e.fillna({"id": -1, "used": False, "kind": "access", "seq": 0}), late="1 day", quiet_ms=3_600_000)).collect()}
    assert got[("s", 1)] == (2, "confirmed") and got[("s", 2)] == (1, "unused") and got[("s", 3)] == (1, "rejected") and got[("s", 4)] == (1, "rejected")
    assert got[("t", 1)] == (2, "provisional") and ("t", 9) not in got


def test_access_stream_of_many_sessions(spark, tmp_path):
    """Sessions that share a bucket end each for itself, counted from the last row heard, late rows or not."""
    rows = [[("s", 1, "2026-02-01 00:00:00"), ("u", 5, "2026-01-31 19:00:00")], [("s", 2, "2026-01-31 20:00:00")], [("v", 1, "2026-02-01 23:00:00")], [("s", 1, "2026-02-01 00:30:00")]]
    folder = tmp_path / "log"
    folder.mkdir()
    for n, some in enumerate(rows):
        told = spark.createDataFrame(some, "session string, id long, at string").select("session", "id", F.lit("access").alias("kind"), F.lit(False).alias("used"), F.lit(n).cast("long").alias("seq"), F.to_timestamp("at").alias("ts"))
        told.coalesce(1).write.parquet(str(tmp_path / str(n)))
        (part,) = (tmp_path / str(n)).glob("part-*")
        part.rename(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = events.finished(stream, lambda e: events.access_state(e.fillna({"id": -1, "used": False, "kind": "access", "seq": 0}), late="1 day", quiet_ms=3_600_000, buckets=1)).collect()
    assert sorted((r.session, r.id, r.hits) for r in got if r.session) == [("s", 1, 2), ("s", 2, 1), ("u", 5, 1), ("v", 1, 1)]


REPORT = "The loader keeps a cache of parsed modules because the parser is slow on generated code. " * 4


def test_commands(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()

    def git(*args, day=1):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": f"2026-01-{day:02d}T00:00:00Z", "GIT_COMMITTER_DATE": f"2026-01-{day:02d}T00:00:00Z", "PATH": "/usr/bin:/bin"})

    git("init", "-q")
    (repo / "load.ts").write_text("cache\n" * 9)
    git("add", "."), git("commit", "-qm", "Cache parsed modules in the loader", "-m", "Decided on a cache because " + "the parser is slow on generated code " * 6)
    c = cli.Commands(lifecycle.Memory(spark, str(tmp_path / "m")), str(repo))
    first = c.sync()
    assert first["experiencesAdded"] == 1 and first["staleness"]["marked"] == 0 and c.sync()["experiencesAdded"] == 0
    said = c.ask("why does the loader cache parsed modules", session="s")
    assert "## Why / prior knowledge (1)" in said and "### Cache parsed modules in the loader" in said and "2026-01-01" in said
    assert c.memory.access_log().count() == 1 and "(nothing recorded" in c.ask("zebra quagga okapi")
    (repo / "load.ts").write_text("changed\n" * 9)
    git("add", "."), git("commit", "-qm", "tidy", day=2)
    assert c.stale()["marked"] == 1 and len(c.stale()["examples"]) == 1
    (work,) = c.suspects()
    assert work["anchors"] == ["load.ts"] and work["why"].startswith("modified load.ts in ")
    assert c.verify(work["id"], "2026-01-03T00:00:00Z")["verified"] and c.suspects() == [] and c.stale()["marked"] == 0
    made = c.record(json.dumps({"task": "note", "observation": "loader notes", "files": [str(repo / "load.ts")]}))
    assert made["anchors"] == 1 and c.show(made["id"])["anchors"] == [{"path": "load.ts", "symbol": None}]
    (tmp_path / "scout.json").write_text(json.dumps({"task": "scouting", "understanding": REPORT, "anchors": ["load.ts#cache"]}))
    assert c.scout(str(tmp_path / "scout.json")) == {"recorded": 1}
    (tmp_path / "fix.json").write_text(json.dumps({"supersedes": work["id"], "task": "Cache by hash", "observation": "the cache is keyed by hash now"}))
    fixed = c.supersede(str(tmp_path / "fix.json"))
    assert fixed["anchors"] == 1 and fixed["inheritedBindings"] and [h["id"] for h in c.history(work["id"])] == [work["id"], fixed["recorded"]]
    assert c.show(work["id"])["chain"] == [work["id"], fixed["recorded"]] and c.show("nobody") == {"error": "no such memory: nobody"}
    s = c.stats()
    assert s["experiences"] == 4 and s["superseded"] == 1 and len(s["newest"]) == 4
