"""Capture, digests, vectors, transfer links, suspicion and contexts over one store."""

import pytest
from pyspark.sql import functions as F

from recollect.functions import vectors
from recollect.operators import capture, context, evals, history, store
from recollect.sources import files

NOW = "2026-03-01T00:00:00Z"
REPORT = "The loader keeps a cache of parsed modules because the parser is slow on generated code. " * 4


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = [("loader cache", REPORT, ["src/load.ts#cache", "src/parse.ts"]), ("short", "too little", ["a.ts"]), ("nowhere", REPORT, [" "])]
    judged = files.judged_reports(spark.createDataFrame(rows, "task string, understanding string, anchors array<string>").selectExpr("*", "cast(null as array<string>) lessons", "cast(null as string) result", "cast(null as string) source", "cast(null as double) confidence"))
    assert capture.record_reports(s, judged, NOW) == {"recorded": 1, "too_short": 1, "no_anchor": 1}
    assert capture.record_reports(s, judged, NOW)["recorded"] == 0
    return s


def test_digests_and_vectors(filled):
    capture.backfill_vectors(filled, capture.hash_embedder(64))
    m = filled.current().first()
    assert len(m.vec) == 64 and sum(x * x for x in m.vec) == pytest.approx(1, abs=1e-5)
    assert capture.distill(filled, lambda p: "x" * 1201) == 0 and capture.distill(filled, lambda p: 1 // 0) == 0
    assert capture.distill(filled) == 1
    m = filled.current().first()
    assert m.digest.endswith(".") and m.vec is None and capture.missing_vectors(filled).count() == 1


def test_pool(spark):
    cases = [([[1.0, 0.0], [0.0, 1.0]], [0.5**0.5] * 2), ([[1.0, 0.0], [-1.0, 0.0]], None), ([], None), ([[float("nan"), 1.0]], None), (None, None)]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v array<array<double>>").select("i", vectors.mean_pool(F.col("v")).alias("p")).collect()
    for r in got:
        want = cases[r.i][1]
        assert r.p == (want if want is None else pytest.approx(want)), r.i


def test_embedder_agrees_with_columns(spark):
    text = spark.createDataFrame([("parser parser payment",), ("the of",)], "t string")
    vec = [r.v for r in text.select(capture.hash_embedder(32)(F.col("t")).alias("v")).collect()]
    at = [r.h for r in spark.createDataFrame([("parser",), ("payment",)], "w string").select(vectors.hashed_index(F.col("w"), 32).alias("h")).collect()]
    assert abs(vec[0][at[0]]) == pytest.approx(2 / 5**0.5) and abs(vec[0][at[1]]) == pytest.approx(1 / 5**0.5) and not any(vec[1])


def test_relink(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(i, "t", "o", 0.5)], "id string, task string, observation string, confidence double")
    links = spark.createDataFrame([("a", "b")], "id string, superseded_by string")
    s.record(row("a"))
    assert capture.relink(s, links) == 0
    s.record(row("b"))
    assert capture.relink(s, links) == 1 and capture.relink(s, links) == 0


def test_contexts(spark, filled):
    q = spark.createDataFrame([("q", "why does the loader cache parsed modules")], "qid string, question string")
    changes = spark.createDataFrame([(0, "src/load.ts", None, "modified", "abcdef0123", "2026-04-01")], "seq long, path string, previous_path string, kind string, sha string, d string").withColumn("date", F.to_timestamp("d")).drop("d")
    got = context.run_pipeline(filled, q, changes, trigram=False).collect()
    assert [(r.qid, r.place, r.possibly_stale, r.reason) for r in got] == [("q", 1, True, "modified src/load.ts in abcdef01")]
    assert "reason" not in context.run_pipeline(filled, q, trigram=False).columns
    assert [r.id for r in context.run_pipeline(filled, q, changes).collect()] == [r.id for r in got]
    broken = changes.withColumn("path", F.raise_error(F.lit("no history")).cast("string"))
    assert "reason" not in context.run_pipeline(filled, q, broken, trigram=False).columns  # staleness only advises
    assert context.mark_suspects(filled, changes) == {"changed_paths": 1, "candidates": 1, "marked": 1} and filled.current().first().suspect


def test_reverts(spark):
    rows = [("a" * 40, "one", "", 1), ("b" * 40, "two", "", 2), ("c" * 40, "x", "This reverts commit " + "a" * 8, 3), ("d" * 40, 'Revert "two"', None, 4), ("e" * 40, "two", "", 5), ("f" * 40, "y", "This reverts commit 1234567", 6), ("1234567" + "0" * 33, "p", "", 1), ("1234567" + "1" * 33, "q", "", 1)]
    got = history.reverts(spark.createDataFrame(rows, "sha string, subject string, body string, date int")).collect()
    assert {(r.source[0], r.target[0]) for r in got} == {("c", "a"), ("d", "b")}


def test_measures(spark):
    assert spark.range(1).select(evals.keyword_score(F.lit("The Parser"), [["lexer", "parser"], ["cache"]]).alias("s")).first().s == 0.5
    r = evals.slot_report(spark.createDataFrame([("a", 1, 2, 2, 3, 0), ("a", 2, 2, 1, 5, 1)], "arm string, qid int, wanted int, found int, returned int, links_used int")).first()
    assert (r.all_slots, r.slot_recall, r.mean_returned, r.links_used) == (0.5, 0.75, 4.0, 1)
