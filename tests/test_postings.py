"""The text leg's arrays against brute force, and that it moves neither tokens nor postings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import postings
from recollect.functions.stemming import StemNumbers, stem
from recollect.operators import retrieval
from recollect.plans import registry


def test_counts():
    r = random.Random(3)
    for _ in range(200):
        terms = list({tuple(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 9))})
        texts = [[r.choice("abcdx") for _ in range(r.randint(0, 12))] for _ in range(r.randint(0, 5))]
        t = postings.Terms([list(x) for x in terms])
        words = np.array([t.number.get(w, -1) for x in texts for w in x], np.int64)
        got = list(zip(*map(np.ndarray.tolist, t.counts(words, np.array([len(x) for x in texts], np.int64)))))
        want = [(i, j, sum(tuple(x[a : a + len(p)]) == p for a in range(len(x)))) for i, x in enumerate(texts) for j, p in enumerate(terms)]
        assert got == [w for w in want if w[2]]


def test_scores_and_best(monkeypatch):
    r = np.random.default_rng(5)
    for pairs in (1, 7, 500_000):
        monkeypatch.setattr(postings, "PAIRS", pairs)
        for questions in (3, 400):
            links = sorted({(int(r.integers(6)), int(r.integers(questions))) for _ in range(30)})
            asking = postings.Asking(np.array([a for a, _ in links]), np.array([b for _, b in links]), 6, questions)
            held = sorted({(int(r.integers(9)), int(r.integers(6))) for _ in range(25)})
            part = r.random(len(held))
            want = {}
            for (i, t), p in zip(held, part):
                for a, q in links:
                    if a == t:
                        want[q, i] = want.get((q, i), 0) + p
            runs = list(asking.scores(9, np.array([i for i, _ in held]), np.array([t for _, t in held]), part))
            got = [(q, i, s) for run in runs for q, i, s in zip(*map(np.ndarray.tolist, run))]
            assert len(got) == len(want) and {(q, i): s for q, i, s in got} == pytest.approx(want)
            best, kept = postings.Best(questions, 2), []
            for q, i, s in runs:
                keep = best.among(q, s, 1e-9)
                kept += zip(q[keep].tolist(), s[keep].tolist())
            for q in {q for q, _ in want}:
                top = sorted((s for (a, _), s in want.items() if a == q), reverse=True)[:2]
                assert sorted((s for a, s in kept if a == q), reverse=True)[:2] == pytest.approx(top)


def test_stem_numbers():
    known = StemNumbers({"retri": 0, "count": 1, "é": 2}, most=2)
    assert known.of("Retries retry, counted counting É naïve_count").tolist() == [0, 0, 1, 1, -1, -1, 1] and len(known) == 2
    assert [stem(w) for w in ("yyy", "syzygy", "ability", "conflated", "hopping", "flies", "x1ing")] == ["yyi", "syzygi", "abil", "conflat", "hop", "fli", "x1ing"]


@pytest.mark.parametrize("stemmed", [False, True])
def test_bm25_limit(spark, monkeypatch, stemmed):
    """With a limit the best stay, ties too; in blocks of few terms, with null and empty texts and memories that can't be answers."""
    r = random.Random(11)
    words = ["red", "green", "blue", "mango", "kiwi", "plum", "the", *(f"w{i}" for i in range(14))]  # in less than half of the texts
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 15))) for i in range(300)} | {300: None, 301: "mango kiwi", 302: "mango-kiwi", 303: "Mango_Kiwi"}
    docs = spark.createDataFrame([(i, x, i % 5 != 0) for i, x in texts.items()], "id long, text string, visible boolean").repartition(7)
    asked = {"a": "red plum", "b": "mango_kiwi", "c": "kiwi mango_kiwi_plum zebra", "d": "the of", "e": None}
    q = spark.createDataFrame(list(asked.items()), "qid string, question string")
    cut = {i: (x or "").lower().replace("-", " ").replace("_", " ").split() for i, x in texts.items()}
    average = sum(map(len, cut.values())) / len(cut)

    def places(t, ws):
        p = t.split("_")
        return sum(ws[a : a + len(p)] == p for a in range(len(ws)))

    want = {}
    for qid, terms in {"a": ["red", "plum"], "b": ["mango_kiwi"], "c": ["kiwi", "mango_kiwi_plum", "zebra"]}.items():
        for t in terms:
            tf = {i: n for i, ws in cut.items() if (n := places(t, ws))}
            idf = max(math.log((len(cut) - len(tf) + 0.5) / (len(tf) + 0.5)), 0) or 1e-6
            for i, n in tf.items():
                if i % 5:
                    want[qid, i] = want.get((qid, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(cut[i]) / average))
    for block in (1_000_000, 2):
        monkeypatch.setattr(retrieval, "ASKED_TERMS", block)
        every = {(x.qid, x.id): x.score for x in retrieval.bm25(q, docs, stemmed).collect()}
        assert every == pytest.approx(want)
        some = {(x.qid, x.id): x.score for x in retrieval.bm25(q, docs, stemmed, limit=3).collect()}
        assert len(some) < len(every) / 2 and some.items() <= every.items()
        for qid in "abc":
            least = sorted((s for (a, _), s in every.items() if a == qid), reverse=True)[2]
            assert {k for k in every if k[0] == qid and every[k] >= least} <= some.keys()


def test_bm25_moves_no_postings(spark):
    docs = spark.range(300_000).select("id", F.concat_ws(" ", F.lit("red"), (F.col("id") % 97).cast("string"), F.when(F.col("id") % 3 == 0, "mango kiwi")).alias("text"))
    q = spark.createDataFrame([(1, "mango_kiwi"), (2, "red")], "qid long, question string")
    hits = retrieval.bm25(q, docs, stemmed=False, limit=5)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.where("qid = 1").count() >= 5


def test_bm25_batch_moves_a_row_a_question(spark, tiny):
    """What is shuffled is each task's sums of a question, however many texts it meets."""
    plan = registry.queries()["bm25_batch"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(qid" in plan


@pytest.mark.parametrize("name", ["bm25_stemmed", "mrr_recall"])
def test_ranked_queries_rank_few(spark, tiny, monkeypatch, name):
    """What is ranked is each task's best, not every hit."""
    ranked, rank = [], registry._round_rank
    monkeypatch.setattr(registry, "_round_rank", lambda df, keys, k: ranked.append(df) or rank(df, keys, k))
    assert registry.queries()[name](spark, tiny).count()
    docs = registry.t(spark, tiny, "documents").select(F.col("doc_id").alias("id"), "text")
    assert ranked[0].count() < retrieval.bm25(registry.questions(spark, tiny), docs, stemmed=name == "bm25_stemmed").count()
