"""The lexicon's matching against a plain search, what is learnt, and accuracy on rows that nothing was learnt from."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import toxicity as T


def test_folding():
    assert T.folded("1D10T tr@sh ѕсυм ＬＯＳＥＲ m​oron st|upid!") == "idiot trash scum loser moron stlupid!"
    assert T.folded("$$$ trash### |x| a!b") == "$$$ trash### |x| aib"
    assert T.folded(None) == T.folded("") == ""
    assert T.folded("Ré É") == "ré é"


def test_hits_against_plain_search():
    rng = random.Random(3)
    stems = {"ab": 1.0, "abc": 2.0, "bca": 3.0, "c": 0.5}
    exceptions = ("abc x", "bca")
    for _ in range(300):
        low = "".join(rng.choice("abcx -") for _ in range(rng.randrange(60)))
        spared = [m.span() for e in exceptions if e not in stems for m in re.finditer(rf"(?<![a-z])(?={e}(?![a-z]))", low)]
        spared = [(s, s + len(e)) for s, _ in spared for e in exceptions if e not in stems and low.startswith(e, s)]
        want = []
        for m in re.finditer(r"(?<![a-z])[a-z]", low):
            own = [s for s in stems if low.startswith(s, m.start())]
            if own:
                best = max(own, key=len)
                span = (m.start(), m.start() + len(best))
                if not any(a <= span[0] and span[1] <= b for a, b in spared):
                    want.append((*span, stems[best]))
        assert T.hits(low, T.automaton(T.Lexicon(stems, exceptions))) == want
    assert T.hits("abc", T.automaton(T.Lexicon())) == []


def test_scores_fall_with_length_and_exceptions(spark):
    lex = T.Lexicon({"idiot": 6.0}, ("idiot proof",), (-6.0, 3.0, 0.5))
    texts = [(1, "you idiot"), (2, "you " * 400 + "idiot"), (3, "an idiot proof thing"), (4, None), (5, ""), (6, "ID1OT " * 100_000)]
    got = {r.doc_id: r.score for r in T.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), lex).collect()}
    assert got[1] > got[2] > got[3] == got[4] == got[5] and got[6] >= got[1] and all(0 <= s <= 1 for s in got.values())


def test_odd_tables(spark):
    rows = [(None, "trash"), (3, None), (3, None), (4, ""), (5, "x " * 50_000), (6, "same"), (6, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(None, 1), (3, 1), (3, 0), (4, None), (99, 1), (5, 7)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    for own in (labels, labels.limit(0)):
        got = T.judge_toxicity(docs, own)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        out = got.collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        assert collections.Counter((r.doc_id, r.held_out) for r in out) == collections.Counter((i, held(i)) for i, _ in rows)
        assert all(r.predicted == (r.score >= 0.7) for r in out)
    assert T.judge_toxicity(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, T.learn(docs, labels)


def test_held_out_accuracy(spark, judged):
    docs, labels, lex = judged
    own = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(T.held_out(F.col("doc_id")))
    got = T.score_texts(own, lex).join(labels.select("doc_id", "toxic"), "doc_id").select("toxic", (F.col("score") >= 0.7).cast("int").alias("p")).collect()
    n = collections.Counter(map(tuple, got))
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.9 and n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.97


def test_disguised_words_are_found(spark, judged):
    """Toxic English texts whose letters are replaced by digits, signs and other scripts' letters keep their verdict."""
    docs, labels, lex = judged
    own = docs.join(labels.where("toxic = 1"), "doc_id").where("lang = 'en'")
    look = {v: k for k, v in T.LOOK_ALIKE.items()}
    plain = T.score_texts(own, lex).where("score >= 0.7").count()
    disguised = own.withColumn("text", F.translate(F.translate("text", "aos", look["a"] + look["o"] + look["s"]), "ie", "13"))
    assert plain > 200 and T.score_texts(disguised, lex).where("score >= 0.7").count() >= 0.97 * plain


def test_nothing_is_learnt_from_held_out_rows(spark, judged):
    docs, labels, lex = judged
    changed = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = T.learn(docs.withColumn("text", F.when(T.held_out(F.col("doc_id")), "trash").otherwise(F.col("text"))), changed)
    assert other == lex
