"""Golden cases and properties of the engine's functions and operators."""

import subprocess

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recollect.functions import anchors, similarity, stemming, text, vectors
from recollect.operators import history, retrieval, store


def test_stems():
    golden = "prototypes prototyp running run relational relat conditional condit rationally ration troubled troubl skies ski sky sky happy happi hopping hop agreed agre plastered plaster generalizations gener oscillators oscil".split()
    assert [stemming.stem(w) for w in golden[::2]] == golden[1::2]
    assert stemming.index_terms("Café foo_bar O'Neil $ZodCatch") == ["cafe", "foo", "bar", "o", "neil", "zodcatch"]


def test_word_similarity():
    assert similarity.trigrams("cat") == ["  c", " ca", "cat", "at "]
    assert similarity.word_similarity("cat dog", "dog cat") == 1.0
    assert similarity.word_similarity("parser loader config", "parser", 0.35) == pytest.approx(0.35)
    assert similarity.word_similarity("alpha bravo charlie delta", "alpha") == pytest.approx(0.2307692308)
    assert similarity.word_similarity("small blue ring", "small ring") == 0.6875
    assert similarity.word_similarity("", "cat") == 0 and similarity.word_similarity("cat", "dog") == 0


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=18))
def test_word_similarity_is_exhaustive(q, t):
    want, seq = set(similarity.trigrams(q)), similarity.trigrams(t)
    brute = max((len(want & set(seq[i:j])) / len(want | set(seq[i:j])) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)), default=0.0) if want else 0.0
    assert similarity.word_similarity(q, t) == pytest.approx(brute)


def test_chunks():
    assert similarity.chunks("short") == ["short"]
    got = similarity.chunks(" " * 50 + "word\n" * 500, 100)
    assert all(c.strip() and len(c) <= 100 for c in got) and " ".join(got).split() == ["word"] * 500
    assert [len(c) for c in similarity.chunks("x" * 250, 100)] == [100, 100, 50]


def test_query_terms(spark):
    rows = [("Why does the record parser skip __proto__?", "record parser skip __proto__"), ("what does $ZodCatch do in regexes.ts", "zod catch regexes"), ("why is it that we do this?", "")]
    got = spark.createDataFrame(rows, "q string, want string").select(F.array_join(text.query_terms(F.col("q")), " ").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha delta"), (3, "beta running runs"), (4, "alpha epsilon café"), (5, "alpha zeta foo_bar baz"), (6, None)][:5], "id long, text string")
    asked = ["alpha", "run", "delta", "foo_bar", "foo", "beta alpha"]
    got = {(r.qid, r.id): r.score for r in retrieval.bm25(spark.createDataFrame([(q, q) for q in asked], "qid string, question string"), docs).collect()}
    golden = {("alpha", 2): 1.4220532e-06, ("alpha", 1): 1.0505618e-06, ("alpha", 4): 1.0505618e-06, ("alpha", 5): 8.3856502e-07, ("run", 3): 1.5622851557, ("delta", 2): 1.1541601010, ("foo_bar", 5): 0.9212578385, ("foo", 5): 0.9212578385}
    golden |= {("beta alpha", 1): 0.3534859284, ("beta alpha", 3): 0.3534848779, ("beta alpha", 2): 1.4220532e-06, ("beta alpha", 4): 1.0505618e-06, ("beta alpha", 5): 8.3856502e-07}
    assert set(got) == set(golden) and all(got[k] == pytest.approx(golden[k], rel=1e-6) for k in golden)


def test_phrase_is_not_its_words(spark):
    docs = spark.createDataFrame([(1, "alpha zeta foo_bar baz"), (2, "bar then foo")], "id long, text string")
    asked = spark.createDataFrame([("q", "foo_bar")], "qid string, question string")
    for stemmed in (True, False):
        assert [r.id for r in retrieval.bm25(asked, docs, stemmed).collect()] == [1]


def test_vector_leg(spark):
    import random

    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    mem = [(i, vec()) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    asked = [(i, vec()) for i in range(5)] + [(5, None), (6, [0.0] * 8)]
    m, q = spark.createDataFrame(mem, "id long, vec array<float>"), spark.createDataFrame(asked, "qid long, vec array<float>")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {(a, b): cosine(x, y) for a, x in asked if x for b, y in mem if y}
    for block in (4096, 2):
        got = {(r.qid, r.id): r.score for r in retrieval.vector_leg(q, m, block=block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    top = [(r.qid, r.id) for r in retrieval.vector_leg(q, m.coalesce(1), limit=7).collect()]
    for a, x in asked[:5]:
        best = sorted((b for b, y in mem if y), key=lambda b: -want[a, b])[:7]
        assert set(best) <= {b for i, b in top if i == a}
    assert retrieval.vector_leg(q.limit(0), m).count() == 0
    with pytest.raises(Exception, match="width"):
        retrieval.vector_leg(spark.createDataFrame([(1, [1.0])], "qid long, vec array<float>"), m).collect()


def test_trigram_leg_is_exhaustive(spark):
    import random

    rng = random.Random(9)
    word = lambda: rng.choice(["parser", "loader", "cache", "config", "reader", "parse", "load", "the", "tree", "écrit"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 12, 60])))) for i in range(60)] + [(60, None), (61, "  ")]
    asked = [(i, " ".join(word() for _ in range(1 + i % 4))) for i in range(12)] + [(12, " "), (13, None)]
    got = {(r.qid, r.id): r.score for r in retrieval.trigram_leg(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(docs, "id long, text string")).collect()}

    def brute(q, t):
        want, seq = set(similarity.trigrams(q)), similarity.trigrams(t)
        best = 0.0
        for i in range(len(seq)):
            seen = set()
            for x in seq[i:]:
                seen.add(x)
                best = max(best, len(want & seen) / len(want | seen))
        return best

    want = {(a, b): s for a, q in asked if q and q.strip() for b, t in docs for s in [brute(q, t)] if s >= 0.35}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_contained(spark):
    from recollect.operators import evals

    docs = [(1, "x alpha beta gamma delta epsilon zeta y"), (2, "alpha beta gamma delta epsilon"), (3, "prealpha beta gamma delta epsilon zetapost"), (4, "alpha  beta"), (5, None), (6, "beta gamma"), (7, "one")]
    asked = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma"), (3, "alpha  beta"), (4, "beta"), (5, "beta gamma"), (6, None), (7, "nothing of this is there at all")]
    got = {(r.qid, r.id) for r in evals.contained(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(docs, "id long, text string")).collect()}
    assert got == {(a, b) for a, q in asked if q for b, t in docs if t and q in t}


def test_policy_forms_agree(spark):
    from recollect.functions import policy

    cases = [(t, c, r) for t in ("short", "mid", "long") for c in range(4) for r in range(5)]
    got = spark.createDataFrame(cases, "t string, c int, r int").select("t", "c", "r", policy.tier_decision(F.col("t"), F.col("c"), F.col("r"), F.lit(0.0)).tier.alias("to")).collect()
    assert all(x.to == policy.next_tier(x.t, x.c, x.r) for x in got)


def test_tiers_without_memories_are_counted(spark):
    from recollect.operators import tiers

    rows = spark.createDataFrame([(1, "mid"), (2, "mid"), (3, "long")], "id long, tier string")
    assert {r.tier: r.n for r in tiers.histogram(rows).collect()} == {"short": 0, "mid": 2, "long": 1}
    assert {r.tier: r.n for r in tiers.histogram(rows.limit(0)).collect()} == {"short": 0, "mid": 0, "long": 0}


def test_gap_labels(spark):
    hours = [0.0, 1.0, 47.9, 48.0, 24_000.0]
    got = spark.createDataFrame([(h, h * 3_600_000.0) for h in hours], "h double, ms double").orderBy("h").select(text.gap_label(F.col("ms")).alias("g")).collect()
    assert [r.g for r in got] == ["0.0h", "1.0h", "47.9h", "2.0d", "1000.0d"]


def test_change_touches_agrees_with_verdicts(spark):
    changes = [(0, "b", "a", "renamed", "s0", 5), (1, "c", "b", "renamed", "s1", 6), (2, "x", None, "modified", "s2", 7), (3, "c", None, "modified", "s3", 8), (4, "a", None, "modified", "s4", 1)]
    feed = spark.createDataFrame(changes, "seq long, path string, previous_path string, kind string, sha string, date long")
    mem = spark.createDataFrame([(i, 0, False, None) for i in range(4)], "id long, as_of long, suspect boolean, suspect_reason string")
    named = spark.createDataFrame([(0, "a"), (1, "b"), (2, "x"), (3, "none")], "id long, path string")
    closure = history.path_closure(named.select("path"), history.rename_map(feed))
    got = {r.id: r.n_changes for r in history.verdicts(named, mem, feed, closure).collect()}
    names = named.join(closure, "path").groupBy("id").agg(F.collect_set("name").alias("names"))
    pairs = names.crossJoin(feed).where(anchors.change_touches(F.col("path"), F.col("previous_path"), F.col("names"))).groupBy("id").count().collect()
    assert got == {0: 0, 1: 0, 2: 0, 3: 0} | {r.id: r["count"] for r in pairs} and got[0] == 4 and got[1] == 3


def test_pages(spark):
    rows = spark.range(0, 95, 3).withColumnRenamed("id", "k")
    seen, after = [], None
    while page := [r.k for r in store.page_after(rows, "k", after, 10).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == list(range(0, 95, 3))


@pytest.mark.parametrize("stemmed", [False, True])
def test_bm25_phrases(spark, stemmed):
    import math

    docs = spark.createDataFrame([(1, "set retry_count here, retry count there"), (2, "retry the count"), (3, "count retry"), (4, "Retry-Count"), (5, "foo foo foo"), (6, "foo_foo bar"), (7, "x"), (8, "y"), (9, "z"), (10, "w")], "id long, text string")
    asked = spark.createDataFrame([("snake", "retry_count"), ("twice", "foo_foo"), ("none", "___"), ("both", "retry retry_count")], "qid string, question string")
    got = {(r.qid, r.id): r.score for r in retrieval.bm25(asked, docs, stemmed).collect()}

    def part(df, tf, length):
        return math.log((10 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 2.4))

    assert {k for k in got if k[0] in ("snake", "twice", "none")} == {("snake", 1), ("snake", 4), ("twice", 5), ("twice", 6)}
    assert got["snake", 1] == pytest.approx(part(2, 2, 7)) and got["snake", 4] == pytest.approx(part(2, 1, 2))
    assert got["twice", 5] == pytest.approx(part(2, 2, 3)) and got["twice", 6] == pytest.approx(part(2, 1, 3))
    assert got["both", 3] == pytest.approx(part(4, 1, 2)) and got["both", 4] == pytest.approx(part(4, 1, 2) + part(2, 1, 2))


def test_anchors_and_hashes(spark):
    cases = [("src/parse.ts#parseAnchor", "src/parse.ts", "parseAnchor"), ("docs/note#2.md#heading", "docs/note#2.md", "heading"), ("src/parse.ts#", "src/parse.ts#", None), ("docs/C#-notes.md", "docs/C#-notes.md", None), ("test/fixtures/issue#123.ts", "test/fixtures/issue#123.ts", None), ("src/a.ts#Class.method", "src/a.ts", "Class.method")]
    got = spark.createDataFrame(cases, "t string, p string, s string").select(anchors.parse_anchor(F.col("t")).alias("a"), "p", "s").collect()
    assert all((r.a.path, r.a.symbol) == (r.p, r.s) for r in got)
    assert anchors.unquote_git_path('"caf\\303\\251 \\"x\\".md"') == 'café "x".md'
    h = spark.createDataFrame([("parser",), ("payment",), ("service",)], "w string").select(vectors.fnv1a(F.col("w")).alias("h")).collect()
    assert [r.h for r in h] == [3779714746, 3013747057, 1457512036]
    p = spark.range(1).select(vectors.length_prior(F.lit(4000)).alias("a"), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert p.a == pytest.approx(0.5906161091) and p.z == 0.0


def test_chains(spark):
    links = spark.createDataFrame([("v1", "v2"), ("v2", "v3"), ("v3", None), ("A", "C"), ("B", "C"), ("C", None)], "id string, superseded_by string")
    assert {r.id: r.head for r in history.heads(links).collect()} == {"v1": "v3", "v2": "v3", "v3": "v3", "A": "C", "B": "C", "C": "C"}
    for start in ("A", "B", "C"):
        assert {(r.id, r.depth) for r in history.chain_of(links, start).collect()} == {("A", 0), ("B", 0), ("C", 1)}
    assert [(r.id, r.depth) for r in history.chain_of(links, "v2").collect()] == [("v1", 0), ("v2", 1), ("v3", 2)]
    assert history.chain_of(links, "nobody").count() == 0 and history.walk(links, "v1") == ["v1", "v2", "v3"]
    cycle = spark.createDataFrame([("p", "q"), ("q", "p")], "id string, superseded_by string")
    for call in (lambda: history.walk(cycle, "p"), lambda: history.heads(cycle, 8)):
        with pytest.raises(ValueError):
            call()
    asked = spark.createDataFrame([("v3", "v1"), ("v1", "v1"), ("v1", "A"), ("v1", "v2"), ("C", "x"), ("v3", "A")], "old string, new string")
    assert {(r.old, r.new): r.verdict for r in history.would_cycle(links, asked).collect()} == {("v3", "v1"): "cycle", ("v1", "v1"): "self", ("v1", "A"): "fork", ("v1", "v2"): "same", ("C", "x"): "unknown", ("v3", "A"): "ok"}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "previous_path string, path string")
    assert {(r.path, r.name) for r in history.path_closure(ring.select("path"), ring).collect()} == {(x, y) for x in "ab" for y in "ab"}


def test_path_closure_of_many_renames(spark):
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(200)], "previous_path string, path string").coalesce(1)
    start = spark.createDataFrame([("p0",)], "path string")
    assert {r.name for r in history.path_closure(start, chain).collect()} == {f"p{i}" for i in range(201)}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "t", "o", 0.7), ("b", "t", "o", 0.5)], "id string, task string, observation string, confidence double")
    assert s.record(rows) == 2 and s.record(rows) == 0
    with pytest.raises(ValueError):
        s.record(rows.withColumn("confidence", F.lit(1.5)))
    s.note(spark.createDataFrame([("a", "suspect", "modified x")], "id string, kind string, text string"))
    assert s.current().where("id = 'a'").first().suspect
    assert s.supersede("a", "b", "2026-01-01T00:00:00Z") and not s.supersede("a", "b", "2026-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        s.supersede("b", "a", "2026-01-01T00:00:00Z")
    now = {r.id: r for r in s.current().collect()}
    assert now["a"].superseded_by == "b" and not now["a"].suspect and now["b"].superseded_by is None


def test_context(spark):
    rows = [("a", "x", None, None, None, None, None, None), ("b", "y", 2, "t2", None, None, None, None), ("b", "y", 1, "t", "r", ["l"], "old", "why")]
    kind = "qid string, question string, place int, task string, result string, lessons array<string>, staleness string, staleness_reason string"
    got = {r.qid: r.context for r in store.render_contexts(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"] == "# Context: x\n\n## Prior Experience\n\n_No prior knowledge recorded for this task._"
    assert got["b"] == "# Context: y\n\n## Prior Experience\n\n- [t] r — **old** (why)\n  - l\n- [t2] (no recorded outcome)"


def test_git_sources(spark, tmp_path):
    from recollect.sources import git

    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.txt").write_text("some text that is long enough for a rename to be seen\n" * 5)
    run("add", "."), run("commit", "-qm", "one", "-m", "because " + "words " * 60)
    run("mv", "a.txt", "b é.txt"), run("commit", "-qm", "two")
    assert [r.subject for r in git.commits(spark, str(tmp_path)).collect()] == ["one"]
    feed = git.changed_paths_since(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.kind, r.path, r.previous_path) for r in feed] == [("renamed", "b é.txt", "a.txt"), ("added", "a.txt", None)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("x")
    run("add", "."), run("commit", "-qm", "three", "-m", "because " + "words " * 60)
    for n in range(3):
        (tmp_path / "other.txt").write_text(str(n))
        run("add", "."), run("commit", "-qm", f"other {n}", "-m", "because " + "words " * 60)
    assert [r.subject for r in git.commits(spark, str(tmp_path), "sub", limit=1).collect()] == ["three"]  # the limit counts within the scope
    assert [r.path for r in git.changed_paths_since(spark, str(tmp_path), limit=1, paths=["sub"]).collect()] == ["sub/c.txt"]
    assert git.corpus_revision(str(tmp_path)) in run_out(tmp_path)


def run_out(path):
    return subprocess.run(["git", "-C", str(path), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout


def test_any_anchor(spark, tmp_path):
    from recollect.sources import files

    (tmp_path / "r.json").write_text('{"task": "t", "understanding": "u", "anchors": ["src/a.ts#f", {"path": "src/b.ts"}, {"path": "src/c.ts", "symbol": "g"}, " ", {"path": " "}]}')
    got = files.judged_reports(files.scout_reports(spark, str(tmp_path / "r.json"))).first().anchors
    assert [tuple(a) for a in got] == [("src/a.ts", "f"), ("src/b.ts", None), ("src/c.ts", "g")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
