"""Measures of retrieval, links and agent runs, as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import Scratch
from .retrieval import spread


def keyword_score(text: Column, groups: list[list[str]]) -> Column:
    """The share of synonym groups of which the text holds a variant, in any case; 0 for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.greatest(*(F.contains(low, F.lit(v.lower())).cast("int") for v in [*g, g[0]])) for g in groups]
    return sum(hits[1:], hits[0]) / F.lit(float(len(groups)))


def run_summary(runs: DataFrame) -> DataFrame:
    """Means of score, turns and seconds and the summed cost of each condition (condition, score, turns, seconds, cost)."""
    return runs.groupBy("condition").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("score", "turns", "seconds")), F.sum("cost").alias("total_cost"))


def slot_report(slots: DataFrame) -> DataFrame:
    """For each arm (arm, qid, wanted, found, returned, links_used): share of questions with all slots found, slot recall, mean returned, links used."""
    return slots.groupBy("arm").agg(F.count("*").alias("questions"), F.avg((F.col("found") == F.col("wanted")).cast("int")).alias("all_slots"), (F.sum("found") / F.nullif(F.sum("wanted"), F.lit(0))).alias("slot_recall"), F.avg("returned").alias("mean_returned"), F.sum("links_used").alias("links_used"))


def precision_by(samples: DataFrame) -> DataFrame:
    """(relation, n, precision) of judged samples (relation, good)."""
    return samples.groupBy("relation").agg(F.count("*").alias("n"), F.avg(F.col("good").cast("double")).alias("precision"))


def weighted_precision(samples: DataFrame, population: DataFrame) -> DataFrame:
    """Sampled precision of each relation (relation, good) weighted by its population (relation, n): one row of precision and weighted."""
    per = samples.groupBy("relation").agg(F.count("*").alias("k"), F.sum(F.col("good").cast("int")).alias("good")).join(population, "relation")
    return per.agg((F.sum("good") / F.sum("k")).alias("precision"), (F.sum(F.col("good") / F.col("k") * F.col("n")) / F.sum("n")).alias("weighted"))


def credit_histogram(credits: DataFrame) -> DataFrame:
    """How many memories have each total of credit (id, credit)."""
    return credits.groupBy("id").agg(F.sum("credit").alias("credit")).groupBy("credit").agg(F.count("*").alias("n"))


#: Questions up to which their keys are broadcast.
MOST_KEYS = 200_000


def contained(questions: DataFrame, docs: DataFrame, width: int = 4) -> DataFrame:
    """(qid, id) of each text (id, text) that holds a question (qid, question) as it stands.

    Where a text holds a question, the question's inner words stand in it one after the other. So texts and questions
    meet by `width` words from a question's second on; what meets is then compared as a whole. Questions with fewer
    inner words meet by their first inner word, and those without any are compared with all texts, as a stated set.
    """
    words = F.split("question", " ")
    q = questions.where("question is not null").select("qid", "question", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("inner"))
    q = q.select("qid", "question", F.when(F.size("inner") >= width, width).otherwise(F.least(F.size("inner"), F.lit(1))).alias("w"), "inner")
    first = lambda n: F.xxhash64(*(F.element_at("inner", j) for j in range(1, n + 1)))
    keys = q.where("w > 0").select("qid", "question", "w", F.when(F.col("w") == width, first(width)).otherwise(first(1)).alias("key"))
    keys = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
    cut = spread(docs.where("text is not null").select("id", "text")).select("id", "text", F.split("text", " ").alias("ts"))
    windows = lambda w: F.when(F.size("ts") >= w, F.transform(F.sequence(F.lit(1), F.size("ts") - (w - 1)), lambda i: F.xxhash64(*(F.element_at("ts", i + j) for j in range(w))))).otherwise(F.array().cast("array<bigint>"))
    used = {r.w for r in q.select("w").distinct().collect()}
    out = docs.sparkSession.createDataFrame([], StructType([questions.schema["qid"], docs.schema["id"]])).toDF("qid", "id")
    for w in sorted(used - {0}):
        met = cut.select("id", "text", F.explode(F.array_distinct(windows(w))).alias("key")).join(keys.where(F.col("w") == w), "key")
        out = out.unionAll(met.where(F.contains("text", F.col("question"))).select("qid", "id").distinct())
    if 0 in used:
        short = q.where("w = 0").select("qid", "question")
        out = out.unionAll(cut.join(F.broadcast(short), F.contains(cut.text, short.question)).select("qid", "id"))
    return out


def seeded_shuffle(items: list, seed: int) -> list:
    """A shuffle by xorshift32, the same on every machine: what a sample of labels is drawn by. Sequential, on the driver."""
    state, out = seed & 0xFFFFFFFF, list(items)
    for i in range(len(out) - 1, 0, -1):
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        j = state * (i + 1) >> 32
        out[i], out[j] = out[j], out[i]
    return out


def label_sample(edges: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """At most k edges (source, target, relation) of each relation to be labelled: those of the least hash of seed and ends.

    The same for one seed, whatever the order of rows; a relation's rows are cut to k before they are shuffled.
    """
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string")))
    order = Window.partitionBy("relation").orderBy("drawn", "source", "target")
    return edges.select("source", "target", "relation", drawn.alias("drawn")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("drawn")


def rewired(edges: DataFrame, seed: int = 1, rounds: int = 60) -> DataFrame:
    """(source, target, confidence): a random graph of the same degrees that holds none of the edges (source, target, confidence), each of which is there once.

    The control of an arm with links. In each round the edges that are still old are paired with others by seeded
    hashes, and a pair swaps its targets where that makes two edges that are new, no loops, and not there yet. A graph
    too dense for it is an error after the last round.
    """
    scratch = Scratch(edges.sparkSession, "rewired")
    old = scratch.keep(edges.select("source", "target"), "old")
    now = scratch.keep(edges.select("source", "target", "confidence", F.lit(True).alias("old")), "0")
    ends = ["source", "target"]
    groups = max(1, now.count() // 50_000)
    for n in range(1, rounds + 1):
        if now.where("old").isEmpty():
            return now.drop("old")
        draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(n), F.lit(salt), *ends)
        dealt = now.withColumn("g", F.pmod(draw("group"), F.lit(groups))).withColumn("asks", F.pmod(draw("role"), F.lit(2)) == 0)  # an edge asks or is asked, not both
        place = lambda salt: F.row_number().over(Window.partitionBy("g").orderBy(draw(salt), *ends))
        first = dealt.where("old and asks").withColumn("p", place("first"))
        partner = dealt.where("not asks").withColumn("p", place("partner")).select("g", "p", *(F.col(c).alias(f"{c}2") for c in ("source", "target", "confidence", "old")))
        pairs = first.join(partner, ["g", "p"]).where("source <> source2 and target <> target2 and source <> target2 and source2 <> target")
        pairs = pairs.withColumn("pair", F.struct(*ends))
        # Each pair uses two edges and makes two: good is what nothing else uses, makes, or has.
        entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
        used = F.explode(F.array(entry("used", "source", "target"), entry("used", "source2", "target2"), entry("made", "source", "target2"), entry("made", "source2", "target")))
        own = pairs.select("pair", used.alias("e"))
        taken = now.select(*ends).unionAll(old).select(F.lit(None).cast(pairs.schema["pair"].dataType).alias("pair"), entry("made", *ends).alias("e"))
        alone = own.unionAll(taken).groupBy("e").agg(F.count("*").alias("n"), F.min("pair").alias("pair")).where("n = 1 and pair is not null")
        whole = alone.groupBy("pair").agg(F.count("*").alias("n")).where("n = 4").select("pair")
        good = scratch.keep(pairs.join(whole, "pair", "left_semi"), f"good-{n}")
        gone = good.select(*ends).unionAll(good.select("source2", "target2"))
        fresh = good.select("source", F.col("target2").alias("target"), "confidence", F.lit(False).alias("old")).unionAll(good.select("source2", "target", "confidence2", F.lit(False)))
        now = scratch.keep(now.join(gone, ends, "left_anti").unionAll(fresh), str(n))
    raise ValueError("the graph can't be rewired")


def linked_arm(ranked: DataFrame, edges: DataFrame, k: int | None, seeds: int) -> DataFrame:
    """(qid, id, place, provenance): k hits of each question, some of them replaced by neighbours of the first.

    Without k all hits and all neighbours of the first: what links could add at most. With rewired() edges it is the control.

    ranked: (qid, id, rank); edges: (source, target, confidence). The first `seeds` hits stay; their neighbours over
    edges either way follow, the most confident first, then those of the better seed; what is left is backfilled by rank.
    """
    best = Window.partitionBy("qid", "id").orderBy("step", F.desc("confidence"), "rank")
    place = Window.partitionBy("qid").orderBy("step", F.desc("confidence"), "rank", "id")
    none = F.lit(None).cast("double").alias("confidence")
    within = lambda c: F.lit(True) if k is None else F.col(c) <= k
    hits = ranked.where(within("rank"))
    first = hits.where(F.col("rank") <= seeds)
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "confidence").unionAll(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "confidence"))
    near = first.join(both, "id").select("qid", F.col("other").alias("id"), "rank", F.lit(1).alias("step"), F.col("confidence").cast("double").alias("confidence"))
    own = hits.select("qid", "id", "rank", F.when(F.col("rank") <= seeds, 0).otherwise(2).alias("step"), none)
    every = own.unionByName(near).withColumn("b", F.row_number().over(best)).where("b = 1").withColumn("place", F.row_number().over(place)).where(within("place"))
    return every.select("qid", "id", "place", F.when(F.col("step") == 1, "linked").when(F.col("step") == 0, "by_meaning").otherwise("backfill").alias("provenance"))
