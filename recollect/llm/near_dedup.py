"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: round i < t throws every shingle into a pseudorandom bin, round i >= t throws all of them into bin i - t; a bin
keeps its smallest (round, hash), so each of the t coordinates is filled after at most 2t rounds.

Documents with equal shingle sets become one class first, so copies never meet in pairs. Classes that agree on a band
share a bucket. A bucket emits no pairs of its own: every member is held against the bucket's most central member only
(linear), and what is linked contracts into components. For buckets that still hold several components, the members are
joined exactly: rarest-first prefixes of the full sets with length and positional filters, across components only. The
smaller set of a pair offers the short prefix that it needs as the smaller one, the larger set asks with the long one;
so texts that share a core and differ too much in the rest do not meet at all. A link is lost only if a pair agrees on
no band at all, which at the threshold has probability (1 - s^rows)^bands, 5e-8 by default.

Hot shingles: those that more than one row in SPLIT holds are at most SPLIT, so what is known of them is broadcast, and
their rows are dealt in blocks of BLOCK, each block of askers against each block of offers as a key of its own. All
other shingles are too rare to weigh on a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .text import U, ascii_words, mix, shingles, word_hashes

MAX = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of the Arrow batches of whole texts that a Python worker gets.
BATCH_BYTES = 2 << 20
#: Shingles held by more than one of SPLIT rows are hot; there are at most SPLIT of them.
SPLIT = 5000
#: Rows of a hot shingle in one block.
BLOCK = 512


def fast_similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each nonempty set; t is a power of two up to 256."""
    out = np.full(len(sets) * t, MAX, U)
    live, size = np.arange(len(sets)), np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(live, size)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(items + mix(np.array([i + 1], U)))
        slot = (h & U(t - 1)).astype(np.int64) if i < t else np.full(len(items), i - t)
        np.minimum.at(out, owner * t + slot, (U(i) << U(55)) | (h >> U(9)))
        open_ = (out.reshape(-1, t)[live] == MAX).any(axis=1)
        if not open_.all():
            live = live[open_]
            mask = np.isin(owner, live)
            items, owner = items[mask], owner[mask]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    rows = sketch.shape[1] // bands
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key + sketch.reshape(len(sketch), bands, rows)[:, :, r])
    return key.view(np.int64)


def _chunks(batch: pa.RecordBatch, k: int, most: int = 200_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, sets, total = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        s = shingles(word_hashes(ascii_words(text.as_py())), k)
        ids.append(doc_id)
        sets.append(s)
        total += len(s)
        if total > most:
            yield ids, sets
            ids, sets, total = [], [], 0
    if ids:
        yield ids, sets


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _chunks(batch, k):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(fast_similarity_sketch([sets[i] for i in full], bands * rows), bands)
                row = dict(zip(full, keys))
                digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digest], pa.int64()),
                        pa.array([d[1] for d in digest], pa.int64()),
                        pa.array([row[i] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _chunks(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "items"])

    return run


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of every node of edges (a, b), comp the smallest node of its component.

    Alternating large-star and small-star steps: minima are combined before the shuffle, and a hub's edges only ever
    meet its single minimum, in joins that adaptive execution can split.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    step = 0
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-l{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        step += 1
        now = scratch.keep(small.distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-l{step - 1}")
        before, mark = mark, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots), f"{name}-out")


def _asked(n: str, percent: int) -> str:
    """How many of its rarest tokens a set of n must look at to meet every smaller set that it is linked with."""
    return f"{n} - ({percent} * {n} + 99) div 100 + 1"


def _offered(n: str, percent: int) -> str:
    """How many of its rarest tokens a set of n must show to be met by every set at least as large that it is linked with."""
    return f"{n} - ({2 * percent} * {n} + {99 + percent}) div {100 + percent} + 1"


def _with_frequency(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """tokens (h, ...) with the df of frequency (h, df); rows of hot tokens stay where they are."""
    limit = _hot(tokens)
    hot = F.broadcast(frequency.where(F.col("df") > limit))
    rest = tokens.join(hot.select("h"), "h", "left_anti")
    return tokens.join(hot, "h").unionByName(rest.join(frequency.where(F.col("df") <= limit), "h"))


def _hot(rows: DataFrame) -> int:
    """The count that at most SPLIT keys of these rows exceed."""
    return rows.count() // SPLIT


def candidates(prefix: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of different comp that pass all filters, from the rows (rep, n, comp, h, pos) of the long prefixes.

    A pair of sizes m <= n shares at least percent / (100 + percent) * (m + n) tokens if it is linked. So it shares one
    that lies in the long prefix of the larger set and the short prefix of the smaller one; equal sizes go by rep. Keys
    are the token, the larger set's length class (a factor of 100 / percent each) and the two blocks.
    """
    limit = _hot(prefix)
    held = scratch.keep(prefix.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("h", "c"), "met")
    hot = F.broadcast(held.where(F.col("c") > limit).select("h", F.expr(f"(c + {BLOCK - 1}) div {BLOCK}").alias("blocks")))
    cold = held.where(F.col("c") <= limit).select("h", F.lit(1).cast("long").alias("blocks"))
    rows = prefix.join(hot, "h").unionByName(prefix.join(hot.select("h"), "h", "left_anti").join(cold, "h"))
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # A set and one of at most 100 / percent times its size lie in the same or the next class.
    rows = rows.withColumn("length", F.floor(F.ln("n") / F.ln(F.lit(100 / percent)) + 1e-9))
    named = lambda s: [F.col(c).alias(c + s) for c in ("rep", "n", "comp", "pos")]
    asked = rows.select("h", "length", F.col("own").alias("x"), F.col("other").alias("y"), *named("_a"))
    offered = rows.where(f"pos <= {_offered('n', percent)}").withColumn("length", F.explode(F.array("length", F.col("length") + 1)))
    offered = offered.select("h", "length", F.col("other").alias("x"), F.col("own").alias("y"), *named("_b"))
    pairs = asked.join(offered, ["h", "length", "x", "y"]).where("(n_b < n_a or (n_b = n_a and rep_b < rep_a)) and comp_a <> comp_b").where(f"100 * n_b >= {percent} * n_a")
    pairs = pairs.where(f"(100 + {percent}) * (1 + least(n_a - pos_a, n_b - pos_b)) >= {percent} * (n_a + n_b)")
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text; further columns are ignored).

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles. component_id is
    the smallest doc_id reachable over links. Null or wordless texts have no shingles and are linked with nothing. A
    null doc_id is linked with nothing, has a null component and is kept. Repeated rows of one doc_id are one node. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.keep(docs.mapInArrow(_sketches(k, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches", BATCH_BYTES)
    some = sig.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.keep(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")

    banded = some.join(reps, ["s1", "s2"]).where("doc_id = rep").select("rep", "n", F.explode("bands").alias("key"))
    groups = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = scratch.keep(banded.join(groups, "key"), "buckets")
    central = buckets.groupBy("rep").agg(F.sum("c").alias("deg"))
    ranked = buckets.join(central, "rep")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("deg", F.expr("-rep").alias("by"), "n")).alias("p"))
    fits = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")
    stars = ranked.join(pivot, "key").select(F.expr("-p.by").alias("a"), F.col("rep").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb")).where("a <> b").where(fits("na", "nb")).select("a", "b").distinct()

    members = buckets.select("rep").distinct()
    sets = scratch.keep(docs.join(members, docs.doc_id == members.rep, "left_semi").mapInArrow(_full_sets(k), "rep long, items array<long>").distinct(), "sets", BATCH_BYTES)

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("i"))
        return both.where(f"100L * i >= {percent} * (na + nb - i)").select("a", "b").distinct()

    first = connected_components(verified(stars), scratch, "star")
    held = buckets.join(first, buckets.rep == first.node, "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rest = scratch.keep(held.join(mixed, "key", "left_semi").select("rep", "n", "comp").distinct(), "rest")
    tokens = scratch.keep(rest.join(sets, "rep").select("rep", "n", "comp", F.explode("items").alias("h")), "tokens")
    frequency = scratch.keep(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    # Tokens of one member only stand first in its order and meet nobody; they are counted, not ranked.
    shared = _with_frequency(tokens, frequency)
    of_rep = Window.partitionBy("rep")
    ranked_tokens = shared.select("rep", "n", "comp", "h", F.row_number().over(of_rep.orderBy("df", "h")).alias("r"), F.count("*").over(of_rep).alias("m"))
    prefix = scratch.keep(ranked_tokens.select("rep", "n", "comp", "h", F.expr("n - m + r").alias("pos")).where(f"pos <= {_asked('n', percent)}"), "prefix")
    pairs = candidates(prefix, percent, scratch)
    links = verified(pairs)
    label = rest.select("rep", "comp").distinct()
    lifted = links.join(label.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(label.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
    second = connected_components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, "rest")

    named = reps.join(first, reps.rep == first.node, "left").select("s1", "s2", F.coalesce("comp", "rep").alias("c1"))
    named = scratch.keep(named.join(second, named.c1 == second.node, "left").select("s1", "s2", F.coalesce("comp", "c1").alias("component_id")), "named")
    for name in ("buckets", "sets", "tokens", "frequency", "prefix", "met", "rest", "star-out", "rest-out", "classes"):
        scratch.drop(name)
    linked = some.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all columns.

    Rows equal in doc_id and text stay once, rows that share only their doc_id each; rows without a doc_id all stay.
    """
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    chosen = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where("doc_id is null"))
