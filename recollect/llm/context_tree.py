"""Language model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 places in them has a context tree of its own, whose context is the
last `depth` bytes. From the counts of all training documents every node gets the Krichevsky-Trofimov probability of
its zeros and ones and the weight w = P_e / 2 P_w against the product of its children, bottom up. A prediction mixes
the estimates of all depths along the context, (1 - w) passed down from node to node; where training never saw the
deeper context, the last seen node keeps the rest of the weight. Each conditional is thus a proper distribution, and
the code length of a text is the sum over its bits.

A document is the sequence of its lower-cased words, joined by spaces and closed by a line feed, which no word holds:
text and token sequence determine each other, so the score stands beside the unigram base score.

Counts are gathered from all training documents by distributed aggregation, and the model's nodes are weighted by
joins. Through the driver pass only the most frequent grams with their log probabilities, at most max_grams, and the
most frequent words, at most max_words, 16 bytes each, which are broadcast. All others, and the grams that training
never saw, are looked up by shuffle joins, so results are the same at every size.

A Python worker holds that broadcast (24 MB by default), one Arrow batch of BATCH_BYTES, one group of texts of
GROUP_BYTES with about 100 bytes of arrays for each of their bytes, and, where it counts, up to `most` counted keys
with about 50 bytes each; the only thing that can exceed this is one text larger than a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .text import U, ascii_words, word_hashes

END = U(0x9AE16A3B2F90404F)  # the end's place among the word hashes
PAD = b"\n"
#: Bytes of text that a Python worker works on at once, and bytes of the Arrow batches that it gets.
GROUP_BYTES = 256 << 10
BATCH_BYTES = 1 << 20


def _lgamma(z: Column) -> Column:
    """lgamma of z > 0, by Stirling's series eight steps up, where its error is below 1e-11."""
    y, steps = z + 8.0, z
    for i in range(1, 8):
        steps = steps * (z + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - F.ln(steps)


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - log(pi)


def _codes(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-grams that end at each byte of each document, and each document's number of bytes."""
    size = np.array([len(d) for d in docs], np.int64)
    if not len(docs):
        return np.zeros(0, U), size
    raw = np.frombuffer(b"".join(PAD * depth + d for d in docs), np.uint8).astype(U)
    code = np.zeros(len(raw) - depth, U)
    for i in range(depth + 1):
        code = (code << U(8)) | raw[i : len(raw) - depth + i]
    start = np.concatenate([[0], np.cumsum(size + depth)[:-1]])
    at = np.arange(int(size.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return code[at], size


def _groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[tuple[list, list[list[bytes]]]]:
    rows, words, total = [], [], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for *row, text in zip(*cols, batch.column(batch.num_columns - 1)):
            text = text.as_py()
            rows.append(row)
            words.append(ascii_words(text))
            total += len(text or "")
            if total > most:
                yield rows, words
                rows, words, total = [], [], 0
    if rows:
        yield rows, words


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _count(depth: int, most: int = 1_000_000):
    """kind 0: (depth + 1)-grams, 1: words; summed within a task until it holds `most` of them."""

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}

        def out():
            for kind, parts in held.items():
                if parts:
                    key, n = _merged(parts)
                    for i in range(0, len(key), 500_000):
                        k = key[i : i + 500_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind), pa.int32()), pa.array(k.view(np.int64)), pa.array(n[i : i + 500_000])], names=["kind", "key", "n"])
                    parts.clear()

        for _, words in _groups(batches):
            code, _ = _codes([b" ".join(w) + b"\n" for w in words], depth)
            hashes = np.concatenate([np.full(len(words), END, U), *(word_hashes(w) for w in words)])
            for kind, x in ((0, code), (1, hashes)):
                key, n = np.unique(x, return_counts=True)
                held[kind].append((key, n.astype(np.int64)))
                if len(held[kind]) > 8:
                    held[kind][:] = [_merged(held[kind])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > most:
                yield from out()
        yield from out()

    return run


def build_nodes(grams: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """For each depth a table (key, p): key = context << 8 | place of the decision, p the mixed probability of a one."""
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):  # counts, and ln P_w bottom up
        bits = grams.select(F.expr(f"((key >> 8) & {(1 << 8 * d) - 1}L)").alias("ctx"), F.expr("cast(key & 255 as int)").alias("byte"), "n").groupBy("ctx", "byte").agg(F.sum("n").alias("n"))
        bits = bits.select("ctx", "byte", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
        bits = bits.select(F.expr("(ctx << 8) | ((1 << i) | (byte >> (8 - i)))").alias("key"), F.expr("(byte >> (7 - i)) & 1").alias("bit"), "n")
        node = bits.groupBy("key").agg(F.expr("sum(if(bit = 0, n, 0L))").alias("n0"), F.expr("sum(if(bit = 1, n, 0L))").alias("n1")).withColumn("pe", log_kt(F.col("n0"), F.col("n1")))
        if levels:
            up = F.expr(f"(((key >> 8) & {(1 << 8 * d) - 1}L) << 8) | (key & 255)")
            below = levels[-1].groupBy(up.alias("key")).agg(F.sum("pw").alias("pc"))
            both = node.join(below, "key").withColumn("hi", F.greatest("pe", "pc"))
            node = both.withColumn("pw", F.expr(f"hi + ln(exp(pe - hi) + exp(pc - hi)) - {log(2)!r}")).withColumn("w", F.expr(f"exp(pe - pw - {log(2)!r})"))
        else:
            node = node.withColumn("pw", F.col("pe")).withColumn("w", F.lit(1.0))
        levels.append(scratch.keep(node.select("key", F.expr("(n1 + 0.5D) / (n0 + n1 + 1.0D)").alias("kt"), "pw", "w"), f"up-{d}"))
    out: list[DataFrame] = []
    above = None
    for d, node in zip(range(depth + 1), reversed(levels)):  # rest of the weight and mixture so far, top down
        if above is None:
            here = node.withColumn("a", F.lit(1.0)).withColumn("m", F.lit(0.0))
        else:
            up = F.expr(f"(((key >> 8) & {(1 << 8 * (d - 1)) - 1}L) << 8) | (key & 255)").alias("up")
            here = node.select("*", up).join(above, "up").drop("up")
        kept = scratch.keep(here.select("key", F.expr("m + a * kt").alias("p"), F.expr("m + a * w * kt").alias("m"), F.expr("a * (1.0D - w)").alias("a")), f"down-{d}")
        above = kept.select(F.col("key").alias("up"), "a", "m")
        out.append(kept.select("key", "p"))
    for d in range(depth + 1):
        scratch.drop(f"up-{d}")
    return out


def _bits(grams: DataFrame) -> DataFrame:
    """(gram, place, bit): a gram's eight decisions."""
    i = grams.select(F.col("key").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    byte = "cast(gram & 255 as int)"
    return i.select("gram", F.expr(f"(1 << i) | ({byte} >> (8 - i))").alias("place"), F.expr(f"({byte} >> (7 - i)) & 1").alias("bit"))


def _key(d: int) -> Column:
    return F.expr(f"(((gram >> 8) & {(1 << 8 * d) - 1}L) << 8) | place").alias("key")


def _summed(bits: DataFrame) -> DataFrame:
    return bits.groupBy("gram").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("score")).select(F.col("gram").alias("key"), "score")


def seen_scores(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(key, score): log10 probabilities of grams seen in training, all of whose decisions have nodes at full depth."""
    return _summed(_bits(grams).select("gram", "bit", _key(len(nodes) - 1)).join(nodes[-1], "key"))


def unseen_scores(grams: DataFrame, nodes: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key, score) of other grams: each decision takes its deepest node; without any node a bit has probability 1/2."""
    open_ = _bits(grams)
    found = []
    for d in range(len(nodes) - 1, -1, -1):
        tried = scratch.keep(open_.select("gram", "place", "bit", _key(d)).join(nodes[d], "key", "left").select("gram", "place", "bit", "p"), f"tried-{d}")
        found.append(tried.where("p is not null").select("gram", "bit", "p"))
        open_ = tried.where("p is null").select("gram", "place", "bit")
    found.append(open_.select("gram", "bit", F.lit(0.5).alias("p")))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    return _summed(every)


def _lookup(key: np.ndarray, value: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(len(want), bool), np.zeros(len(want), value.dtype)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    hit = key[at] == want
    return hit, np.where(hit, value[at], 0)


def _split(values: np.ndarray, owner: np.ndarray, n: int) -> list:
    parts = np.split(values.view(np.int64), np.cumsum(np.bincount(owner, minlength=n))[:-1])
    return [p if len(p) else None for p in parts]


def _score(depth: int, common, log_n: float):
    def run(batches):
        (words_key, words_n), (grams_key, grams_score) = common.value
        for rows, words in _groups(batches):
            n = len(words)
            code, size = _codes([b" ".join(w) + b"\n" for w in words], depth)
            owner = np.repeat(np.arange(n), size)
            u, back = np.unique(code, return_inverse=True)
            hit, value = (x[back] for x in _lookup(grams_key, grams_score, u))
            score, missing = np.bincount(owner, value, n), _split(code[~hit], owner[~hit], n)

            counts = np.array([len(w) + 1 for w in words], np.int64)
            hashes = np.concatenate([np.append(word_hashes(w), END) for w in words])
            owner = np.repeat(np.arange(n), counts)
            u, back = np.unique(hashes, return_inverse=True)
            hit, c = (x[back] for x in _lookup(words_key, words_n, u))
            known = np.bincount(owner, hit, n).astype(np.int64)
            base = np.bincount(owner, np.where(hit, np.log10(c + 0.5) - log_n, 0.0), n)
            ids, held = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(counts), pa.array(known), pa.array(base), pa.array(score), pa.array(_split(hashes[~hit], owner[~hit], n), pa.list_(pa.int64())), pa.array(missing, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "missing"],
            )

    return run


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` keys reach; one row of sums tells."""
    steps = [1, *(int(2 ** (i / 2)) for i in range(2, 80))]
    sums = counts.agg(*(F.count_if(F.col("n") >= s).alias(f"c{i}") for i, s in enumerate(steps))).first()
    return next((s for s, c in zip(steps, sums) if c <= most), 1 << 62)


def _sorted_arrays(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", value).toArrow()
    key, v = table["key"].to_numpy().astype(np.int64).view(U), table[value].to_numpy()
    order = np.argsort(key)
    return key[order], v[order]


def score_documents(docs: DataFrame, depth: int = 5, folds: int = 5, held_fold: int = 1, max_grams: int = 1_000_000, max_words: int = 500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    The model learns from the rows whose crc32(doc_id as text) mod folds is not held_fold; a null doc_id is in no fold
    and is learned from. Null and empty texts are the end alone. score and base_score are log10 probabilities. An
    empty table gives an empty result; with no training rows the base score is that of the formula and every bit has
    probability 1/2. Repeated rows each count and each have a row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "context-tree")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(f"crc32(cast(doc_id as string)) % {folds} = {held_fold}"), F.lit(False)).alias("held_out"), "text")
    counts = scratch.keep(docs.where("not held_out").select("text").mapInArrow(_count(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts", BATCH_BYTES)
    grams, words = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    nodes = build_nodes(grams, depth, scratch)
    seen = scratch.keep(seen_scores(grams, nodes).join(grams, "key"), "seen")

    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_n = float(np.log10(total + 0.5 * (distinct + 1)))
    least_word, least_gram = _frequent(words, max_words), _frequent(grams, max_grams)
    frequent = (_sorted_arrays(words.where(F.col("n") >= least_word), "n"), _sorted_arrays(seen.where(F.col("n") >= least_gram), "score"))
    common = spark.sparkContext.broadcast(frequent)
    del frequent
    scored = docs.mapInArrow(_score(depth, common, log_n), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, missing array<long>")
    out = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored", BATCH_BYTES)
    common.unpersist()

    rare = out.select("row", F.explode("rare").alias("key")).join(words.where(F.col("n") < least_word), "key", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) - log_n).alias("rare_score"))
    missing = out.select("row", F.explode("missing").alias("key"))
    fresh = scratch.keep(missing.select("key").distinct().join(seen.select("key"), "key", "left_anti"), "unseen")
    table = seen.where(F.col("n") < least_gram).select("key", "score").unionAll(unseen_scores(fresh, nodes, scratch))
    more = missing.join(scratch.keep(table, "rest"), "key").groupBy("row").agg(F.sum("score").alias("more"))
    for name in ("seen", "unseen", *(f"{x}-{d}" for x in ("down", "tried") for d in range(depth + 1))):
        scratch.drop(name)
    return out.join(rare, "row", "left").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
