"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash in the lowest 1/scale of the hash range, whatever the document's size, so sketches of
parts merge into the sketch of the whole and containment between very unequal documents can be estimated. A text whose
shingles all lie above the threshold keeps its smallest hash alone, so that no text with words is without a fingerprint;
merging drops that one as soon as another part has hashes below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = 5, scale: int = 8) -> Column:
    """Sorted distinct signed 64-bit hashes that lie in the lowest 1/scale of the range; null text: no hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(k))))
        return F.when(F.size(w) >= k, windows).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda w: let(hashes(w), lambda h: _low(h, scale)))


def _low(hashes: Column, scale: int) -> Column:
    """The distinct hashes in the lowest 1/scale of the range, else the smallest."""
    limit = -(2**63) + 2**64 // scale
    return let(F.filter(hashes, lambda x: x < limit), lambda x: F.when((F.size(x) > 0) | (F.size(hashes) == 0), F.sort_array(F.array_distinct(x))).otherwise(F.array(F.array_min(hashes))))


def fingerprint(hashes: Column) -> Column:
    """The sketch as text: hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(hashes, F.hex), ",")


def merge(a: Column, b: Column, scale: int = 8) -> Column:
    """The sketch of all shingles of two parts, from the parts' sketches of the same scale."""
    return let(F.array_union(a, b), lambda h: _low(h, scale))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null where a has none."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The larger of the two containments: 1 for equal sketches, 0 where either (but not both) is empty."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest(containment(a, b), containment(b, a)), F.lit(0.0)))


#: Stretches that are too full, up to which their list is broadcast; times that a stretch is cut anew.
MOST_FULL, CUTS = 100_000, 4


def _stretches(docs: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """docs with `at`, which orders stretches of about `most` documents, however the ids lie.

    At first all stretches are as wide as `most` documents take on average. Where ids are clumped, or one lies far away,
    some hold too many; these are cut anew, each by its own least and largest id, and so on. Only ids are read for it.
    What still holds more after the last cut are single ids with many rows, or clumps within clumps within clumps.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    width = max(most, (high - low + 1) * most // n) if n else most
    none = F.lit(-(2**62)) + F.pmod(F.xxhash64("text"), F.lit(2**20))
    docs = docs.withColumn("k0", F.coalesce(F.floor(F.col("doc_id") / F.lit(float(width))), none))
    keys = ["k0"]
    for cut in range(1, CUTS + 1):
        held = docs.where("doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_n"))
        full = scratch.keep(held.where(f"_n > {4 * most} and _low < _high"), f"full-{cut}")
        n_full = full.limit(MOST_FULL + 1).count()
        if not n_full:
            break
        step = F.greatest(F.lit(1.0), (F.col("_high") - F.col("_low") + 1).cast("double") * most / F.col("_n"))
        full = full.select(*keys, "_low", step.alias("_step"))
        docs = docs.join(F.broadcast(full) if n_full <= MOST_FULL else full, keys, "left")
        docs = docs.withColumn(f"k{cut}", F.coalesce(F.floor((F.col("doc_id") - F.col("_low")) / F.col("_step")), F.lit(0))).drop("_low", "_step")
        keys.append(f"k{cut}")
    return docs.withColumn("at", F.struct(*keys)).drop(*keys)


def with_next(docs: DataFrame, scratch: Scratch, carry: dict[str, Column], most: int = 512) -> DataFrame:
    """doc_id, text, the carried columns, and next: a struct of the next document's text and carried columns.

    The next document is that of the next doc_id; after the last comes the first. Order is found inside stretches of
    ids (see _stretches), and the first document of each stretch is also sent to the stretch before: texts move once,
    and no task sorts more than a stretch. Stretches are put in order by range partitions, of which only the ends meet
    in one task. Equal ids are ordered by text; rows without an id come first, by a hash of the text.
    """
    docs = _stretches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scratch, most)
    ordered = docs.groupBy("at").agg(F.min("doc_id").alias("first_id")).repartitionByRange("at")
    firsts = scratch.keep(ordered.withColumn("part", F.spark_partition_id()), "firsts")
    ends = firsts.groupBy("part").agg(F.max("at").alias("last"))  # a row for each partition
    over = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    last = ends.agg(F.max("last").alias("wrap"))
    chain = firsts.withColumn("p", F.lag("at").over(Window.partitionBy("part").orderBy("at"))).join(F.broadcast(over), "part").crossJoin(F.broadcast(last))
    chain = scratch.keep(chain.select(F.col("at").alias("c_at"), F.col("first_id"), F.coalesce("p", "before", "wrap").alias("prev")), "chain")
    told = docs.join(chain, (docs.at == chain.c_at) & docs.doc_id.eqNullSafe(chain.first_id), "left")
    told = told.select("doc_id", "text", F.explode(F.when(F.col("prev").isNotNull(), F.array(F.struct("at", F.lit(False).alias("extra")), F.struct(F.col("prev").alias("at"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("at", F.lit(False).alias("extra"))))).alias("to"))
    rows = told.select("doc_id", "text", F.col("to.at").alias("at"), F.col("to.extra").alias("extra"), *(c.alias(n) for n, c in carry.items()))
    own = Window.partitionBy("at").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", *carry)).over(own)).where("not extra").drop("at", "extra")


def fingerprint_documents(docs: DataFrame, k: int = 5, scale: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; one row for each row of docs (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Null texts count as empty; a text without words has an empty fingerprint. Further columns are ignored;
    an empty table gives an empty result.
    """
    pairs = with_next(docs, Scratch(docs.sparkSession, "fingerprints"), {"own": sketch(F.col("text"), k, scale)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    full = pairs.select("doc_id", "own", F.col("next.own").alias("following"), n.cast("long").alias("n_chars"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), sketch(e, k, scale).alias("own"))).alias("e"))
    return full.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("e.own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("e.own")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
