"""A Merkle manifest of a table: one tree for each group, their roots under one root, and a proof for every row.

Rows are numbered within their group by range partitions: a row's number is the count of rows before its partition plus
its place there, so no group, however hot, is in one task. Aligned blocks of fanout^levels neighbours go to one task
each, which walks its block in postorder: a subtree returns its digest, and while the calls unwind, every leaf below
gets its siblings of that level. The blocks' roots are the leaves of the next distributed walk, and so on up; then
the proofs come down again, a block's own to all its leaves. What goes up is a digest for each block, so the tables
shrink by fanout^levels at each step.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch

FANOUT, LEVELS = 8, 3
#: Runs of one group in one partition, up to which they are broadcast.
MOST_RUNS = 100_000
PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """What stands for a value in a leaf: - for null, else its UTF-8 length, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, level: digest(level.before, d, level.after))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level.before, level.after)), ""), 256)


def depth(nodes: int, fanout: int) -> int:
    """How many levels lie above so many nodes: none above a single one."""
    d, width = 0, 1
    while width < nodes:
        d, width = d + 1, width * fanout
    return d


def walk(leaves: list[str], levels: int, fanout: int, siblings: list[list[tuple[str, str]]] | None = None) -> str:
    """The root of a block, `levels` above its leaves; siblings, where given, gets each leaf's (before, after), lowest level first."""

    def under(first: int, level: int) -> str:
        if level == 0:
            return leaves[first]
        width = fanout ** (level - 1)
        starts = range(first, min(first + fanout * width, len(leaves)), width)
        children = [under(at, level - 1) for at in starts]
        if siblings is not None:
            for i, at in enumerate(starts):
                own = ("".join(children[:i]), "".join(children[i + 1 :]))
                for leaf in range(at, min(at + width, len(leaves))):
                    siblings[leaf].append(own)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    return under(0, levels)


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (_key, ...) with _pos, the place within _key by the order, and _total, the rows of _key."""
    laid = rows.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    kept = scratch.keep(laid.withColumn("_at", F.monotonically_increasing_id()), f"{name}-laid")
    part = F.shiftright("_at", 33).alias("_part")  # the number counts from 2^33 times the partition's
    runs = kept.groupBy("_key", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy("_key")
    before = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_total", F.sum("_n").over(every)).drop("_n")
    runs = scratch.keep(runs, f"{name}-runs")
    runs = F.broadcast(runs) if runs.limit(MOST_RUNS + 1).count() <= MOST_RUNS else runs
    met = kept.withColumn("_part", part).join(runs, ["_key", "_part"])
    return met.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / width))


def _ordered(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    table = table.sort_by("_pos")
    return table, table.column("_digest").to_pylist(), table.column("_total")[0].as_py() if len(table) else 0


def _climb(nodes: DataFrame, scratch: Scratch, name: str, fanout: int, levels: int) -> list[DataFrame]:
    """Tables (_key, _pos, _total, _digest) from the nodes up to where each key has one."""
    width, tables = fanout**levels, [nodes.select("_key", "_pos", "_total", "_digest")]

    def root(table: pa.Table) -> pa.Table:
        table, leaves, total = _ordered(table)
        top = walk(leaves, min(levels, depth(total, fanout)), fanout)
        return pa.table({"_key": table.column("_key")[:1], "_pos": table.column("_block")[:1], "_total": pa.array([-(-total // width)], pa.int64()), "_digest": pa.array([top])})

    while (tables[-1].agg(F.max("_total")).first()[0] or 0) > 1:
        blocks = _blocks(tables[-1], width).groupBy("_key", "_block").applyInArrow(root, "_key string, _pos long, _total long, _digest string")
        tables.append(scratch.keep(blocks, f"{name}-{len(tables)}"))
    return tables


def _descend(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes with _proof: their siblings within their blocks, then the proof of their block (_key, _pos, _proof, ...)."""
    width, more = fanout**levels, [c for c in above.columns if c not in ("_key", "_pos", "_proof")]
    out = StructType([*nodes.schema.fields, above.schema["_proof"], *(above.schema[c] for c in more)])

    def below(table: pa.Table, block: pa.Table) -> pa.Table:
        table, leaves, total = _ordered(table)
        siblings: list[list[tuple[str, str]]] = [[] for _ in leaves]
        walk(leaves, min(levels, depth(total, fanout)), fanout, siblings)
        higher = [(x["before"], x["after"]) for x in block.column("_proof")[0].as_py()] if len(leaves) else []
        proofs = [[{"before": a, "after": b} for a, b in own + higher] for own in siblings]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        table = table.drop_columns(["_block"]).append_column("_proof", pa.array(proofs, kind))
        for c in more:
            table = table.append_column(c, pa.array([block.column(c)[0].as_py()] * len(leaves), pa.string()))
        return table

    parents = above.withColumnRenamed("_pos", "_block")
    return _blocks(nodes, width).groupBy("_key", "_block").cogroup(parents.groupBy("_key", "_block")).applyInArrow(below, out)


def merkle_manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """rows with subroot, root and proof: an array of (before, after), the siblings on either side, from the leaf's level up.

    rows: the group (string), the order (any type that sorts), the leaf (a digest of the row), and what else is to be
    carried, whose names must not begin with _. Within a group, leaves ascend by the order, nulls first, equal ones by
    their digests: rows with equal leaves can stand for each other. While more than one node remains, each run of
    `fanout` nodes, the last one shorter or even single, becomes the digest of its digests. The groups' roots, by the
    group's name (null first, then by bytes), become one root alike. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    name = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # null is a name of its own, before all others
    kept = scratch.keep(rows.withColumn("_key", name).withColumn("_digest", F.col(leaf)), "leaves")
    leaves = scratch.keep(_numbered(kept, [order, "_digest"], scratch, "leaves"), "numbered")
    trees = _climb(leaves, scratch, "tree", fanout, levels)
    subroots = trees[-1].select(F.lit("").alias("_key"), F.col("_key").alias("_of"), "_digest")
    subroots = scratch.keep(_numbered(subroots, ["_of"], scratch, "subroots"), "subroots")
    tops = _climb(subroots, scratch, "top", fanout, levels)

    paths = tops[-1].select("_key", "_pos", F.array().cast(PROOF).alias("_proof"), F.col("_digest").alias("root"))
    for n in range(len(tops) - 2, -1, -1):
        paths = scratch.keep(_descend(subroots if n == 0 else tops[n], paths, fanout, levels), f"top-proofs-{n}").drop("_total")
    if len(tops) == 1:
        paths = subroots.join(paths, ["_key", "_pos"])
    paths = paths.select(F.col("_of").alias("_key"), F.lit(0).cast("long").alias("_pos"), "_proof", F.col("_digest").alias("subroot"), "root")
    for n in range(len(trees) - 2, 0, -1):
        paths = scratch.keep(_descend(trees[n], paths, fanout, levels).drop("_total", "_digest"), f"tree-proofs-{n}")
    out = _descend(leaves, paths, fanout, levels) if len(trees) > 1 else leaves.join(paths, ["_key", "_pos"])
    return out.select(*(F.col(c) for c in rows.columns), "subroot", "root", F.col("_proof").alias("proof"))


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents, with this text."""
    return digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def tampered(text: Column) -> Column:
    """What the check of the manifest does to a text: A-Z become lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of docs (doc_id, source, lang, n_chars, text), checked after every third row, by the checksum of its id, was tampered with.

    A tampered row verifies where its text has no capital, or is null. Rows without an id are not tampered with; rows
    that are equal have equal leaves and each a place of their own; further columns are ignored.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    rows = docs.select("doc_id", "lang", document_leaf(F.col("text")).alias("leaf"), F.when(hit, document_leaf(tampered(F.col("text")))).alias("found"))
    told = merkle_manifest(rows)
    folded = fold(F.coalesce("found", "leaf"), F.col("proof"))
    told = told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
