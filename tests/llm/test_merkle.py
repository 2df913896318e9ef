"""The manifest against trees built by hand, over groups of all shapes, ties, nulls and clashing columns."""

import collections
import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout=8):
    """The root, and for each leaf its (before, after) of every level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fanout * fanout : k // fanout * fanout + fanout]
            proofs[i].append((run[: k % fanout], run[k % fanout + 1 :]))
            at[i] = k // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    own = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows), key=lambda x: x[:5])
    groups = [(k, list(v)) for k, v in itertools.groupby(own, key=lambda x: x[:2])]
    trees = [tree([x[4] for x in v]) for _, v in groups]
    if not trees:
        return []
    root, tops = tree([t[0] for t in trees])
    out = []
    for (_, members), (sub, proofs), top in zip(groups, trees, tops):
        for x, proof in zip(members, proofs):
            r, path = x[5], proof + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            d = leaf(r, r[1].translate({c: c + 32 for c in range(65, 91)})) if hit else x[4]
            for before, after in path:
                d = H(*before, d, *after)
            out.append((r[0], x[4], sub, root, H(*(s for a, b in path for s in a + b)), d, d == root))
    return out


ODD = [
    (None, "no id", "en", "s", 5),
    (None, None, None, None, None),
    (7, None, "en", None, 3),
    (7, "", "en", "s", 0),
    (7, "Tie", "en", "s", 3),
    (9, "Same", "en", "s", 4),
    (9, "Same", "en", "s", 4),
    (10, "É Größe \U0001f600 AbC", "", "s", 9),
    (11, "lone", "é", "s", 4),
    (12, "LONG " * 50_000, "zz", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 8, "b": 9, None: 7}, {"en": 600, "fr": 64, "de": 65, "": 1, None: 513}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_manifest(spark, counts):
    n = itertools.count(100)
    rows = [(i := next(n), f"Text {i}", lang, "s" if i % 5 else None, i) for lang, c in counts.items() for _ in range(c)]
    if len(rows) > 20:
        rows += ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("root", F.lit(1)).repartition(5, F.rand(3))
    got = merkle.verify_documents(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(by_hand(rows))


def test_empty_and_real(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert merkle.verify_documents(docs.limit(0)).count() == 0
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = by_hand(rows)
    assert collections.Counter(map(tuple, merkle.verify_documents(docs).collect())) == collections.Counter(want)
    assert {w[-1] for w in want} == {True, False}


def test_shapes_give_equal_trees(spark):
    """Blocks of any size give the same root, and every proof leads to it."""
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(2).alias("carried"))
    roots = set()
    for levels in (1, 2, 4):
        m = merkle.merkle_manifest(rows, levels=levels)
        assert m.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0 and m.where("carried = 2").count() == 1000
        roots |= {r.root for r in m.select("root").distinct().collect()}
    assert roots == {tree([H(str(i)) for i in range(1000)])[0]}
    assert merkle.walk(["a"], 0, 8) == "a"
