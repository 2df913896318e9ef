"""Mining against all products, over clouds, lattices full of ties, hot vectors and odd rows; the trees' bounds."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import hard_negatives as H
from recollect.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, positives=5, negatives=10):
    """rows: (vec_id, embedding, label) as the contract states them."""
    own = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e])
        own[i] = min(own[i], r) if i in own else r
    width = max((len(v) for _, v in own.values()), default=0)
    m = np.array([v + [0] * (width - len(v)) for _, v in own.values()], np.int64).reshape(len(own), width)
    ids, labels, out = np.array(list(own), np.int64), np.array([x for x, _ in own.values()]), []
    for a in [i for i in own if i % 100 == 0]:
        at = int(np.flatnonzero(ids == a)[0])
        s = m @ m[at]
        order = [int(j) for j in np.lexsort((ids, -s)) if j != at]
        for p in [j for j in order if labels[j] == labels[at]][:positives]:
            fits = [j for j in order if labels[j] != labels[at] and 30 * s[p] <= 100 * s[j] <= 90 * s[p]][:negatives]
            out += [(a, int(ids[p]), r, int(ids[j]), int(s[p]), int(s[j])) for r, j in enumerate(fits, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("cell", F.lit("clash")).withColumn("id", F.lit(1))


def check(spark, rows):
    want = by_hand(rows)
    got = [tuple(r) for r in H.mine_embeddings(table(spark, rows)).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    return want


def rows_of(kind):
    rng = np.random.default_rng(7)
    if kind == "clusters":  # far apart, so that cells and leaves are left out
        centres = rng.normal(size=(12, 16)) * 2
        return [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.3], int(i % 12 < 6) if i % 5 else 3) for i in range(3000)]
    if kind == "lattice":  # many equal scores and equal vectors
        return [(i * 5, [float(x) for x in rng.integers(-1, 2, 4) / 4], int(rng.integers(0, 3))) for i in range(2000)]
    if kind == "hot":  # a third of all rows are one vector
        return [(i, [0.5, 0.25, -0.5] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)], i % 4) for i in range(1500)]
    odd = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 1.0], None)]
    odd += [(100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (100, [0.5, 1.0], 2), (200, [], 1), (300, [0.0, 0.0], 2), (400, [-1.0, -1.0], 1), (6, [0.7], 2), (8, [0.3, 0.2, 0.9], 1), (9, [0.4, 0.1], 2), (10, [0.6, 0.6], 1), (-100, [0.6, 0.5], 1), (-7, [0.5, 0.5], 9)]
    return odd


@pytest.mark.parametrize("kind", ["clusters", "lattice", "hot", "odd"])
def test_against_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "LEAF", 8)
    monkeypatch.setattr(H.Index.__init__, "__defaults__", (256, 100))  # many cells and blocks
    monkeypatch.setattr(H, "ASKING", 4)
    assert check(spark, rows_of(kind)) or kind == "odd"


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in docs.select("vec_id", "embedding", "label").collect()]
    want = by_hand(rows)
    assert want and collections.Counter(tuple(r) for r in H.mine_embeddings(docs).collect()) == collections.Counter(want)
    assert H.mine_embeddings(docs.limit(0)).count() == 0
    assert H.mine_embeddings(docs.where("vec_id % 100 <> 0")).count() == 0


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 5
    x = centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 6)) * 0.2
    q = x[:40] + 0.01
    tree = H.Tree(x, 16)
    assert sorted(tree.order) == list(range(2000))
    d = H._distances(q, x)
    for split, leaf_of in ((False, None), (True, tree.leaf_of(x))):
        low, high = tree.bounds(q, split)
        for where, *rest in tree.nodes:
            if where is None:
                own = tree.order[rest[0] : rest[1]] if leaf_of is None else np.flatnonzero(leaf_of == rest[2])
                assert (d[:, own].min(axis=1) >= low[:, rest[2]] - 1e-9).all() and (d[:, own].max(axis=1) <= high[:, rest[2]] + 1e-9).all()
    near = np.sort(d, axis=1)[:, 9]
    assert (tree.bounds(q, False)[0] > near[:, None]).mean() > 0.5  # most leaves can't hold one of the ten nearest


def test_cells_spread(spark):
    """One vector held by most rows collapses, and cells hold no more than blocks of bounded size."""
    points = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array("id", F.pmod(F.xxhash64("id"), F.lit(3000)))).alias("vec"))
    index = H.Index(points, Scratch(spark, "test"), 5, sample=400, block=100)
    assert index.points.count() == 1000 + 12 and len(index.blocks) > 5
