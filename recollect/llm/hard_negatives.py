"""Hard negatives by exact inner products, found in vantage-point trees over norm-augmented vectors.

A vector x becomes (x, sqrt(M - |x|^2)), with M the largest squared norm, and a query q becomes (q, 0): their squared
distance is |q|^2 + M - 2 q.x, so the best products are the nearest points and a window of scores is an annulus around
the query. A bounded sample gives the top of one tree, whose leaves are cells; every vector falls into one cell, and a
cell's vectors are dealt to blocks of bounded size, each of which makes a tree of its own in a task. A query asks the
cell that may hold its nearest points first, then only those cells whose distance bounds reach into what its annulus
has left. Inside a block, leaves are visited nearest first, and a query stops when its k-th find is nearer than all
that is left; trees and bounds leave nothing out, so the answers are exact.

Equal vectors of one label collapse to as many ids as any answer can hold, so one common vector is no hot cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: Vectors of a block, and queries that meet it at once; vectors of the sample for the cells, and of a tree's leaf.
BLOCK, ASKING, SAMPLE, LEAF = 8192, 2048, 4096, 128
WINDOWS = "array<struct<positive_id:bigint,lo:bigint,hi:bigint>>"
LEAST, MOST = -(2**62), 2**62


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles; what a shorter list lacks is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a from every row of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


class Tree:
    """Nodes of a vantage-point tree: nodes[i] is (vantage, radius, near child, far child), or (None, first, end, name) for a leaf.

    rings[i] is the least and the largest distance of node i's points from its parent's vantage point.
    """

    def __init__(self, points: np.ndarray, leaf: int, leaves: int | None = None):
        """Leaves hold at most `leaf` points, or such as distances hardly tell apart; with `leaves`, at most so many leaves."""
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        self.rings: list[tuple[float, float]] = []
        self.vantages: list[int] = []
        self.leaves = 0
        self._grow(0, len(points), (0.0, math.inf), leaf, leaves or 2**60, 64)

    def _grow(self, first: int, end: int, ring: tuple[float, float], leaf: int, room: int, deep: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        self.rings.append(ring)
        own = self.order[first:end]
        if end - first > leaf and room > 1 and deep:
            d = _distances(self.points[own], self.points[own[:1]])[:, 0]
            radius = float(np.partition(d, (end - first - 1) // 2)[(end - first - 1) // 2])
            near = d <= radius
            if not near.all():
                vantage, cut = int(own[0]), first + int(near.sum())
                self.order[first:end] = np.r_[own[near], own[~near]]
                self.vantages.append(vantage)
                rings = [(float(x.min()), float(x.max())) for x in (d[near], d[~near])]
                place = len(self.vantages) - 1
                a = self._grow(first, cut, rings[0], leaf, (room + 1) // 2, deep - 1)
                b = self._grow(cut, end, rings[1], leaf, room // 2, deep - 1)
                self.nodes[at] = (place, radius, a, b)
                return at
        self.nodes[at] = (None, first, end, self.leaves)
        self.leaves += 1
        return at

    def routes(self) -> Tree:
        """The tree without the points that are no vantage points."""
        self.points, self.vantages, self.order = self.points[self.vantages], list(range(len(self.vantages))), self.order[:0]
        return self

    def bounds(self, queries: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance of each leaf's points from each query.

        With split, points were sent down by the radius alone (cells); else their rings hold.
        """
        from_vantage = _distances(queries, self.points[self.vantages]) if self.vantages else np.zeros((len(queries), 0))
        least, most = np.zeros((len(queries), self.leaves)), np.full((len(queries), self.leaves), np.inf)

        def down(at: int, low: np.ndarray, high: np.ndarray) -> None:
            where, *rest = self.nodes[at]
            if where is None:
                least[:, rest[2]], most[:, rest[2]] = low, high
                return
            d, (radius, near, far) = from_vantage[:, where], rest
            for child, (lo, hi) in ((near, (0.0, radius) if split else self.rings[near]), (far, (radius, math.inf) if split else self.rings[far])):
                down(child, np.maximum(low, np.maximum(d - hi, lo - d)), np.minimum(high, d + hi))

        down(0, np.zeros(len(queries)), np.full(len(queries), np.inf))
        return least, most

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point is sent to by the radii."""
        out = np.zeros(len(points), np.int64)

        def down(at: int, some: np.ndarray) -> None:
            where, *rest = self.nodes[at]
            if where is None:
                out[some] = rest[2]
            elif len(some):
                near = _distances(points[some], self.points[[self.vantages[where]]])[:, 0] <= rest[0]
                down(rest[1], some[near])
                down(rest[2], some[~near])

        down(0, np.arange(len(points)))
        return out


def _scores(q: np.ndarray, least: np.ndarray, most: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the least score that distances allow, with room for rounding."""
    own = (q * q).sum(axis=1)[:, None] + top
    slack = 1e-8 * (own + 1)
    return (own - least**2) / 2 + slack, (own - most**2) / 2 - slack


def _visit(table: pa.Table, asking: pa.Table, k: int, same: bool, width: int, top: float) -> pa.Table:
    """The k best of a block in each window of each query: the higher score first, then the smaller id."""
    out: list[tuple[int, int | None, int, int]] = []
    if len(table) and len(asking):
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        x, q = _matrix(table.column("vec"), width), _matrix(asking.column("vec"), width)
        tree = Tree(_augmented(x, top), LEAF)
        x, ids, labels = x[tree.order], ids[tree.order], labels[tree.order]  # so that a leaf is one slice
        spans = dict((rest[2], slice(*rest[:2])) for where, *rest in tree.nodes if where is None)
        places = np.arange(len(x))
        high, low = _scores(q, *tree.bounds(np.c_[q, np.zeros(len(q))], False), top)
        nearest = np.argsort(-high, axis=1, kind="stable")
        for r, (anchor, label, windows) in enumerate(zip(*(asking.column(c).to_pylist() for c in ("anchor_id", "label", "windows")))):
            score, seen = np.zeros(len(x)), set()
            able = ((labels == label) if same else (labels != label)) & (ids != anchor)
            for w in windows:
                best, at, step = np.zeros(0, np.int64), 0, 2
                reach = nearest[r][high[r, nearest[r]] >= w["lo"]]
                while at < len(reach) and not (len(best) == k and score[best[-1]] > high[r, reach[at]]):
                    run = [leaf for leaf in reach[at : at + step].tolist() if low[r, leaf] <= w["hi"]]
                    for leaf in run:
                        if leaf not in seen:
                            seen.add(leaf)
                            score[spans[leaf]] = x[spans[leaf]] @ q[r]
                    at, step = at + step, 2 * step  # a few leaves at first, then more at a time
                    own = np.concatenate([best, *(places[spans[leaf]] for leaf in run)])
                    own = own[able[own] & (score[own] >= w["lo"]) & (score[own] <= w["hi"])]
                    best = own[np.lexsort((ids[own], -score[own]))[:k]]
                out += [(anchor, w["positive_id"], int(i), int(s)) for i, s in zip(ids[best], score[best])]
    names = ["anchor_id", "positive_id", "id", "score"]
    return pa.table({n: pa.array([row[j] for row in out], pa.int64()) for j, n in enumerate(names)})


class Index:
    """Vectors (id, label, vec: array<bigint>) in cells and blocks, written once."""

    def __init__(self, points: DataFrame, scratch: Scratch, k: int, sample: int = SAMPLE, block: int = BLOCK):
        """k: the most ids that an answer holds. Vectors are as wide as the widest; what others lack is zero."""
        self.scratch, self.turn, self.k = scratch, 0, k
        norm = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
        n, self.width, top = points.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
        self.top, self.width = float(top or 0), self.width or 0
        if self.top >= 2**52:
            raise ValueError("scores of vectors so long aren't exact")
        same = Window.partitionBy("label", "vec").orderBy("id")
        few = points.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r")  # the query's own id may be among them
        drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()
        self.tree = Tree(_augmented(_matrix(drawn.column("vec"), self.width), self.top), 1, min(-(-n // block), max(1, sample // 8)) or 1).routes()
        tree, width, most = self.tree, self.width, self.top

        def send(batches):
            for b in batches:
                cells = tree.leaf_of(_augmented(_matrix(b.column(2), width), most))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=["id", "label", "vec", "cell"])

        self.points = scratch.keep(few.select("id", "label", "vec").mapInArrow(send, "id long, label int, vec array<bigint>, cell int"), "points")
        sizes = dict(self.points.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row for each cell
        self.blocks = {c: -(-m // block) for c, m in sizes.items()}

    def _by_cell(self, many: dict[int, int]) -> Column:
        return F.element_at(F.array(*(F.lit(many.get(c, 0)) for c in range(self.tree.leaves))), F.col("cell") + 1)

    def _routed(self, asked: DataFrame, first: bool) -> DataFrame:
        """asked (anchor_id, label, vec, windows, seen) with the cells to ask: the nearest one, or all others that may matter."""
        tree, width, top, blocks = self.tree, self.width, self.top, self.blocks
        names = ["anchor_id", "label", "vec", "windows", "seen"]

        def run(batches):
            for b in batches:
                q = _matrix(b.column(2), width)
                high, low = _scores(q, *tree.bounds(np.c_[q, np.zeros(len(q))], True), top)
                cells = []
                for r, (windows, seen) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                    able = [c for c in np.argsort(-high[r], kind="stable").tolist() if c in blocks and c != seen and any(high[r, c] >= w["lo"] and low[r, c] <= w["hi"] for w in windows)]
                    cells.append(able[:1] if first else able)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*names, "cells"])

        return asked.select(*names).mapInArrow(run, f"anchor_id long, label int, vec array<bigint>, windows {WINDOWS}, seen int, cells array<int>")

    def _ask(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """Hits of each block of the cells; queries meet a block in groups of about ASKING."""
        at = routed.select("anchor_id", "label", "vec", "windows", F.explode("cells").alias("cell"))
        asking = {c: -(-n // ASKING) for c, n in at.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        hashed = lambda c, many: F.pmod(F.xxhash64(c), F.greatest(self._by_cell(many), F.lit(1))).cast("int")
        each = lambda many: F.explode(F.when(self._by_cell(many) > 0, F.sequence(F.lit(0), self._by_cell(many) - 1)).otherwise(F.array().cast("array<int>")))
        at = at.withColumn("part", hashed("anchor_id", asking)).withColumn("block", each(self.blocks))
        held = self.points.withColumn("block", hashed("id", self.blocks)).withColumn("part", each(asking))
        keys, width, top = ["cell", "block", "part"], self.width, self.top
        met = held.groupBy(*keys).cogroup(at.groupBy(*keys))
        return met.applyInArrow(lambda a, b: _visit(a, b, k, same, width, top), "anchor_id long, positive_id long, id long, score long")

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, positive_id, id, score, rank): the k best of each window of asked (anchor_id, label, vec, windows)."""
        self.turn += 1
        keep = lambda df, name: self.scratch.keep(df, f"{name}-{self.turn}")
        first = keep(self._routed(asked.withColumn("seen", F.lit(None).cast("int")), True), "first")
        near = keep(self._ask(first, k, same), "near")
        # What the nearest cell gave bounds what the others must beat: the k-th score is the window's new lower end.
        window = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
        ranked = near.withColumn("r", F.row_number().over(window)).where(F.col("r") == k)
        kth = ranked.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("kth"))  # a row for each window of one query
        least = lambda w: F.coalesce(F.array_max(F.transform(F.filter("kth", lambda x: x.positive_id.eqNullSafe(w.positive_id)), lambda x: x.score)), F.lit(LEAST))
        raised = F.transform("windows", lambda w: F.struct(w.positive_id.alias("positive_id"), F.greatest(w.lo, least(w)).alias("lo"), w.hi.alias("hi")))
        left = first.join(kth, "anchor_id", "left").select("anchor_id", "label", "vec", F.coalesce(F.when(F.col("kth").isNotNull(), raised), F.col("windows")).alias("windows"), F.try_element_at("cells", F.lit(1)).alias("seen"))
        rest = keep(self._routed(left, False), "rest")
        every = near.unionAll(keep(self._ask(rest, k, same), "far"))
        return every.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def whole_numbers(vec: Column, scale: int = 256) -> Column:
    """Each component times scale, rounded down; null where the vector or a component is null or not finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, vec: array<bigint>).

    Anchors are the rows where the condition holds. An anchor's positives are its best `positives` other rows of its
    label; for each, the best `negatives` rows of other labels whose score lies between low and high percent of the
    positive's. Higher scores come first, then smaller ids. Rows with a null id, label or vector take no part. An id
    stands for one row: of several, the least label, then vector. A shorter vector counts as padded with zeros. Where
    the positive's score is negative no score lies between. An empty table, or one without anchors, gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    whole = rows.where("id is not null and label is not null and vec is not null")
    one = whole.groupBy(F.col("id").cast("long")).agg(F.min(F.struct(F.col("label").cast("int").alias("label"), "vec")).alias("r"))
    points = scratch.keep(one.select("id", "r.label", "r.vec"), "whole")
    index = Index(points, scratch, max(positives, negatives), **options)
    asked = points.where(anchors).select(F.col("id").alias("anchor_id"), "label", "vec")
    windows = F.array(F.struct(F.lit(None).cast("long").alias("positive_id"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    near = index.search(asked.withColumn("windows", windows), positives, True)
    near = scratch.keep(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    down = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731 - whole hundreds, so the division is exact
    p = F.col("positive_score")
    span = near.select("anchor_id", "positive_id", (-down(-p * low)).cast("long").alias("lo"), down(p * high).cast("long").alias("hi")).where("lo <= hi")
    spans = span.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "lo", "hi"))).alias("windows"))  # at most `positives`
    found = index.search(asked.join(spans, "anchor_id"), negatives, False)
    out = found.join(near, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """mine_hard_negatives() of embeddings (vec_id, embedding, label), where every seventh id's label is another one and every hundredth id is an anchor."""
    i = F.col("vec_id")
    label = F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(embeddings.select(i.alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("vec")), F.col("id") % 100 == 0)
