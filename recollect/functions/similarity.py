"""Word similarity: the best Jaccard of a query's trigrams with a contiguous extent of a target's trigram sequence."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\W_]+")


def trigrams(text: str | None) -> list[str]:
    out: list[str] = []
    for w in WORD.findall((text or "").lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(w) + 1)]
    return out


def trigram_codes(text: str | None) -> np.ndarray:
    """trigrams() as whole numbers, three code points of 21 bits each: equal where the trigrams are."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = points[:-2] | points[1:-1] << 21 | points[2:] << 42
    inside = np.ones(len(points), bool)
    ends = np.cumsum([len(w) + 3 for w in words])
    inside[ends - 1] = inside[ends - 2] = False  # windows that would reach into the next word
    return codes[inside[:-2]]


class Extents:
    """A text cut once, to be scored against many trigram sets at a time.

    An extent from s holds a trigram for the first time where it last stood before s. So for all extents that start in
    a stretch of places, only places whose trigram last stood before the stretch's end matter: at most as many as the
    text has different trigrams, and the stretch's own, however long and repetitive the text is. In a stretch, blocks
    of BLOCK starts meet chunks of CHUNK ends: new hits up to a chunk's end count at least what an extent of the block
    holds, other new trigrams between the block and the chunk at most. One matrix product a chunk counts both for all
    sets; only blocks whose bound beats the best so far are scored place by place.

    With a floor, an extent has room for few trigrams that a set doesn't hold: what the text holds of the set, divided
    by the floor, less what the set wants. So a start is tried with that many new places at most.
    """

    STRETCH, BLOCK, CHUNK = 512, 8, 16

    def __init__(self, codes: np.ndarray):
        self.distinct, self.ids = np.unique(codes, return_inverse=True)
        order, n = np.argsort(self.ids, kind="stable"), len(codes)
        self.before = np.full(n + 1, -1, np.int32)
        again = np.flatnonzero(np.diff(self.ids[order]) == 0)
        self.before[order[again + 1]] = order[again]
        self.before[n] = n  # the place beyond the text is never new

    def _places(self, first: int, most: int) -> np.ndarray:
        """The first `most` places that matter to a stretch, made up to whole chunks by places beyond the text."""
        n, end, start, width = len(self.ids), first + self.STRETCH, first, 2 * most
        found: list[np.ndarray] = []
        while start < n and sum(map(len, found)) < most:
            found.append(start + np.flatnonzero(self.before[start : min(n, start + width)] < end))
            start, width = start + width, 4 * width
        own = np.concatenate(found)[:most]
        return np.r_[own, np.full(-len(own) % self.CHUNK, n)].astype(np.int32)

    def best(self, sets: list[np.ndarray], floor: float | np.ndarray) -> np.ndarray:
        """The best extent's Jaccard with each set (sorted codes): exact at or above the floor (one for all or one each), else 0."""
        out, floor = np.zeros(len(sets)), np.broadcast_to(np.asarray(floor, float), len(sets))
        held, wanted = np.zeros((len(sets), len(self.distinct)), bool), np.array([len(s) for s in sets], np.int64)
        codes, owner = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), wanted)
        at = np.minimum(np.searchsorted(self.distinct, codes), max(0, len(self.distinct) - 1))
        same = self.distinct[at] == codes if len(self.distinct) else np.zeros(len(codes), bool)
        held[owner[same], at[same]] = True
        present = held.sum(axis=1)
        able = np.flatnonzero((present > 0) & (present >= floor * wanted - 1e-9))
        for at in range(0, len(able), 64):
            some = able[at : at + 64]
            out[some] = self._search(held[some], present[some], wanted[some], floor[some])
        return np.where(out >= floor, out, 0.0)

    def _search(self, held: np.ndarray, present: np.ndarray, wanted: np.ndarray, floor: np.ndarray) -> np.ndarray:
        n, most = len(self.ids), len(self.distinct) + self.STRETCH
        if (floor > 0).all():  # an extent with more different trigrams can't reach it
            most = min(most, int((wanted / floor).max()) + 2 + self.STRETCH)
        room = np.where(floor > 0, present / np.maximum(floor, 1e-9) - wanted, np.inf) + 1e-6
        hits = np.zeros((n + 1, len(held)), np.float32)
        hits[:n] = held.T[self.ids]
        stretches = [(first, self._places(first, most)) for first in range(0, n, self.STRETCH)]
        tops = np.concatenate([self._tops(first, own, hits[own], present, wanted) for first, own in stretches])
        hit = np.ascontiguousarray(hits.T > 0)
        out = np.zeros(len(held))
        per = self.STRETCH // self.BLOCK
        for q, top in enumerate(tops.T):
            least = floor[q] - 1e-5
            while len(blocks := np.flatnonzero(top > least)):
                first = blocks[np.argmax(top[blocks])]
                some = blocks[(blocks // per == first // per) & (blocks >= first - 4) & (blocks <= first + 4)]  # neighbours rise together
                top[some] = -1.0
                starts = (some[:, None] * self.BLOCK + np.arange(self.BLOCK)).ravel()
                starts = starts[starts < n]
                starts = starts[hit[q, starts]]  # an extent that starts elsewhere only loses
                own = stretches[first // per][1]
                own = own[(own >= starts[0]) & (self.before[own] < starts[-1])] if len(starts) else own[:0]
                if not len(own):
                    continue
                if np.isfinite(room[q]):  # beyond these no start has room; a start's own repeats may stand among them
                    own = own[: int(present[q] + max(0.0, room[q])) + 2 + starts[-1] - starts[0]]
                new = (self.before[own] < starts[:, None]) & (own >= starts[:, None])
                met = hit[q, own]
                counts = np.cumsum(new * np.where(met, 1 << 32 | 1, 1), axis=1)[:, met]  # new hits above new places; an extent that ends elsewhere only loses
                found = counts >> 32
                size = (counts & 0xFFFFFFFF) + wanted[q] - found
                out[q] = max(out[q], float((found / size).max()))
                least = max(least, out[q] - 1e-5)
        return out

    def _tops(self, first: int, own: np.ndarray, hits: np.ndarray, present: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """A bound of the scores of the extents that start in each block of a stretch (rows), for each set.

        Chunk after chunk, so that what is added up stays in the cache. A block's own hits count from the start, which
        adds little to the chunks before it; a place of the stretch stands in `own` where it stands in the stretch.
        """
        starts = np.arange(first, min(len(self.ids), first + self.STRETCH), self.BLOCK)[:, None]
        later = ((own >= starts + self.BLOCK) & (self.before[own] < starts + self.BLOCK)).astype(np.float32)
        chunks, blocks = len(own) // self.CHUNK, len(starts)
        later = np.ascontiguousarray(later.reshape(blocks, chunks, self.CHUNK).transpose(1, 0, 2))
        new = np.zeros((chunks + 1, blocks, 1), np.float32)
        np.cumsum(later.sum(axis=2), axis=0, out=new[1:, :, 0])  # before each chunk
        inside = hits[: blocks * self.BLOCK]
        inside = np.r_[inside, np.zeros((blocks * self.BLOCK - len(inside), hits.shape[1]), np.float32)].reshape(blocks, self.BLOCK, -1).sum(axis=1)
        added = later @ hits.reshape(chunks, self.CHUNK, -1)
        present = np.broadcast_to(present.astype(np.float32), inside.shape).copy()  # counts are exact, quotients to 1e-7
        found, size = inside, inside + wanted.astype(np.float32)
        top, score, union = np.zeros_like(found), np.empty_like(found), np.empty_like(found)
        for c in range(chunks):
            np.add(size, new[c], out=union)
            union -= found  # others before the chunk, and what is wanted
            found += added[c]
            np.minimum(found, present, out=score)
            score /= union
            np.maximum(top, score, out=top)
        return top


def word_similarity(query: str | None, target: str | None, floor: float = 0.0) -> float:
    """Exact at or above the floor, 0 where the floor can't be reached."""
    return float(Extents(trigram_codes(target)).best([np.unique(trigram_codes(query))], floor)[0])


class Asked:
    """Questions' trigram sets with postings, so that a text finds those of which it holds enough without looking at the rest."""

    def __init__(self, questions: list[str], floor: float):
        self.floor, self.sets = floor, [np.unique(trigram_codes(q)) for q in questions]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        codes, owner = np.concatenate([np.zeros(0, np.int64), *self.sets]), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        self.owner = owner[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.least = np.maximum(1, np.ceil(sizes * floor - 1e-9)).astype(np.int64)

    def answers(self, text: str | None, floors: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(question, score) of every question at or above the floor, or above its own of the floors, which are no lower."""
        codes = trigram_codes(text)
        if not len(codes) or not len(self.codes):
            return []
        target = Extents(codes)
        at = np.minimum(np.searchsorted(self.codes, target.distinct), len(self.codes) - 1)
        at = at[self.codes[at] == target.distinct]
        n = self.count[at]
        each = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
        shared = np.bincount(self.owner[each], minlength=len(self.sets))
        able = np.flatnonzero(shared >= self.least)
        least = self.floor if floors is None else floors[able]
        return [(q, s) for q, s in zip(able.tolist(), target.best([self.sets[q] for q in able], least).tolist()) if s > 0]


def chunks(text: str, size: int = 1000) -> list[str]:
    """Pieces of at most size characters, cut at the last white space of the second half; none is blank."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return out
        end = min(at + size, len(text))
        if end < len(text):
            space = max((i for i in range(at, end) if text[i].isspace()), default=-1)
            end = space if space > at + size / 2 else end
        out.append(text[at:end])
        at = end


class _Pieces:
    def eval(self, text: str | None, size: int):
        yield from enumerate(chunks(text or "", size))


def chunk_rows(rows: DataFrame, text: str = "text", size: int = 1000) -> DataFrame:
    """rows, each with its pieces by a lateral join: pos from 0, and chunk; a null text has one empty piece."""
    pieces = F.udtf(_Pieces, returnType="pos int, chunk string", useArrow=True)
    return rows.lateralJoin(pieces(F.col(text).outer(), F.lit(size)))
