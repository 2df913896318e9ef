"""A stated set of terms as arrays that go out to tasks: what batches of texts hold of them, and what that scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs of a text's term and a question that are added up at once.
PAIRS = 500_000


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... n[0] of them, then those of starts[1] and so on."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class Terms:
    """Terms of one or more words each, that are to be found in texts; several words stand side by side."""

    def __init__(self, terms: list[list[str]]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in terms for w in t))}
        self.words = pa.array(list(self.number), pa.string())
        self.width = np.array([len(t) for t in terms], np.int64)
        self.parts, self.at = np.array([self.number[w] for t in terms for w in t], np.int64), _ends(self.width)
        first = self.parts[self.at[:-1]]
        self.by_first = np.argsort(first, kind="stable")
        self.starts = _ends(np.bincount(first, minlength=len(self.number)))

    def counts(self, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, how often it stands there), by text and term: words are numbers, others -1, of texts that are lens long."""
        end = np.repeat(np.cumsum(lens), lens)
        place = np.flatnonzero(words >= 0)
        n = np.diff(self.starts)[words[place]]
        term, place = self.by_first[_runs(self.starts[words[place]], n)], np.repeat(place, n)
        for nth in range(1, self.width.max(initial=1)):
            more = np.flatnonzero(self.width[term] > nth)
            if not len(more):  # none is left that long
                break
            to = place[more] + nth
            inside = to < end[place[more]]
            same = inside & (words[np.where(inside, to, 0)] == self.parts[self.at[term[more]] + nth])
            keep = np.ones(len(term), bool)
            keep[more] = same
            term, place = term[keep], place[keep]
        text = np.repeat(np.arange(len(lens)), lens)[place]
        found, tf = np.unique(text * len(self.width) + term, return_counts=True)
        return *np.divmod(found, max(1, len(self.width))), tf


class Asking:
    """The questions of each term: question numbers that lie by term from starts on."""

    def __init__(self, terms: np.ndarray, questions: np.ndarray, n_terms: int, n_questions: int):
        self.questions = questions[np.argsort(terms, kind="stable")]
        self.starts, self.n = _ends(np.bincount(terms, minlength=n_terms)), n_questions

    def scores(self, texts: int, text: np.ndarray, term: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, text, sum of parts) of all questions that share a term with a text; text ascends. A run of texts at a time."""
        n = np.diff(self.starts)[term]
        done = _ends(np.bincount(text, n, texts).astype(np.int64))  # pairs before each text
        at, row = 0, np.searchsorted(text, np.arange(texts + 1))
        while at < texts:
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
            own = slice(row[at], row[to])
            key = np.repeat((text[own] - at) * self.n, n[own]) + self.questions[_runs(self.starts[term[own]], n[own])]
            weight = np.repeat(part[own], n[own])
            if (to - at) * self.n <= 8 * len(key):
                sums = np.bincount(key, weight, (to - at) * self.n)
                met = np.flatnonzero(np.bincount(key, minlength=len(sums)))
                sums = sums[met]
            else:
                met, inverse = np.unique(key, return_inverse=True)
                sums = np.bincount(inverse, weight, len(met))
            yield met % self.n, met // self.n + at, sums
            at = to


class Best:
    """The limit best scores of each question so far."""

    def __init__(self, questions: int, limit: int):
        self.best = np.zeros((questions, limit))  # the least first

    def among(self, question: np.ndarray, score: np.ndarray, slack: float) -> np.ndarray:
        """Which of these scores lie among the best so far, theirs included, or less than slack below."""
        limit, up = self.best.shape[1], score > self.best[question, 0]
        if up.any():
            who, q = np.unique(question[up], return_inverse=True)
            every, s = np.concatenate([np.repeat(np.arange(len(who)), limit), q]), np.concatenate([self.best[who].ravel(), score[up]])
            order = np.lexsort((s, every))
            last = np.searchsorted(every[order], np.arange(len(who)), side="right")
            self.best[who] = s[order][last[:, None] + np.arange(-limit, 0)]
        return score >= self.best[question, 0] - slack
