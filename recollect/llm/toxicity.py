"""Toxicity by a weighted lexicon of word stems, matched by Aho-Corasick in folded text.

Folding lower-cases, turns compatibility forms and look-alike letters of other scripts into Latin ones, and digits and
signs that stand for letters into those letters, so that disguised words meet the lexicon. A hit counts at the start of
a word, the longest of several, unless it lies in an exception phrase. The hits' weights, and their sum over the text's
words, make the two features of a logistic score.

Everything is learnt from a bounded sample of labelled rows: stems whose rate in toxic texts is a multiple of that in
others (weight: the logarithm of the ratio), phrases around a stem that only harmless texts hold, and the score's three
coefficients. Counting runs in Spark; candidates, of bounded number, and the sample's features reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import texts_of
from .scratch import Scratch
from .text import ascii_words, shingles, word_hashes

# Letters that look like Latin ones, and what they look like.
LOOK_ALIKE = dict(zip("аеорсухкмтвнзіјѕԁɡһӏԛԝαενορτυικωχγβ", "aeopcyxkmtbheijsdghlqwaevoptuikwxyb"))
# Digits, and signs between letters, that stand for letters; characters that can't be seen.
DIGITS, SIGNS = dict(zip("0134578", "oieastb")), dict(zip("@$!|", "asil"))
UNSEEN = dict.fromkeys("\u200b\u200c\u200d\u00ad\u2060\ufeff", "")
FOLDS, SIGN = str.maketrans({**LOOK_ALIKE, **DIGITS, **UNSEEN}), re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")
#: Lengths of the stems that are tried, and how many rows of each label are learnt from.
SHORTEST, LONGEST, SAMPLE = 3, 12, 4096
MOST_CANDIDATES, MOST_STEMS, MOST_PHRASES = 20_000, 500, 500


def folded(text: str | None) -> str:
    """The text as the lexicon sees it; a sign that begins or ends a word stays one."""
    if not text:
        return ""
    low = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().translate(FOLDS)
    return SIGN.sub(lambda m: "".join(map(SIGNS.__getitem__, m[0])), low)


@dataclass(frozen=True)
class Lexicon:
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: Intercept, and what the rate and the sum of the weights count.
    coefficients: tuple[float, float, float] = (-8.0, 3.0, 1.0)


def automaton(lexicon: Lexicon):
    """None for an empty lexicon; else it yields (is stem, length, value). A phrase that is a stem itself stays a stem."""
    a = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        a.add_word(phrase, (False, len(phrase), 0.0))
    for stem, weight in lexicon.stems.items():
        a.add_word(stem, (True, len(stem), weight))
    if not len(a):
        return None
    a.make_automaton()
    return a


def hits(low: str, a) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the stems at the start of words, each word once with its longest stem, exception phrases left out."""
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, (stem, n, weight) in a.iter(low) if a else ():
        start = last - n + 1
        if start and low[start - 1].isalnum():
            continue
        if not stem:
            if last + 1 == len(low) or not low[last + 1].isalnum():
                spared.append((start, last + 1))
        elif n > found.get(start, (0, 0.0))[0]:
            found[start] = (n, weight)
    return [(s, s + n, w) for s, (n, w) in sorted(found.items()) if not any(a <= s and s + n <= b for a, b in spared)]


def features(text: str | None, a) -> tuple[float, float]:
    """Two saturating features: of the weights' sum for each word, and of the sum."""
    low = folded(text)
    total = sum(w for _, _, w in hits(low, a))
    return log(1 + 100 * total / max(1, low.count(" ") + 1)), log(1 + total)


def probability(x: np.ndarray, coefficients: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ np.array(coefficients[1:]), -500, 500)))


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon)
        for batch in batches:
            x = np.array([features(t, a) for t in texts_of(batch.column(1))], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(x, lexicon.coefficients))], names=["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text), whole texts; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(lexicon), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; those without an id are not among them, and have no label either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) with rep, the least hash of the text's five-word shingles: near copies mostly have one in common."""
    for batch in batches:
        sets = [shingles(word_hashes(ascii_words(t)), 5) for t in texts_of(batch.column(2))]
        reps = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reps)], names=["doc_id", "toxic", "text", "rep"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the sample: how often, and in how many texts, each stem begins a word; the empty stem counts words and texts."""
    many, texts = (Counter(), Counter()), (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            own: Counter = Counter()
            for w, k in Counter(WORD.findall(folded(text))).items():
                own[""] += k
                for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    own[w[:n]] += k
            own[""] = max(1, own[""])
            many[toxic].update(own)
            texts[toxic].update(own.keys())
    every = list({*many[0], *many[1]})
    for at in range(0, len(every), 50_000):
        some = every[at : at + 50_000]
        cols = [pa.array([c[s] for s in some], pa.int64()) for c in (*many, *texts)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *cols], names=["stem", "n0", "n1", "d0", "d1"])


def _phrases(lexicon: Lexicon):
    """Of a part of the sample: in how many texts a stem's word stands beside another one, as (phrase, label, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon)
        texts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                low = folded(text)
                starts = {s for s, _, _ in hits(low, a)}
                words = list(WORD.finditer(low)) if starts else []
                own = set()
                for i, w in enumerate(words):
                    if w.start() in starts:
                        own |= {low[x.start() : y.end()] for x, y in ((words[max(0, i - 1)], w), (w, words[min(i + 1, len(words) - 1)])) if x is not y}
                texts.update((p, toxic) for p in own if len(p) <= 80)
        rows = list(texts.items())
        yield pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["phrase", "toxic", "n"])

    return run


def choose_stems(rows: list[tuple[str, int, int, int, int]], whole: tuple[int, int, int, int], least_ratio: float = 4.0, least_gain: float = 15.0) -> dict[str, float]:
    """Stems with their weights from counts (stem, n0, n1, d0, d1) and those of all words and texts.

    A stem qualifies where its share of words and of texts is a multiple in toxic texts and its gain, texts times
    weight, is no chance. Of stems that begin alike the one that gains most stays, the longest within a twentieth of it.
    """
    n0, n1, d0, d1 = whole
    weight = {s: log((b + 0.5) / (n1 + 1)) - log((a + 0.5) / (n0 + 1)) for s, a, b, _, _ in rows}
    share = {s: (d + 0.5) / (d1 + 1) * (d0 + 1) / (c + 0.5) for s, _, _, c, d in rows}
    docs = {s: d for s, *_, d in rows}
    gain = lambda s: docs[s] * weight[s]
    able = {s for s in docs if docs[s] >= max(3, 0.004 * d1) and gain(s) >= least_gain and weight[s] >= log(least_ratio) and share[s] >= 0.75 * least_ratio}
    out: dict[str, float] = {}
    for s in sorted(able, key=lambda s: (-gain(s), s)):
        if any(s.startswith(o) or o.startswith(s) for o in out):
            continue
        longer = [x for x in able if x.startswith(s) and gain(x) >= 0.95 * gain(s)]
        best = max(longer, key=lambda x: (len(x), gain(x), x))
        out[best] = weight[best]
        if len(out) == MOST_STEMS:
            break
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Newton's steps with a small ridge; a label that doesn't occur leaves the score at its share."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weights * (y - p)) - 1e-2 * w
        bend = (a * (weights * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon of the labelled rows (doc_id, toxic: 0 or 1) that aren't held out, with the texts of docs (doc_id, text).

    At most `sample` rows of each label are learnt from, those of the least hashes of their ids. A doc_id with several
    labels has the largest, one with several texts the first in order; rows without id or label teach nothing. Without
    labels, or with one only, the lexicon is empty. Of the sample's near copies one is learnt from, lest their other
    words enter the lexicon. `exceptions` are further exception phrases.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = scratch.keep(known.groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = scratch.keep(some[0].unionAll(some[1]), "chosen")  # two samples of ids at most: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sketched = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).mapInArrow(_sketch, "doc_id long, toxic int, text string, rep long")
    one = sketched.groupBy("toxic", "rep").agg(F.min(F.struct("doc_id", "text")).alias("one"))
    held = scratch.keep(one.select("toxic", F.coalesce("one.text", F.lit("")).alias("text")), "texts")
    own = Lexicon(exceptions=tuple(folded(e) for e in exceptions))
    if len(counts) < 2:
        return own
    table = held.mapInArrow(_count, "stem string, n0 long, n1 long, d0 long, d1 long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))
    table = scratch.keep(table.where("d1 >= 3 or stem = ''"), "stems")
    whole = table.where("stem = ''").first()
    if whole is None or not whole.d0 or not whole.d1:
        return own
    ratio = (F.col("n1") + 0.5) / (whole.n1 + 1) / (F.col("n0") + 0.5) * (whole.n0 + 1)
    best = table.where("stem <> ''").where(ratio >= 4).orderBy(F.desc(F.col("d1") * F.ln(ratio)), "stem").limit(MOST_CANDIDATES)
    stems = choose_stems([tuple(r) for r in best.select("stem", "n0", "n1", "d0", "d1").collect()], (whole.n0, whole.n1, whole.d0, whole.d1))
    found = Lexicon(stems, own.exceptions)
    phrases = held.mapInArrow(_phrases(found), "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"), F.max("toxic").alias("toxic"))
    spared = [r.phrase for r in phrases.where("toxic = 0 and clean >= 3").orderBy(F.desc("clean"), "phrase").limit(MOST_PHRASES).collect()]
    found = Lexicon(stems, (*own.exceptions, *spared))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(found)
        for batch in batches:
            x = np.array([features(t, a) for t in texts_of(batch.column(1))], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "x1", "x2"])

    rows = sorted(held.mapInArrow(measure, "toxic int, x1 double, x2 double").collect())  # two samples at most
    y = np.array([r.toxic for r in rows], float)
    share = [counts[c] / max(1, int((y == c).sum())) for c in (0, 1)]  # the sample's rows stand for all of their label
    weights = np.where(y == 1, share[1], share[0])
    return Lexicon(stems, found.exceptions, fit_logistic(np.array([[r.x1, r.x2] for r in rows]), y, weights / weights.mean()))


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of each row of docs (doc_id, text).

    Only texts make a score. Null and empty texts have no hits and the least score; repeated rows each have a row;
    further columns are ignored; an empty table gives an empty result.
    """
    scored = score_texts(docs, learn(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
