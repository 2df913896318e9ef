"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules judge a document alone. Beyond them, each language and source gets a minimum-covariance-determinant estimate
of four transformed statistics, and documents whose Mahalanobis distance exceeds the cut are rejected. The estimate
starts from medians and quartiles and takes concentration steps: the h documents nearest to the centre give the next
mean and covariance. Distances are counted in fine bins, so a step is one aggregation with map-side sums and holds a
few hundred numbers a group however many documents a hot source has; h is rounded up to a whole bin, and least standard
deviations are added to every estimate, so the determinant falls as in the exact steps but for these two. Statistics
are whole thousandths and sums are exact (up to 9e10 documents in one bin of a group), so the verdict doesn't depend
on the order of rows.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fingerprints import let
from .scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
X = ["x1", "x2", "x3", "x4"]
P = len(X)
#: Least standard deviations, in thousandths of each transformed statistic: no group is so even that less is odd.
FLOOR = [350.0, 80.0, 500.0, 700.0]
BINS = 400


def _chi2(x: float, dof: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    return 1 - exp(-x / 2) * sum((x / 2) ** j / factorial(j) for j in range(dof // 2))


def _consistency(share: float) -> float:
    """What makes the covariance of the nearest share of normal data that of all of it."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, P) < share else (low, mid)
    return share / _chi2(low, P + 2)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeated(w: Column, width: int = 5) -> Column:
    """How many words stand in a window of `width` words that the text holds twice or more."""
    starts = F.sequence(F.lit(1), F.size(w) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(width))))

    def exact(_: Column) -> Column:  # only where some hash repeats; the words themselves decide
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("s"), i.alias("i"))))

        def places(z: Column) -> Column:
            same = lambda a, b: F.element_at(z, a).s == F.element_at(z, b).s
            n = F.size(z)
            again = F.filter(F.sequence(F.lit(1), n), lambda j: ((j > 1) & same(j, F.greatest(j - 1, F.lit(1)))) | ((j < n) & same(j, F.least(j + 1, n))))
            return let(F.sort_array(F.transform(again, lambda j: F.element_at(z, j).i)), covered)

        return let(windows, places)

    def covered(at: Column) -> Column:
        n = F.size(at)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, j: acc + F.when(j < n, F.least(F.element_at(at, F.least(j + 1, n)) - F.element_at(at, j), F.lit(width))).otherwise(F.lit(width)))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) > width, found).otherwise(F.lit(0))


def base_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row's whole text."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    both = let(_words(t), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    rows = docs.select("doc_id", *more, both.alias("w"), F.char_length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = rows.select("doc_id", *more, F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _moments() -> list[Column]:
    sums = [F.sum(x).alias(f"s_{x}") for x in X]
    return [F.count("*").alias("n"), *sums, *(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for i, a in enumerate(X) for b in X[: i + 1])]


def _factor(stats: DataFrame, scale: float) -> DataFrame:
    """Means m_, and the lower triangle l_ of the Cholesky factor of scale * covariance + floor, from n and the sums."""
    out = stats.select("*", *((F.col(f"s_{x}") / F.col("n")).alias(f"m_{x}") for x in X))
    cov = [((F.col(f"s_{a}{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")) * scale + (FLOOR[i] ** 2 if a == b else 0.0)).alias(f"c_{i}{j}") for i, a in enumerate(X) for j, b in enumerate(X[: i + 1])]
    return _cholesky(out.select("lang", "source", "pool", "n_all", *(f"m_{x}" for x in X), *cov))


def _cholesky(df: DataFrame) -> DataFrame:
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            df = df.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}{j}"))
    return df.drop(*(f"c_{i}{j}" for i in range(P) for j in range(i + 1)))


def _distance(df: DataFrame) -> DataFrame:
    """d2, the squared Mahalanobis distance, by forward substitution."""
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", rest / F.col(f"l_{i}{i}"))
    total = F.lit(0.0)
    for i in range(P):
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return df.withColumn("d2", total)


GROUP = ["lang", "source", "pool"]
#: Groups up to which the estimates are broadcast (400 bytes each); beyond, rows meet them by salted shuffle joins.
MOST_GROUPS = 20_000
SALTS = 64


def _meet(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with their group's estimates; a hot group's rows never go to one task."""
    if stats.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        return rows.join(F.broadcast(stats), keys, how)
    salted = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def robust_estimates(features: DataFrame, scratch: Scratch, share: float, steps: int) -> DataFrame:
    """Mean and Cholesky factor of each (lang, source), and of all rows (pool), with the group's size n_all."""
    everyone = F.struct(F.lit("").alias("lang"), F.lit("").alias("source"), F.lit(True).alias("pool"))
    rows = features.select(*X, F.explode(F.array(F.struct("lang", "source", F.lit(False).alias("pool")), everyone)).alias("g")).select(*X, "g.*")
    width = 20
    each = rows.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) / width).alias("b")) for i, x in enumerate(X)))).alias("v")).select(*GROUP, "v.*")
    hist = each.groupBy(*GROUP, "i", "b").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*GROUP, "i").orderBy("b")
    hist = hist.withColumn("upto", F.sum("c").over(run)).withColumn("n_all", F.sum("c").over(Window.partitionBy(*GROUP, "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n_all") * q, F.col("b"))) * width
    quart = hist.groupBy(*GROUP, "n_all", "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    start = quart.groupBy(*GROUP, "n_all").agg(*((pick("mid", i) + width / 2).alias(f"m_{x}") for i, x in enumerate(X)), *(F.pow((pick("hi", i) - pick("lo", i)) / 1.349, F.lit(2.0)).alias(f"v{i}") for i in range(P)))
    start = start.select(*GROUP, "n_all", *(f"m_{x}" for x in X), *((F.col(f"v{i}") + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i in range(P) for j in range(i + 1)))
    stats = scratch.keep(_cholesky(start), "start")
    scale = _consistency(share)
    for s in range(steps):
        near = _distance(_meet(rows, stats, GROUP)).withColumn("bin", F.least(F.floor(F.log2(F.col("d2") + 1) * 16), F.lit(BINS)))
        binned = near.groupBy(*GROUP, "n_all", "bin").agg(*_moments())
        before = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("bin")) - F.col("n")
        nearest = binned.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n_all") * share))
        sums = nearest.groupBy(*GROUP, "n_all").agg(*(F.sum(c).alias(c) for c in binned.columns if c == "n" or c.startswith("s_")))
        stats = scratch.keep(_factor(sums, scale), f"step-{s}")
    return stats


def _features(docs: DataFrame, *more: str) -> DataFrame:
    """base_statistics() and the four transformed statistics in whole thousandths."""
    rate = lambda n, d, by: F.ln(1 + F.col(n) * by / (F.col(d) + 1))
    shape = [F.ln(F.col("n_words") + 1), rate("word_chars", "n_words", 1.0), rate("n_symbols", "word_chars", 1000.0), rate("n_dup_lines", "n_words", 1000.0)]
    return base_statistics(docs, "lang", "source", *more).select("*", *(F.round(e * 1000).cast("long").alias(x) for x, e in zip(X, shape)))


def _shrunk(stats: DataFrame, prior: float) -> DataFrame:
    """Each group's estimate, drawn towards that of all rows as if the group had `prior` more rows distributed like all."""
    names = [c for c in stats.columns if c[:2] in ("m_", "l_")]
    pool = stats.where("pool").select(*(F.col(c).alias(f"all_{c}") for c in names))
    both = stats.where("not pool").join(F.broadcast(pool))  # one row
    own = F.col("n_all") / (F.col("n_all") + prior)
    cov = lambda p, i, j: sum((F.col(f"{p}l_{i}{k}") * F.col(f"{p}l_{j}{k}") for k in range(1, j + 1)), F.col(f"{p}l_{i}0") * F.col(f"{p}l_{j}0"))
    gap = [F.col(f"m_{x}") - F.col(f"all_m_{x}") for x in X]
    mean = [(F.col(f"m_{x}") * own + F.col(f"all_m_{x}") * (1 - own)).alias(f"m_{x}") for x in X]
    mixed = [(cov("", i, j) * own + cov("all_", i, j) * (1 - own) + gap[i] * gap[j] * own * (1 - own)).alias(f"c_{i}{j}") for i in range(P) for j in range(i + 1)]
    return _cholesky(both.select("lang", "source", *mean, *mixed))


def _judged(features: DataFrame, stats: DataFrame, cut: float, prior: float) -> DataFrame:
    """features with d2 and kept."""
    held = _meet(features, _shrunk(stats, prior), ["lang", "source"], "left")
    return _distance(held).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut))


def _grouped(docs: DataFrame, *more: Column) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)  # noqa: E731 - null is a name of its own
    return docs.select("doc_id", "text", name("lang"), name("source"), *more)


def judge_quality(docs: DataFrame, cut: float = 60.0, share: float = 0.75, steps: int = 4, prior: float = 50.0) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance of each row of docs (doc_id, text, lang, source).

    A row is kept if it passes the base rules and its squared distance is at most `cut` (60: about 3e-12 of normal
    data). A group's estimate is drawn towards that over all groups by the weight of `prior` rows: four statistics have
    14 moments, so a few rows say little, and many outweigh the rest. A null lang or source is a
    group of its own; a null text has no words and fails. The distance is null in a group where no row passes the base
    rules. Repeated rows each have a row; further columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.keep(_features(_grouped(docs)), "features")
    stats = robust_estimates(features.where("not base_failed"), scratch, share, steps)
    d = _judged(features, stats, cut, prior)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance"))


def keep_good(docs: DataFrame, cut: float = 60.0, share: float = 0.75, steps: int = 4, prior: float = 50.0) -> DataFrame:
    """The rows of docs that judge_quality() keeps, with all columns.

    Statistics are taken once and written beside the rows that pass the base rules; the estimates read only the
    statistics back, and the verdict joins nothing but the estimates, so texts stay where they are.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = _features(_grouped(docs, F.struct("*").alias("_row")), "_row").select("lang", "source", "_row", *X, "base_failed")
    held = scratch.keep(rows, "rows").where("not base_failed")
    stats = robust_estimates(held.select("lang", "source", *X), scratch, share, steps)
    return _judged(held, stats, cut, prior).where("kept").select("_row.*")
