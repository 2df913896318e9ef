"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings, in DataFrame functions only.

A candidate is a run of at least `window` characters of one class: hexadecimal; letters, digits and +/_- with some digit
and some letter; letters alone. A window slides over it; the counts of the character that enters and of the one that
leaves change, and with them the sum of n log2 n, from which the entropy follows. A candidate whose best window reaches
its class's threshold is a span, unless the allow list names it: a run ends where a place holder begins, so only what
stands beside it is judged, and identifiers in UUID form or of capitalised words are none.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .fingerprints import let

# Patterns of the three base kinds, with the least length of what must be long.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
# Words that stand in place holders, and forms of runs that are no secrets.
ALLOW = r"example|placeholder|sample|dummy|changeme|xxxx|0123456789|abcdefgh"
NO_SECRET = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$|^[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})+$"
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches that keep() accepts: what split() leaves between the matches gives the offsets."""

    def walk(parts: Column) -> Column:
        gaps, found = parts.gaps, parts.found
        zero = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))

        def step(acc: Column, i: Column) -> Column:
            m = F.element_at(found, i)
            start = acc["at"] + F.char_length(F.element_at(gaps, i))
            end = start + F.char_length(m)
            span = F.array(F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end")))
            return F.struct(end.cast("long").alias("at"), F.when(keep(m), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), zero, step).out).otherwise(_none())

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), walk)


#: Counts of a window's characters, + to z, twelve to a whole number of 60 bits, five bits each: windows of 31 at most.
FIRST, EACH, WORDS, BITS = ord("+"), 12, 7, 5


def window_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of a string of letters, digits and +/_-, by incremental counts."""
    if not 1 <= window <= 31:
        raise ValueError("a window has 1 to 31 characters")
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    terms = F.array(*(F.lit(0.0 if n < 2 else n * log2(n)) for n in range(window + 2)))
    places = F.array(*(F.struct(F.lit(i // EACH).alias("word"), F.lit(i % EACH * BITS).alias("shift"), F.lit(1 << i % EACH * BITS).cast("long").alias("one")) for i in range(EACH * WORDS)))

    def _fold(codes: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1e9).alias("low"), F.array_repeat(F.lit(0).cast("long"), WORDS).alias("counts"))
        none = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("one"))

        def step(acc: Column, i: Column) -> Column:
            enter = F.element_at(codes, i)
            leave = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(none)
            count = lambda p: F.call_function("shiftright", F.element_at(acc["counts"], F.greatest(p["word"], F.lit(0)) + 1), p["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
            n_in, n_out = count(enter), F.when(leave["word"] < 0, 1).otherwise(count(leave))
            more = F.element_at(terms, n_in + 2) - F.element_at(terms, n_in + 1)
            less = F.element_at(terms, n_out + 1) - F.element_at(terms, n_out)
            total = acc["sum"] + F.when(enter == leave, 0.0).otherwise(more - less)
            change = lambda p, k: F.when(p["word"] == k, p["one"]).otherwise(F.lit(0).cast("long"))
            counts = F.transform(acc["counts"], lambda w, k: w + change(enter, k) - change(leave, k))
            return F.struct(total.alias("sum"), F.when(i >= window, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"), counts.alias("counts"))

        low = F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step).low
        return F.when(F.size(codes) >= window, F.lit(log2(window)) - low / window).otherwise(F.lit(0.0))

    return let(F.transform(chars, lambda x: F.element_at(places, F.ascii(x) - (FIRST - 1))), _fold)


def _ordered(spans: Column) -> Column:
    return F.transform(F.sort_array(F.transform(F.array_distinct(spans), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.7, letter_bits: float = 3.64, allow: str = ALLOW) -> DataFrame:
    """All columns of docs, and _base and _spans: sorted arrays of (kind, start, end) of each row's text.

    kind is 0 assign, 1 access, 2 hex, 3 entropy; offsets count code points, the end is exclusive. allow is a pattern,
    in any case, of words that no run holds. Null and empty texts
    have no spans. Every row is judged alone, so ties, repeated rows and hot sources need no care.
    """
    t = F.coalesce("text", F.lit(""))

    def when(test: Column, value: Column) -> Column:
        return F.when(test, value).otherwise(_none())

    assign = when((F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & F.rlike(t, F.lit(ASSIGN)), _spans(t, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6))
    # A run shorter than the least length holds no longer one, so the length can stand in these two patterns.
    access = when(F.contains(t, F.lit("AKIA")), _spans(t, r"AKIA[A-Z0-9]{16,}", 1, lambda m: F.lit(True)))
    hexes = when(F.rlike(t, F.lit(r"[0-9a-f]{24}")), _spans(t, r"[0-9a-f]{24,}", 2, lambda m: F.lit(True)))

    def secret(bits: float, some: str):
        return lambda m: F.rlike(m, F.lit(some)) & ~F.rlike(m, F.lit(NO_SECRET)) & (window_entropy(m, window) >= bits)

    # A run ends where a word of the allow list begins, and may begin again within it.
    run = lambda chars: rf"(?:(?!(?i:{allow}))[{chars}]){{{window},}}+"
    hex_run, mixed_run = rf"(?<![0-9A-Fa-f]){run('0-9A-Fa-f')}(?![0-9A-Za-z])", run("A-Za-z0-9+/_-")
    letter_run = rf"(?<![A-Za-z]){run('A-Za-z')}(?![A-Za-z])"
    both = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"
    some_digit = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{window},}}+"
    mixed = when(F.rlike(t, F.lit(some_digit)), F.concat(_spans(t, hex_run, 3, secret(hex_bits, both)), _spans(t, mixed_run, 3, secret(mixed_bits, both))))
    letters = when(F.rlike(t, F.lit(rf"[A-Za-z]{{{window}}}")), _spans(t, letter_run, 3, secret(letter_bits, "^[A-Za-z]")))
    entropy = F.concat(mixed, letters)
    found = docs.withColumn("_base", F.concat(assign, access, hexes)).withColumn("_entropy", entropy)
    return found.withColumn("_spans", _ordered(F.concat("_base", "_entropy"))).withColumn("_base", _ordered(F.col("_base"))).drop("_entropy")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """The spans as counts, a digest of the base spans, and text."""
    count = lambda k: F.size(F.filter("_base", lambda s: s.kind == k)).cast("long")
    return find_secrets(docs.select("doc_id", "text"), **options).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by the mark, n_chars counted anew; null texts stay null."""

    def cut(spans: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substr("text", (acc["at"] + 1).cast("int"), (s.start - acc["at"]).cast("int"))
            return F.struct(F.greatest(acc["at"], s.end).alias("at"), F.when(s.start < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

        return let(F.aggregate(spans, zero, step), lambda a: F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"))))

    found = find_secrets(docs.select(F.struct("*").alias("_row"), "text"), **options)
    clean = F.when(F.col("text").isNotNull() & (F.size("_spans") > 0), cut(F.col("_spans"))).otherwise(F.col("text"))
    found = found.select("_row", clean.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))
