"""Vectors, hashing and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import TIER_BOOST


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different widths are an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in width")).cast("double"))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(checked, F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors, of length one; null for none, and where its length is zero or not finite."""
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.when(F.size(vectors) > 0, F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double"))))
    norm = F.sqrt(dot(total, total))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(total, lambda x: x / norm))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a; ASCII input, as the query tokens are."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def hashed_index(token: Column, dim: int = 1536) -> Column:
    return fnv1a(token) % dim


def hashed_sign(token: Column) -> Column:
    return F.when(fnv1a(token) % 2 == 1, 1).otherwise(-1)


def length_prior(n: Column) -> Column:
    return F.when(n > 2000, 1 / (1 + F.ln(F.greatest(n, F.lit(1)) / 2000))).otherwise(F.lit(1.0))


def tier_boost(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, boost in TIER_BOOST.items():
        out = F.when(tier == name, boost).otherwise(out)
    return out


def reason(legs: Column) -> Column:
    one = F.element_at(legs, 1)
    single = F.when(one == "text", "text_match").when(one == "trigram", "lexical_match").otherwise("semantic_match")
    return F.when(F.size(legs) > 1, "hybrid_match").otherwise(single)
