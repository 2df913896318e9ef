"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter, in DataFrame functions only.

The filter is a table of 64-bit blocks: a URL's hash names a block and four bits in it, so that a probe reads one
block. Blocks number a power of two in proportion to the list, and at most MOST_BLOCKS, which bounds what is broadcast.
Pages are probed where they are; those whose bits are all set are possible hits, and they alone are shuffled, into an
exact join with the list, which removes the false positives. A list too long for MOST_BLOCKS makes the filter fuller,
so more pages go into the exact join; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

# Rules of host and path, with their verdicts.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: Blocks of the filter at most: 1 << 20 rows of 16 bytes, enough for some ten million URLs.
MOST_BLOCKS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first :// up to / ? # or the end; the path from there up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """host and path without a leading www. or m., a closing slash, the query and the fragment; null without a host."""
    host, path = host_and_path(url)
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _place(url: Column, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(url)
    mask = F.lit(0).cast("long")
    for i in range(4):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.shiftrightunsigned(h, 30).bitwiseAND(F.lit(blocks - 1).cast("long")), mask


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of a list of canonical URLs (url); blocks without a URL have no row."""
    block, mask = _place(F.col("url"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and by (rule, list or none) of each row of pages (page_id, url).

    listed has a column url of canonical URLs, in any number, repeated or null; those are blocked where no rule fits. A
    null url has an empty host and path and is allowed. Repeated rows each have a row; further columns are ignored; an
    empty table or list gives what is left.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    listed = scratch.keep(listed.where("url is not null").select("url").distinct(), "listed")
    blocks = min(MOST_BLOCKS, 1 << max(6, (max(1, listed.count()) // 4).bit_length()))
    bloom = scratch.keep(bloom_filter(listed, blocks), "bloom")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canon"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    block, mask = _place(F.col("canon"), blocks)
    open_ = verdict.isNull() & F.col("canon").isNotNull()
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "canon", F.when(open_, block).alias("block"), mask.alias("mask"))
    probed = rows.join(F.broadcast(bloom), "block", "left")  # at most MOST_BLOCKS rows
    probed = probed.withColumn("possible", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    told = lambda df, verdict, by: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
    hit = F.col("hit").isNotNull()
    exact = probed.where("possible").join(listed.select(F.col("url").alias("hit")), F.col("canon") == F.col("hit"), "left")
    exact = told(exact, F.when(hit, "block").otherwise("allow"), F.when(hit, "list").otherwise("none"))
    return told(probed.where("not possible"), F.coalesce("ruled", F.lit("allow")), F.when(F.col("ruled").isNotNull(), "rule").otherwise("none")).unionAll(exact)
