"""License scans by an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

A block is a line, or a window of consecutive tokens over several lines, for notices that are wrapped. A template's
windows are as long as it can be and still make up `percent` of one; tokens of lines that meet the template by
themselves count in no window. Notices of several licences may differ in one word, so a block must also hold a token
that names the licence, where the template does, and none that names another. Tokens are ordered by how many documents of the whole corpus hold them, rarest first. A
block meets a template if it holds at least `percent` of the template's distinct tokens. Such a block must hold one of the
template's first |T| - ceil(percent * |T|) + 1 tokens (prefix filter), have at least ceil(percent * |T|) tokens
(length filter), and the tokens left in the template after the first shared one must suffice (positional filter). Windows
are looked for only around the prefix tokens. The templates are a bounded constant, so the join is against literals: no document moves, and a hot source is only rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from .fingerprints import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices.
TEMPLATES = {
    "apache-2": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Released under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

# Tokens that name a licence. A template that holds one is met only by blocks that do.
NAMES = {"apache-2": ["apache"], "cc-by-nc": ["nc", "noncommercial"], "gpl": ["gnu"], "mit": ["mit"], "mpl": ["mozilla"]}

# Tokens that make another licence of a notice.
APART = {"cc-by": ["noncommercial", "noderivatives", "sharealike", "nc", "nd", "sa"]}


def lower_ascii(text: Column) -> Column:
    """The text (null: empty) with A-Z lower-cased, and no other character turned into an ASCII one.

    lower() gives ASCII letters for two characters only; whatever else it changes stays a word's non-ASCII character.
    """
    t = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.contains(t, F.lit("\u0130")) | F.contains(t, F.lit("\u212a")), F.translate(t, upper, upper.lower())).otherwise(F.lower(t))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _template_tokens(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """The templates' tokens in order, cut by the rule that cuts the documents."""
    import re

    cut = re.compile(WORD)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return [(label, cut.findall(t.translate(lower))) for label, texts in sorted(templates.items()) for t in texts]


def words(low: Column) -> Column:
    """A lower-cased text's tokens; what split() leaves empty at the ends goes."""
    return F.filter(F.split(low, GAP), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each token of a fixed vocabulary; one row for each of them reaches the driver."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(lower_ascii(F.col("text")), GAP))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {**dict.fromkeys(vocabulary, 0), **{r.w: r.n for r in rows}}


def scan_licenses(docs: DataFrame, percent: int = 80, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, names: dict[str, list[str]] = NAMES, apart: dict[str, list[str]] = APART) -> DataFrame:
    """Words, phrase places, labels and score of each row of docs (doc_id, text), and the blocks found.

    blocks lists (line, label, share) of every line and template that meet the threshold, then those of the windows: of
    windows that start close together the best, the first of equals, with the line of its first token; base_labels come from the
    phrases, labels from both. score is the largest share (1 for a phrase), 0 without a find. A null text counts as
    empty. Repeated rows each have a row; further columns are ignored; an empty table gives an empty result.
    """
    texts = _template_tokens(templates)
    sets = [(label, list(dict.fromkeys(ws))) for label, ws in texts]
    spans = [ceil(100 * len(ws) / percent) for _, ws in texts]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    frequency = document_frequencies(docs, vocabulary)
    ordered = [(label, sorted(ws, key=lambda w: (frequency[w], w))) for label, ws in sets]
    named = [[w for w in ws if w in names.get(label, ())] for label, ws in ordered]
    other = [apart.get(label, []) for label, _ in ordered]
    need = [ceil(percent * len(ws) / 100) for _, ws in ordered]
    prefixes = sorted({w for (_, ws), n in zip(ordered, need) for w in ws[: len(ws) - n + 1]})

    low = lower_ascii(F.col("text"))
    inside = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    maybe_block = f"(?<!{inside})(?:{'|'.join(prefixes)})(?!{inside})"
    some = lambda w, of: F.arrays_overlap(w, F.array(*map(F.lit, of)))
    rare = sorted({max(p.split(), key=len) for p in phrases})  # a phrase's longest word, looked up before its pattern
    maybe_phrase = "|".join(GAP.join(p.split()) for p in phrases)
    base = docs.select("doc_id", low.alias("low"))
    base = base.select("doc_id", "low", let(words(F.col("low")), lambda w: F.struct(F.size(w).cast("long").alias("n"), some(w, rare).alias("phrase"), some(w, prefixes).alias("block"))).alias("has"))
    base = base.select("doc_id", "low", F.col("has.n").alias("n_words"), (F.col("has.phrase") & F.rlike("low", F.lit(maybe_phrase))).alias("has_phrase"), F.col("has.block").alias("has_block"))

    def places(w: Column) -> Column:
        def at(phrase: str, label: str) -> Column:
            parts = phrase.split()
            starts = F.filter(F.sequence(F.lit(1), F.size(w) - (len(parts) - 1)), lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda j: F.element_at(w, (i + j).cast("int")) == F.element_at(F.array(*map(F.lit, parts)), (j + 1).cast("int"))))
            return F.when(F.size(w) >= len(parts), F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))

        return F.flatten(F.array(*(at(p, label) for p, label in phrases.items())))

    none = F.array().cast("array<struct<start:bigint,label:string>>")
    kind = "array<struct<line:bigint,label:string,share:double>>"
    by_template = "array<struct<template:int,line:bigint,label:string,share:double>>"

    def block(template: int, line: Column, share: Column) -> Column:
        return F.struct(F.lit(template).alias("template"), line.cast("long").alias("line"), F.lit(ordered[template][0]).alias("label"), share.alias("share"))

    def met(line: Column, number: Column) -> Column:
        def against(b: Column) -> Column:
            found = []
            for k, ((_, ws), n) in enumerate(zip(ordered, need)):
                literal = F.array(*map(F.lit, ws))
                shared = lambda t, ws=ws: F.array_intersect(t, b)
                head = F.array(*map(F.lit, ws[: len(ws) - n + 1]))
                first = F.array_position(literal, F.element_at(F.array_intersect(head, b), 1))
                full = F.size(shared(literal))
                known = (some(b, named[k]) if named[k] else F.lit(True)) & (~some(b, other[k]) if other[k] else F.lit(True))
                passes = known & (F.size(b) >= n) & F.arrays_overlap(head, b) & (F.lit(len(ws)) - first + 1 >= n) & (full >= n)
                found.append(F.when(passes, F.array(block(k, number, full / len(ws)))).otherwise(F.array().cast(by_template)))
            return F.flatten(F.array(*found))

        return F.when(F.rlike(line, F.lit(maybe_block)), let(F.array_distinct(tokens(line)), against)).otherwise(F.array().cast(by_template))

    def windows(w: Column, lines: Column) -> Column:
        """Blocks over several lines, from the text's tokens (t, line) and the blocks of its lines."""

        def of(k: int, places: Column) -> Column:
            ws, n, span = ordered[k][1], need[k], spans[k]
            literal, head = F.array(*map(F.lit, ws)), F.array(*map(F.lit, ws[: len(ws) - n + 1]))
            own = F.transform(F.filter(lines, lambda b: b.template == k), lambda b: b.line)

            def held(start: Column, length: Column) -> Column:
                """How many of the template's tokens a stretch holds, lines that meet it by themselves left out."""
                rest = F.filter(F.slice(w, start, length), lambda x: ~F.array_contains(own, x.line))
                return F.size(F.array_intersect(literal, F.transform(rest, lambda x: x.t)))

            def best(at: Column) -> Column:
                starts = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(first(p), p)))))
                starts = F.filter(starts, lambda i: F.array_contains(literal, F.element_at(w, i).t))
                each = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), held(i, F.lit(span)).alias("n"))), lambda x: x["n"] >= n)
                inside = lambda x: F.transform(F.filter(F.slice(w, x["at"], span), lambda y: ~F.array_contains(own, y.line)), lambda y: y.t)
                if named[k]:
                    each = F.filter(each, lambda x: some(inside(x), named[k]))
                if other[k]:
                    each = F.filter(each, lambda x: ~some(inside(x), other[k]))

                def step(kept: Column, x: Column) -> Column:
                    last = F.try_element_at(kept, F.lit(-1))
                    apart = last.isNull() | (x["at"] >= last["at"] + n)
                    return F.when(apart, F.concat(kept, F.array(x))).when(x["n"] > last["n"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

                kept = F.aggregate(each, F.array().cast("array<struct<at:int,n:int>>"), step)
                return F.transform(kept, lambda x: block(k, F.element_at(w, x["at"]).line, x["n"] / len(ws)))

            first = lambda p: F.greatest(p - (span - 1), F.lit(1))
            at = F.transform(F.filter(places, lambda p: F.array_contains(head, p.t) & ~F.array_contains(own, p.line)), lambda p: p["at"])
            at = F.filter(at, lambda p: held(first(p), p - first(p) + span) >= n)
            return let(at, lambda x: F.when(F.size(x) > 0, best(x)).otherwise(F.array().cast(by_template)))

        def near(places: Column) -> Column:
            return F.flatten(F.array(*(of(k, places) for k in range(len(ordered)))))

        heads = F.array(*map(F.lit, prefixes))
        each = F.transform(w, lambda x, i: F.struct((i + 1).alias("at"), x.t.alias("t"), x.line.alias("line")))
        return let(F.filter(each, lambda x: F.array_contains(heads, x.t)), lambda places: F.when(F.size(places) > 0, near(places)).otherwise(F.array().cast(by_template)))

    def judged(parts: Column) -> Column:
        numbered = F.flatten(F.transform(parts, lambda line, k: F.transform(tokens(line), lambda t: F.struct(t.alias("t"), k.cast("long").alias("line")))))
        both = let(F.flatten(F.transform(parts, met)), lambda lines: F.concat(lines, F.when(F.size(parts) > 1, let(numbered, lambda w: windows(w, lines))).otherwise(F.array().cast(by_template))))
        return F.transform(both, lambda b: F.struct(b.line.alias("line"), b.label.alias("label"), b.share.alias("share")))

    rows = base.select(
        "doc_id",
        "n_words",
        F.when(F.col("has_phrase"), let(words(F.col("low")), places)).otherwise(none).alias("places"),
        F.when(F.col("has_block"), let(F.split("low", "\n"), judged)).otherwise(F.array().cast(kind)).alias("blocks"),
    )
    starts = F.transform("places", lambda p: p.start)
    base_labels = F.array_distinct(F.transform("places", lambda p: p.label))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.transform("blocks", lambda b: b.label))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b.share)), F.lit(0.0))).alias("score"),
        "blocks",
    )
