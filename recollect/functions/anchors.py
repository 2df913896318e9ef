"""Anchors, change kinds and staleness reasons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a path, the last #, and a dotted identifier.
ANCHOR = r"^(.+)#([A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*)$"


def parse_anchor(text: Column) -> Column:
    """(path, symbol): the last # cuts, if a dotted identifier follows it; else all is the path."""
    t = F.trim(text)
    cut = F.rlike(t, F.lit(ANCHOR))
    return F.struct(F.when(cut, F.regexp_extract(t, ANCHOR, 1)).otherwise(t).alias("path"), F.when(cut, F.regexp_extract(t, ANCHOR, 2)).alias("symbol"))


def parse_any_anchor(text: Column) -> Column:
    """parse_anchor() of a string, or the path and symbol of a JSON object's text."""
    object_ = F.from_json(text, "path string, symbol string")
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.struct(object_.path.alias("path"), object_.symbol.alias("symbol"))).otherwise(parse_anchor(text))


def relative_path(path: str, repo: str) -> str:
    """A path as the repository names it: absolute ones made relative, . and .. resolved; a #symbol is not part of it."""
    import os

    return os.path.relpath(os.path.join(repo, path), repo)


def format_anchor(anchor: Column) -> Column:
    return F.when(anchor.symbol.isNull(), anchor.path).otherwise(F.concat(anchor.path, F.lit("#"), anchor.symbol))


def is_node_id(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9a-f]{32}$"))


def anchors_from_nodes(nodes: Column) -> Column:
    """Blanks and node ids dropped, the rest parsed, first occurrences kept."""
    return F.array_distinct(F.transform(F.filter(nodes, lambda n: (F.trim(n) != "") & ~is_node_id(n)), parse_anchor))


def change_kind(status: Column) -> Column:
    first = F.substring(status, 1, 1)
    return F.when(first == "A", "added").when(first == "D", "deleted").when(first == "R", "renamed").otherwise("modified")


def in_scope(path: Column, scope: str, boundary: bool = False) -> Column:
    if scope in ("", ".", "*"):
        return F.lit(True)
    return (path == scope) | F.startswith(path, F.lit(scope + "/")) if boundary else F.startswith(path, F.lit(scope))


def change_touches(path: Column, previous: Column, names: Column) -> Column:
    """Whether a change (path, previous path) touches an anchor with these names; what verdicts() asks by joins."""
    return F.array_contains(names, path) | F.coalesce(F.array_contains(names, previous), F.lit(False))


def possibly_stale(as_of: Column, changed: Column) -> Column:
    return F.coalesce(changed > as_of, F.lit(False))


def suspect_reason(kind: Column, path: Column, previous: Column, sha: Column, n: Column) -> Column:
    name = F.when((kind == "renamed") & previous.isNotNull(), F.concat(previous, F.lit(" -> "), path)).otherwise(path)
    at = F.when(sha.isNotNull(), F.concat(F.lit(" in "), F.substring(sha, 1, 8))).otherwise(F.lit(""))
    more = F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.concat(kind, F.lit(" "), name, at, more)


def unquote_git_path(raw: str) -> str:
    """Undo git's C-style quoting; octal escapes are bytes of UTF-8."""
    if not (raw.startswith('"') and raw.endswith('"') and len(raw) > 1):
        return raw
    single = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
    out, body, i = bytearray(), raw[1:-1], 0
    while i < len(body):
        if body[i] != "\\" or i + 1 == len(body):
            out += body[i].encode()
            i += 1
        elif body[i + 1] in "01234567":
            digits = body[i + 1 : i + 4]
            out.append(int(digits, 8) & 255)
            i += 1 + len(digits)
        else:
            out += bytes([single[body[i + 1]]]) if body[i + 1] in single else body[i + 1].encode()
            i += 2
    return out.decode("utf-8", "replace")
