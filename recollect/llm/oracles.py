"""SQL for the contracts' queries that SQL can express, over the tables as they are; DuckDB's dialect."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


def crc32(x: str) -> str:
    """Unsigned CRC-32 of a value's decimal text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(h, c), [CAST(b AS BIGINT) FOR b IN range(8)]), lambda g, b: xor(g >> 1, 3988292384 * (g & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: {byte}), 4294967295)"


def near_duplicates(k: int = 4) -> str:
    """Shingles of k words, all pairs that share one, and the reachable ids by recursion."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END)) AS x FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""


def chat_digest() -> str:
    """The template escapes a turn whose text or role would be read otherwise: each of four characters by two."""
    said = "\\### Assistant: </turn> ok"
    count = lambda x, c: f"(length({x}) - length(replace({x}, '{c}', '')))"
    codes = " + ".join(count("x.text", c) + " + " + count("x.role", c) for c in "\\#<:")
    unlike = "contains(x.text, '###') OR contains(x.text, '</turn>') OR regexp_matches(x.text, '\\\\[shlc]') OR contains(x.role, ':') OR contains(x.role, '#') OR contains(x.role, '<') OR contains(x.role, '\\')"
    return f"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(14 + length(role) + length(text) + CASE WHEN {unlike} THEN {codes} ELSE 0 END) AS BIGINT) AS formatted_chars FROM x GROUP BY 1"""


def url_verdicts(rules: list[tuple[str, str, str]], labels: list[str]) -> str:
    """Rules by length, else whether the canonical URL is one of those that the listed labels' pages have."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') END AS canon FROM h), bad AS (SELECT DISTINCT canon FROM c WHERE len(list_intersect(string_split(host, '.'), [{listed}])) > 0 AND canon IS NOT NULL)
 SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN canon IN (SELECT canon FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM c"""


def merkle(levels: int = 6) -> str:
    """The trees level by level, as many as fanout^levels leaves a language need; a level over one node is no level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"

    def tree(p: str, key: str, source: str, top: int) -> str:
        out = [f"{p}0 AS ({source})"]
        for n in range(top):
            out.append(f"{p}{n + 1} AS (SELECT {key}, i // 8 AS i, (any_value(c) + 7) // 8 AS c, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {p}{n} GROUP BY {key}, i // 8)")
        for n in range(top):
            side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN {rows}), '')"
            out.append(f"{p}s{n} AS (SELECT {key}, i, c, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after FROM {p}{n})")
        return ", ".join(out)

    langs = tree("a", "k", "SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS c, leaf AS h, doc_id FROM d", levels)
    tops = tree("b", "g", f"SELECT 0 AS g, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS c, h, k FROM a{levels}", 3)
    steps = [("a", n, "x.k = s.k", f"x.i // {8**n}") for n in range(levels)] + [("b", n, "true", f"x.j // {8**n}") for n in range(3)]
    folds, last = [], "f"
    for p, n, same, place in steps:
        folds.append(f"{last}_ AS (SELECT x.* EXCLUDE (d, proof), CASE WHEN s.c > 1 THEN sha256(s.before || x.d || s.after) ELSE x.d END AS d, CASE WHEN s.c > 1 THEN x.proof || s.before || s.after ELSE x.proof END AS proof FROM {last} x JOIN {p}s{n} s ON {same} AND s.i = {place})")
        last += "_"
    found = f"CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {leaf(lower('text'))} ELSE {leaf('text')} END"
    return f"""WITH d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {leaf('text')} AS leaf, {found} AS found FROM documents), {langs}, {tops},
 f AS (SELECT a.k, a.i, b.i AS j, a.doc_id, a.h AS leaf, b.h AS subroot, d.found AS d, '' AS proof FROM a0 a JOIN d ON d.doc_id = a.doc_id AND d.leaf = a.h JOIN b0 b ON b.k = a.k), {', '.join(folds)}
 SELECT doc_id, leaf, subroot, b3.h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = b3.h AS verified FROM {last}, b3"""


def hard_negatives() -> str:
    """All scores of the anchors, ranked."""
    return """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""


def license_phrases(phrases: dict[str, str], word: str) -> str:
    """Places where a phrase's words stand one after the other."""
    cut = word.replace("'", "''")
    at = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: {' AND '.join(f'w[i + {j + 1}] = {chr(39)}{x}{chr(39)}' for j, x in enumerate(p.split()))})) AS start, '{label}' AS label FROM t" for p, label in phrases.items())
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{cut}') AS w FROM documents), p AS ({at})
 SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(p.start) AS n_base, min(p.start) AS first_word, max(p.start) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM t LEFT JOIN p USING (doc_id) GROUP BY t.doc_id, w"""
