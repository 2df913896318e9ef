"""Registered queries: the engine's operators over the driver's tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import anchors as A, constants as C, stemming as ST, text as T, vectors as V
from ..operators import context as CX, evals as E, fulltext as FT, history as H, lifecycle as L, retrieval as R, store as S, tiers as TI
from ..sources.scratch import Scratch
from ..streaming import events as EV_

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- memories from documents: every derived column is a function of the key ---

def memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return t(spark, d, "documents").select(
        i.alias("id"), F.concat_ws(" ", "lang", "source").alias("task"), "text", (i * 60).alias("ts"), (i % 37 == 0).alias("cold"),
        F.when((i % 10).isin(1, 2), i + 1).alias("superseded_by"), (i % 7 == 0).alias("suspect"),
        F.when(i % 7 == 0, F.concat(F.lit("modified src/"), "source", F.lit(" in "), F.substring(F.md5(i.cast("string")), 1, 8))).alias("suspect_reason"),
        F.element_at(F.array(*map(F.lit, C.TIERS)), (i % 3 + 1).cast("int")).alias("tier"), F.length("text").alias("body_length"), (i % 4 == 0).alias("anchored"),
    )


MEM = """mem AS (SELECT doc_id AS id, concat_ws(' ', lang, source) AS task, text, doc_id * 60 AS ts, doc_id % 37 = 0 AS cold,
 CASE WHEN doc_id % 10 IN (1, 2) THEN doc_id + 1 END AS superseded_by, doc_id % 7 = 0 AS suspect,
 CASE WHEN doc_id % 7 = 0 THEN 'modified src/' || source || ' in ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) END AS suspect_reason,
 CASE doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS tier, length(text) AS body_length, doc_id % 4 = 0 AS anchored FROM documents)"""
VISIBLE = "NOT cold AND superseded_by IS NULL"


@query(f"WITH {MEM} SELECT id, task, ts FROM mem WHERE {VISIBLE}")
def visibility(spark, d):
    return memories(spark, d).where(R.visible(F.col("cold"), F.col("superseded_by"))).select("id", "task", "ts")


@query(f"WITH {MEM} SELECT id, ts FROM mem WHERE task = 'en src0' AND {VISIBLE}")
def by_task(spark, d):
    found = memories(spark, d).where((F.col("task") == "en src0") & R.visible(F.col("cold"), F.col("superseded_by")))
    return found.orderBy(F.desc("ts"), "id").select("id", "ts")


@query(f"WITH {MEM} SELECT id, ts FROM mem WHERE suspect AND superseded_by IS NULL ORDER BY ts, id LIMIT 10")
def worklist_oldest(spark, d):
    return memories(spark, d).where("suspect and superseded_by is null").orderBy("ts", "id").limit(10).select("id", "ts")


@query(f"WITH {MEM} SELECT id, substr(task, 1, 60) || ' :: ' || suspect_reason AS example FROM mem WHERE suspect AND superseded_by IS NULL ORDER BY ts DESC, id LIMIT 10")
def stale_examples(spark, d):
    return memories(spark, d).where("suspect and superseded_by is null").orderBy(F.desc("ts"), "id").limit(10).select("id", F.concat(F.substring("task", 1, 60), F.lit(" :: "), "suspect_reason").alias("example"))


@query(f"WITH {MEM} SELECT count(*) AS total, count(*) FILTER (suspect AND superseded_by IS NULL) AS suspect_heads, count(superseded_by) AS superseded, count(*) FILTER (cold) AS cold_rows, count(*) FILTER (tier = 'short') AS short, count(*) FILTER (tier = 'mid') AS mid, count(*) FILTER (tier = 'long') AS long, (SELECT string_agg(substr(task || ' ' || id, 1, 90), '|' ORDER BY ts DESC, id) FROM (SELECT * FROM mem ORDER BY ts DESC, id LIMIT 5)) AS newest FROM mem")
def stats(spark, d):
    m = memories(spark, d)
    line = F.substring(F.concat("task", F.lit(" "), F.col("id").cast("string")), 1, 90).alias("line")
    newest = S.latest_first(m, 5).agg(F.sort_array(F.collect_list(F.struct("ts", line)), asc=False).alias("ls")).select(F.array_join(F.transform("ls", lambda x: x.line), "|").alias("newest"))
    counts = m.agg(F.count("*").alias("total"), F.count_if(F.expr("suspect and superseded_by is null")).alias("suspect_heads"), F.count("superseded_by").alias("superseded"), F.count_if("cold").alias("cold_rows"), *(F.count_if(F.col("tier") == x).alias(x) for x in C.TIERS))
    return counts.crossJoin(newest)  # one row beside one


@query(f"WITH {MEM} SELECT id, task FROM mem ORDER BY ts DESC, id LIMIT 5")
def newest_memories(spark, d):
    return S.latest_first(memories(spark, d), 5).select("id", "task")


@query(f"WITH {MEM} SELECT v.tier, count(mem.id) AS n FROM (VALUES ('short'), ('mid'), ('long')) v(tier) LEFT JOIN mem ON mem.tier = v.tier GROUP BY 1")
def tier_histogram(spark, d):
    return TI.histogram(memories(spark, d))


@query(f"WITH {MEM} SELECT count(*) FILTER (suspect) AS flagged, count(*) AS heads, count(*) FILTER (suspect) * 2 <= count(*) AND count(*) FILTER (suspect) > 0 AS banner FROM mem WHERE superseded_by IS NULL")
def base_rate(spark, d):
    return memories(spark, d).where("superseded_by is null").agg(F.count_if("suspect").alias("flagged"), F.count("*").alias("heads")).withColumn("banner", F.expr("flagged > 0 and flagged * 2 <= heads"))


@query(f"WITH {MEM} SELECT id FROM mem WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = mem.id) ORDER BY ts, id LIMIT 1000")
def missing_embedding(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return memories(spark, d).join(e, "id", "left_anti").orderBy("ts", "id").limit(1000).select("id")


@query(f"WITH {MEM} SELECT id FROM mem WHERE superseded_by IS NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = mem.id) ORDER BY ts, id LIMIT 200")
def missing_digest(spark, d):
    """Labels stand for the digest log: what is labelled is digested."""
    digests = t(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return memories(spark, d).where("superseded_by is null").join(digests, "id", "left_anti").orderBy("ts", "id").limit(200).select("id")


@query("WITH a AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'commit ' WHEN 'O' THEN 'Commit ' ELSE 'scout-report ' END || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS action FROM orders) SELECT DISTINCT action FROM a WHERE starts_with(lower(action), 'commit ')")
def recorded_actions(spark, d):
    """Actions that a prefix names in any case: of commits, not of reports."""
    sha = F.md5(F.col("o_orderkey").cast("string"))
    action = F.when(F.col("o_orderstatus") == "F", T.commit_action(sha)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("Commit "), F.substring(sha, 1, 8))).otherwise(T.scout_action(F.substring(sha, 1, 8)))
    return S.actions_with(t(spark, d, "orders").select(action.alias("action")), "commit ")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500")
def events_since(spark, d):
    return t(spark, d, "events").where("event_id > 500").orderBy("event_id").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def keyset_page(spark, d):
    """One page after a key. Spark needs no pages; a test holds all of them against one scan."""
    return S.page_after(t(spark, d, "events"), "event_id", 500, 100).select("event_id", "event_type")


# --- text ---

BODY = "list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)^(co-authored-by|signed-off-by|-{3,}|\\*\\s*$)'))"


@query(f"SELECT doc_id AS id FROM documents WHERE length(trim(array_to_string({BODY}, chr(10)))) >= 200 AND regexp_matches(lang || ' ' || trim(array_to_string({BODY}, chr(10))), '(?i)\\b(license|token|password)\\b')")
def explanatory_filter(spark, d):
    return t(spark, d, "documents").where(T.is_explanatory(F.col("lang"), F.col("text"), vocabulary=r"(?i)\b(license|token|password)\b")).select(F.col("doc_id").alias("id"))


SUBJECT = "CASE doc_id % 5 WHEN 0 THEN 'fix the loader' WHEN 1 THEN 'Decided on ' || source WHEN 2 THEN 'prefix debugging' WHEN 3 THEN 'a trade-off' ELSE source END"
VOCABULARY = T.EXPLAINING.replace("'", "''")


@query(f"SELECT doc_id AS id FROM documents WHERE length(trim(array_to_string({BODY}, chr(10)))) >= 200 AND regexp_matches({SUBJECT} || ' ' || trim(array_to_string({BODY}, chr(10))), '{VOCABULARY}')")
def explanatory_default(spark, d):
    """The engine's own vocabulary, over subjects that hold it, hold it within other words, or don't."""
    i = F.col("doc_id") % 5
    subject = F.when(i == 0, "fix the loader").when(i == 1, F.concat(F.lit("Decided on "), "source")).when(i == 2, "prefix debugging").when(i == 3, "a trade-off").otherwise(F.col("source"))
    return t(spark, d, "documents").where(T.is_explanatory(subject, F.col("text"))).select(F.col("doc_id").alias("id"))


PROSE = r"len(list_filter(regexp_split_to_array(regexp_replace({}, '(^|\s)[-*•\d.)]+\s|[\w@./-]*/[\w@./-]+|[\w-]+\.[a-z]{{1,5}}\b|[A-Za-z_$][\w$]*(?:[.#][\w$]+)+', ' ', 'g'), '[^A-Za-z'']+'), lambda w: length(w) > 1))"


@query(f"SELECT conv_id, turn, CAST({PROSE.format('text')} AS INTEGER) AS words FROM conversations")
def prose_words(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.prose_words(F.col("text")).alias("words"))


@query(f"SELECT CASE WHEN length(trim(text)) < 200 THEN 'too_short' WHEN {PROSE.format('trim(text)')} < 25 THEN 'bare_locations' ELSE 'accepted' END AS verdict, count(*) AS n FROM conversations GROUP BY 1")
def guardrail_reject(spark, d):
    return t(spark, d, "conversations").select(F.coalesce(T.reject_reason(F.col("text")), F.lit("accepted")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^(.+)#([A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*)$') THEN regexp_extract(url, '^(.+)#([A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*)$', 1) ELSE url END AS path, nullif(regexp_extract(url, '^(.+)#([A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*)$', 2), '') AS symbol FROM pages")
def anchor_parse(spark, d):
    return t(spark, d, "pages").select("page_id", A.parse_anchor(F.col("url")).alias("a")).select("page_id", "a.path", "a.symbol")


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all('fix #' || page_id || ' and ' || url || ' #' || (page_id % 5), '#(\\d{1,6})\\b', 1))), ',') AS refs FROM pages")
def issue_refs(spark, d):
    text = F.concat(F.lit("fix #"), F.col("page_id").cast("string"), F.lit(" and "), "url", F.lit(" #"), (F.col("page_id") % 5).cast("string"))
    return t(spark, d, "pages").select("page_id", F.array_join(F.array_sort(T.issue_refs(text)), ",").alias("refs"))


@query("SELECT CASE substr(l_returnflag, 1, 1) WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def commit_kind(spark, d):
    return t(spark, d, "lineitem").groupBy(A.change_kind(F.col("l_returnflag")).alias("kind")).agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)
QTOKENS = "list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains([" + STOP + "], x))"


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({QTOKENS.format('text')})), ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


ITOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
TRI = f"flatten(list_transform({ITOKENS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3))))"


@query(f"SELECT p_partkey, array_to_string({TRI.format('p_name')}, '|') AS sequence, len(list_distinct({TRI.format('p_name')})) AS n_set FROM part")
def trigram_sequences(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(T.trigram_sequence(F.col("p_name")), "|").alias("sequence"), F.size(T.trigram_set(F.col("p_name"))).cast("long").alias("n_set"))


# --- retrieval ---

def questions(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


BM25 = f"""docs AS (SELECT doc_id AS id, {ITOKENS.format('text')} AS ts FROM documents), whole AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM docs),
 terms AS (SELECT DISTINCT item_id AS qid, unnest({QTOKENS.format('text')}) AS term FROM benchmark),
 post AS (SELECT id, len(ts) AS l, unnest(ts) AS term FROM docs), tf AS (SELECT term, id, l, count(*) AS f FROM post WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 part AS (SELECT term, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av)) AS p FROM tf JOIN df USING (term), whole),
 bm AS (SELECT qid, id, sum(p) AS score FROM terms JOIN part USING (term) GROUP BY 1, 2)"""


@query(f"WITH {BM25} SELECT qid, count(*) AS hits, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY 1")
def bm25_batch(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.bm25(questions(spark, d), docs, stemmed=False).groupBy("qid").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


def _round_rank(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Ranks over rounded scores, so that sums in another order rank alike."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"WITH {BM25}, {MEM}, r AS (SELECT qid, bm.id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, ts DESC, bm.id) AS rank FROM bm JOIN mem ON mem.id = bm.id WHERE {VISIBLE}) SELECT qid, id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    m = memories(spark, d).withColumn("visible", R.visible(F.col("cold"), F.col("superseded_by")))
    hits = R.bm25(questions(spark, d), m.select("id", "text", "visible"), stemmed=False, limit=10).join(m.where("visible").select("id", "ts"), "id")
    return _round_rank(hits, [F.desc("ts"), "id"], 10).select("qid", "id", "score", "rank")


def _phrases(cut: str, question: str) -> str:
    """BM25 where a term may be a phrase: cut is SQL for the index's tokens of {}, question SQL for the questions (qid, question)."""
    return f"""docs AS (SELECT doc_id AS id, {cut.format('text')} AS ts FROM documents), whole AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM docs), qs AS ({question}),
 cutq AS (SELECT DISTINCT qid, {cut.format('term')} AS parts FROM (SELECT qid, unnest({QTOKENS.format('question')}) AS term FROM qs)),
 terms AS (SELECT DISTINCT qid, array_to_string(parts, ' ') AS term, parts FROM cutq WHERE len(parts) > 0),
 ph AS (SELECT DISTINCT term, unnest(parts) AS part, unnest(range(0, len(parts))) AS nth, len(parts) AS width FROM terms),
 post AS (SELECT id, len(ts) AS l, unnest(ts) AS part, unnest(range(0, len(ts))) AS pos FROM docs),
 st AS (SELECT term, id, l, width, pos - nth AS start FROM post JOIN ph USING (part) GROUP BY ALL HAVING count(*) = width),
 tf AS (SELECT term, id, l, count(*) AS f FROM st GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 part AS (SELECT term, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av)) AS p FROM tf JOIN df USING (term), whole),
 bm AS (SELECT qid, id, sum(p) AS score FROM (SELECT DISTINCT qid, term FROM terms) JOIN part USING (term) GROUP BY 1, 2)"""


TOP = "r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT qid, id, score, rank FROM r WHERE rank <= 10"
ASCII_WORDS = "list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda x: length(x) > 2)"
SNAKE = f"SELECT item_id AS qid, w[2] || '_' || w[3] || ' ' || w[5] || '_' || w[6] || '_' || w[7] || ' ' || w[9] AS question FROM (SELECT item_id, {ASCII_WORDS} AS w FROM benchmark) WHERE len(w) >= 9"


@query(f"WITH {_phrases(ITOKENS, SNAKE)}, {TOP}")
def bm25_phrase(spark, d):
    """Questions of snake_case terms, made of words that stand side by side in the benchmark's texts."""
    w = F.filter(F.split("text", "[^a-zA-Z]+"), lambda x: F.length(x) > 2)
    pick = lambda *ns: F.concat_ws("_", *(F.element_at("w", n) for n in ns))
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), w.alias("w")).where(F.size("w") >= 9).select("qid", F.concat_ws(" ", pick(2, 3), pick(5, 6, 7), pick(9)).alias("question"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _round_rank(R.bm25(q, docs, stemmed=False, limit=10), ["id"], 10).select("qid", "id", "score", "rank")


def _porter(words: str) -> str:
    """SQL of the Porter stemmer: CTEs that end in stems (w, stem), over the distinct words that the query `words` (w) gives."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some, more, one, vowel = f"'^({c})?{v}{c}'", f"'^({c})?{v}{c}{v}{c}'", f"'^({c})?{v}{c}({v})?$'", f"'^({c})?[aeiouy]'"
    cvc = f"regexp_matches({{0}}, '^{c}[aeiouy][^aeiouwxy]$')"
    less = lambda n: f"left(x, length(x) - {n})"

    def replaced(rules: str) -> str:
        pairs = sorted((r.split(":") for r in rules.split(" ")), key=lambda r: -len(r[0]))
        return "CASE " + " ".join(f"WHEN ends_with(x, '{a}') THEN CASE WHEN regexp_matches({less(len(a))}, {some}) THEN {less(len(a))} || '{b}' ELSE x END" for a, b in pairs) + " ELSE x END"

    cut4 = "CASE " + " ".join(f"WHEN ends_with(x, '{a}') THEN CASE WHEN regexp_matches({less(len(a))}, {more}){' AND regexp_matches(' + less(3) + chr(44) + chr(39) + '[st]$' + chr(39) + ')' if a == 'ion' else ''} THEN {less(len(a))} ELSE x END" for a in sorted(ST.STEP4.split(" "), key=len, reverse=True)) + " ELSE x END"
    return f"""v0 AS ({words}), v1 AS (SELECT w, w AS x FROM v0 WHERE length(w) > 2 AND regexp_matches(w, '^[\\x00-\\x7F]*$')),
 a1 AS (SELECT w, CASE WHEN ends_with(x, 'sses') OR ends_with(x, 'ies') THEN {less(2)} WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN {less(1)} ELSE x END AS x FROM v1),
 b1 AS (SELECT w, CASE WHEN ends_with(x, 'eed') THEN CASE WHEN regexp_matches({less(3)}, {some}) THEN {less(1)} ELSE x END WHEN ends_with(x, 'ed') AND regexp_matches({less(2)}, {vowel}) THEN {less(2)} WHEN ends_with(x, 'ing') AND regexp_matches({less(3)}, {vowel}) THEN {less(3)} ELSE x END AS x,
  NOT ends_with(x, 'eed') AND ((ends_with(x, 'ed') AND regexp_matches({less(2)}, {vowel})) OR (ends_with(x, 'ing') AND regexp_matches({less(3)}, {vowel}))) AS fresh FROM a1),
 b2 AS (SELECT w, CASE WHEN NOT fresh THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN right(x, 1) = right({less(1)}, 1) AND regexp_matches(x, '[^aeiouylsz]$') THEN {less(1)} WHEN regexp_matches(x, {one}) AND {cvc.format('x')} THEN x || 'e' ELSE x END AS x FROM b1),
 c1 AS (SELECT w, CASE WHEN ends_with(x, 'y') AND regexp_matches({less(1)}, {vowel}) THEN {less(1)} || 'i' ELSE x END AS x FROM b2),
 d1 AS (SELECT w, {replaced(ST.STEP2)} AS x FROM c1), e1 AS (SELECT w, {replaced(ST.STEP3)} AS x FROM d1), f1 AS (SELECT w, {cut4} AS x FROM e1),
 g1 AS (SELECT w, CASE WHEN ends_with(x, 'e') AND (regexp_matches({less(1)}, {more}) OR (regexp_matches({less(1)}, {one}) AND NOT {cvc.format(less(1))})) THEN {less(1)} ELSE x END AS x FROM f1),
 h1 AS (SELECT w, CASE WHEN ends_with(x, 'll') AND regexp_matches(x, {more}) THEN {less(1)} ELSE x END AS x FROM g1),
 stems AS (SELECT w, x AS stem FROM h1 UNION ALL SELECT w, w FROM v0 WHERE w NOT IN (SELECT w FROM v1))"""


FOLDED = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
STEMMED = f"""dw AS (SELECT doc_id AS id, {FOLDED.format('text')} AS ts FROM documents), qw AS (SELECT DISTINCT item_id AS qid, unnest({FOLDED.format("array_to_string(" + QTOKENS.format('text') + ", ' ')")}) AS w FROM benchmark),
 {_porter("SELECT DISTINCT w FROM (SELECT unnest(ts) AS w FROM dw UNION ALL SELECT w FROM qw)")}, whole AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM dw), terms AS (SELECT DISTINCT qid, stem AS term FROM qw JOIN stems USING (w)),
 tf AS (SELECT stem AS term, id, l, count(*) AS f FROM (SELECT id, len(ts) AS l, unnest(ts) AS w FROM dw) JOIN stems USING (w) WHERE stem IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 part AS (SELECT term, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av)) AS p FROM tf JOIN df USING (term), whole),
 bm AS (SELECT qid, id, sum(p) AS score FROM terms JOIN part USING (term) GROUP BY 1, 2)"""


@query(f"WITH {STEMMED}, {TOP}")
def bm25_stemmed(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _round_rank(R.bm25(questions(spark, d), docs, limit=10), ["id"], 10).select("qid", "id", "score", "rank")


def kept_index(spark, d) -> FT.TextIndex:
    """An index of all documents, filled in two batches of which the second outdoes half of the first."""
    index = FT.TextIndex(spark, f"{Scratch(spark, 'index').root}/text")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index.add(docs.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 2 == 0, F.lit("an older text")).otherwise(F.col("text"))))
    index.add(docs.where("id % 3 = 0 or id % 2 = 0"))
    return index


@query(f"WITH {STEMMED}, {TOP}")
def index_search(spark, d):
    """As bm25_stemmed, from a kept index: once it is filled, questions read no text."""
    return _round_rank(kept_index(spark, d).search(questions(spark, d), limit=10), ["id"], 10).select("qid", "id", "score", "rank")


def parts(spark, d):
    """Part descriptions as memories, the names of parts as questions; both with vectors where their number has one."""
    p = t(spark, d, "part")
    vec = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    i = F.col("p_partkey")
    m = p.select(
        i.alias("id"), F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type")).alias("text"), (i % 7 * 86_400 + i).alias("ts"), F.element_at(F.array(*map(F.lit, C.TIERS)), (i % 3 + 1).cast("int")).alias("tier"),
        (i * 3).alias("body_length"), (i % 4 == 0).alias("anchored"), (i % 11 != 0).alias("visible"),
    )
    q = p.groupBy(F.concat(F.lit("which "), F.col("p_name")).alias("question")).agg(F.min("p_partkey").alias("id"))
    return m.join(vec, "id", "left"), q.join(vec, "id", "left").withColumnRenamed("id", "qid")


PARTS = """pt AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || lower(p_type) AS text, p_partkey % 7 * 86400 + p_partkey AS ts, CASE p_partkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS tier, p_partkey * 3 AS body_length, p_partkey % 4 = 0 AS anchored, p_partkey % 11 <> 0 AS visible FROM part),
 pq AS (SELECT 'which ' || p_name AS question, min(p_partkey) AS qid FROM part GROUP BY 1)"""
SIM = f"""{PARTS}, seqs AS (SELECT text, {TRI.format('text')} AS s FROM (SELECT DISTINCT text FROM pt)), q3s AS (SELECT qid, list_distinct({TRI.format('question')}) AS q3 FROM pq),
 cand AS (SELECT qid, q3, text, s FROM q3s, seqs WHERE len(list_intersect(q3, s)) >= 0.35 * len(q3)),
 b AS (SELECT qid, q3, text, s, unnest(range(1, len(s) + 1)) AS i FROM cand), ext AS (SELECT qid, q3, text, s[i:j] AS e FROM (SELECT qid, q3, text, s, i, unnest(range(i, len(s) + 1)) AS j FROM b)),
 sims AS (SELECT qid, text, max(len(list_intersect(q3, e)) / len(list_distinct(list_concat(q3, e)))) AS score FROM ext GROUP BY 1, 2), sim AS (SELECT qid, id, score FROM sims JOIN pt USING (text) WHERE score >= 0.35)"""


@query(f"WITH {SIM} SELECT qid, count(*) AS hits, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM sim GROUP BY 1")
def trigram_threshold(spark, d):
    m, q = parts(spark, d)
    return R.trigram_leg(q, m).groupBy("qid").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {SIM}, r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM sim) SELECT * FROM r WHERE rank <= 5")
def trigram_topk(spark, d):
    m, q = parts(spark, d)
    return _round_rank(R.trigram_leg(q, m), ["id"], 5).select("qid", "id", "score", "rank")


@query()
def trigram_documents(spark, d):
    """Questions against whole documents; SQL would enumerate every extent of every text, so tests hold it against brute force."""
    m = memories(spark, d).withColumn("visible", R.visible(F.col("cold"), F.col("superseded_by")))
    return R.rank_leg(R.trigram_leg(questions(spark, d), m.where("visible").select("id", "text"), limit=5), m, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


THREE = f"""{SIM}, pd AS (SELECT id, {ITOKENS.format('text')} AS ts FROM pt), whole AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM pd), terms AS (SELECT DISTINCT qid, unnest({QTOKENS.format('question')}) AS term FROM pq),
 tf AS (SELECT term, id, l, count(*) AS f FROM (SELECT id, len(ts) AS l, unnest(ts) AS term FROM pd) WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 bm AS (SELECT qid, id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av))) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), whole GROUP BY 1, 2),
 cs AS (SELECT qid, pt.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS score FROM pq JOIN embeddings q ON q.vec_id = qid, pt JOIN embeddings m ON m.vec_id = pt.id),
 hits AS (SELECT 'text' AS leg, 1.0 AS weight, * FROM bm UNION ALL SELECT 'trigram', 0.5, * FROM sim UNION ALL SELECT 'vector', 0.5, * FROM cs),
 ranked AS (SELECT leg, weight, qid, h.id, score, row_number() OVER (PARTITION BY leg, qid ORDER BY round(score, 9) DESC, ts DESC, h.id) AS rank FROM hits h JOIN pt ON pt.id = h.id WHERE visible),
 shut AS (SELECT qid FROM (SELECT qid, max(score) AS best FROM ranked WHERE leg = 'vector' GROUP BY 1) WHERE best < 0.97),
 fused AS (SELECT qid, id, CAST(sum(weight / (60 + rank)) AS DOUBLE) AS content, list_sort(list(DISTINCT leg)) AS ls FROM ranked WHERE rank <= 20 AND qid NOT IN (SELECT qid FROM shut) GROUP BY 1, 2),
 scored AS (SELECT qid, id, ts, ls, anchored, content, content * CASE tier WHEN 'short' THEN 1.0 WHEN 'mid' THEN 1.1 ELSE 1.25 END * CASE WHEN body_length > 2000 THEN 1 / (1 + ln(body_length / 2000.0)) ELSE 1.0 END AS score FROM fused JOIN pt USING (id)),
 answers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ts DESC, id) AS rank FROM scored) WHERE rank <= 5)"""
REASON = "CASE WHEN len(ls) > 1 THEN 'hybrid_match' WHEN ls[1] = 'text' THEN 'text_match' WHEN ls[1] = 'trigram' THEN 'lexical_match' ELSE 'semantic_match' END"


def answered_parts(spark, d):
    """All three legs, the gate and the fusion. Vectors count where the question's part is not answered by itself alone."""
    m, q = parts(spark, d)
    return R.by_meaning(q, m, stemmed=False, min_vector_score=0.97)


@query(f"WITH {THREE} SELECT qid, id, rank, round(score, 9) AS score, {REASON} AS reason, anchored FROM answers")
def by_meaning_three_legs(spark, d):
    return answered_parts(spark, d).select("qid", "id", "rank", F.round("score", 9).alias("score"), "reason", "anchored")


@query(f"WITH {THREE} SELECT id, 's' || qid % 5 AS session, count(*) AS hits FROM answers WHERE qid % 5 <> 0 GROUP BY ALL")
def write_on_read(spark, d):
    """The accesses that answering records: of what was returned, for questions asked in a named session."""
    a = answered_parts(spark, d).select("qid", "id")
    asked = a.select("qid").distinct().select("qid", F.when(F.col("qid") % 5 != 0, F.concat(F.lit("s"), (F.col("qid") % 5).cast("string"))).alias("session"))
    return TI.accesses(CX.read_accesses(a, asked, F.lit(0))).select("id", "session", "hits")


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


COS = "cos AS (SELECT b.item_id AS qid, m.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings m)"


def question_vectors(spark, d):
    return questions(spark, d).join(vectors(spark, d).withColumnRenamed("id", "qid"), "qid")


@query(f"WITH {COS} SELECT qid, count(*) AS n, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM cos GROUP BY 1")
def cosine_batch(spark, d):
    """The best and the worst of all: the worst is the best of the opposite question, so that neither gives all pairs."""
    q, m = question_vectors(spark, d), vectors(spark, d)
    opposite = q.withColumn("vec", F.transform("vec", lambda x: -x))
    best, worst = (R.vector_leg(x, m, 1).groupBy("qid").agg(F.round(F.max("score"), 6).alias("s")) for x in (q, opposite))
    n = m.where("vec is not null").agg(F.count("*").alias("n"))
    return best.withColumnRenamed("s", "best").join(worst.select("qid", (-F.col("s")).alias("worst")), "qid").crossJoin(n).select("qid", "n", "best", "worst")  # one row of counts


@query(f"WITH {COS}, r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM cos) SELECT * FROM r WHERE rank <= 10")
def cosine_topk(spark, d):
    return _round_rank(R.vector_leg(question_vectors(spark, d), vectors(spark, d), 10), ["id"], 10).select("qid", "id", "score", "rank")


LEGS = f"""{BM25}, {COS}, {MEM},
 lt AS (SELECT qid, bm.id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, ts DESC, bm.id) AS rank FROM bm JOIN mem ON mem.id = bm.id WHERE {VISIBLE}),
 lv AS (SELECT qid, cos.id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, ts DESC, cos.id) AS rank FROM cos JOIN mem ON mem.id = cos.id WHERE {VISIBLE}),
 legs AS (SELECT qid, id, 'text' AS leg, 1.0 / (60 + rank) AS p FROM lt WHERE rank <= 20 UNION ALL SELECT qid, id, 'vector', 0.5 / (60 + rank) FROM lv WHERE rank <= 20),
 fused AS (SELECT qid, id, CAST(sum(p) AS DOUBLE) AS content, list_sort(list(DISTINCT leg)) AS ls FROM legs GROUP BY 1, 2),
 scored AS (SELECT qid, f.id, ts, content, ls, anchored, content * CASE tier WHEN 'short' THEN 1.0 WHEN 'mid' THEN 1.1 ELSE 1.25 END * CASE WHEN body_length > 2000 THEN 1 / (1 + ln(body_length / 2000.0)) ELSE 1.0 END AS score FROM fused f JOIN mem ON mem.id = f.id)"""


def legs(spark, d):
    m = memories(spark, d).withColumn("visible", R.visible(F.col("cold"), F.col("superseded_by")))
    rounded = lambda df: df.withColumn("score", F.round("score", 6))
    text = R.rank_leg(rounded(R.bm25(questions(spark, d), m.select("id", "text", "visible"), stemmed=False, limit=20)), m)
    vector = R.rank_leg(rounded(R.vector_leg(question_vectors(spark, d), vectors(spark, d).join(m.where("visible").select("id"), "id", "left_semi"), 20)), m)
    return m, {"text": text, "vector": vector}


@query(f"WITH {LEGS} SELECT qid, id, round(content, 9) AS content_score, array_to_string(ls, '+') AS legs FROM scored")
def rrf_fuse(spark, d):
    m, ls = legs(spark, d)
    return R.fuse(ls, m, limit=10**9).select("qid", "id", F.round("content_score", 9).alias("content_score"), F.array_join("legs", "+").alias("legs"))


@query(f"WITH {LEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ts DESC, id) AS rank FROM scored) SELECT qid, id, rank, round(score, 9) AS score, CASE WHEN len(ls) > 1 THEN 'hybrid_match' WHEN ls[1] = 'text' THEN 'text_match' ELSE 'semantic_match' END AS reason, anchored FROM r WHERE rank <= 5")
def hybrid_by_meaning(spark, d):
    m, ls = legs(spark, d)
    return R.fuse(ls, m).select("qid", "id", "rank", F.round("score", 9).alias("score"), "reason", "anchored")


@query(f"WITH {MEM} SELECT id, round(CASE tier WHEN 'short' THEN 1.0 WHEN 'mid' THEN 1.1 ELSE 1.25 END * CASE WHEN body_length > 2000 THEN 1 / (1 + ln(body_length / 2000.0)) ELSE 1.0 END, 6) AS factor FROM mem")
def tier_length_boost(spark, d):
    return memories(spark, d).select("id", F.round(V.tier_boost(F.col("tier")) * V.length_prior(F.col("body_length")), 6).alias("factor"))


@query(f"WITH {LEGS} SELECT qid FROM (SELECT qid, max(score) AS best FROM lv WHERE id <> qid GROUP BY 1) WHERE best < 0.6")
def relevance_gate(spark, d):
    _, ls = legs(spark, d)
    m = memories(spark, d).withColumn("visible", R.visible(F.col("cold"), F.col("superseded_by")))
    seen = vectors(spark, d).join(m.where("visible").select("id"), "id", "left_semi")
    hits = R.vector_leg(question_vectors(spark, d), seen, 2).withColumn("score", F.round("score", 6)).where("id <> qid")  # a question's own vector and the best other one
    return R.gate(hits, 0.6)


@query(f"WITH {COS}, best AS (SELECT qid, max(round(score, 6)) AS b FROM cos WHERE id <> qid GROUP BY 1) SELECT CAST(f.f AS DOUBLE) AS floor, count(*) FILTER (b >= f AND qid % 2 = 0) AS answered, count(*) FILTER (b >= f AND qid % 2 = 1) AS leaked FROM best, (VALUES (0.0), (0.2), (0.3), (0.5), (0.7), (0.9)) f(f) GROUP BY 1")
def gate_sweep(spark, d):
    floors = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 0.5, 0.7, 0.9)], "floor double")
    best = R.vector_leg(question_vectors(spark, d), vectors(spark, d), 2).where("id <> qid").groupBy("qid").agg(F.max(F.round("score", 6)).alias("b"))
    return best.crossJoin(floors).groupBy("floor").agg(F.count_if(F.expr("b >= floor and qid % 2 = 0")).alias("answered"), F.count_if(F.expr("b >= floor and qid % 2 = 1")).alias("leaked"))


GOLD = "gold AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {BM25}, {GOLD}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm), f AS (SELECT g.qid, min(rank) AS rank FROM gold g LEFT JOIN r ON r.qid = g.qid AND r.id = g.id AND r.rank <= 10 GROUP BY 1) SELECT count(*) AS questions, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM f")
def mrr_recall(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    q = questions(spark, d)
    gold = E.contained(q, docs)
    ranked = _round_rank(R.bm25(q, docs, stemmed=False, limit=10), ["id"], 10).select("qid", "id", "rank")
    found = gold.join(ranked, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return found.agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query("WITH d AS (SELECT vec_id // 4 AS grp, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT grp, i, avg(CAST(x AS DOUBLE)) AS x FROM d GROUP BY 1, 2), n AS (SELECT grp, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT grp, i AS dim, round(x / n, 6) AS x FROM m JOIN n USING (grp) WHERE n > 0")
def mean_pooling(spark, d):
    chunks = vectors(spark, d).groupBy(F.expr("id div 4").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("cs"))
    return chunks.select("grp", F.posexplode(V.mean_pool(F.transform("cs", lambda c: c.vec))).alias("p", "x")).select("grp", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {COS}, {GOLD}, best AS (SELECT qid, max(round(score, 6)) AS b FROM cos WHERE id <> qid GROUP BY 1), k AS (SELECT *, qid IN (SELECT qid FROM gold) AS on_topic FROM best) SELECT CAST(f.f AS DOUBLE) AS floor, count(*) FILTER (b >= f AND on_topic) AS answered, count(*) FILTER (b >= f AND NOT on_topic) AS leaked FROM k, (VALUES (0.2), (0.4), (0.6), (0.8)) f(f) GROUP BY 1")
def gate_answered_leaked(spark, d):
    floors = spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.6, 0.8)], "floor double")
    docs, q = t(spark, d, "documents"), questions(spark, d)
    gold = E.contained(q, docs.select(F.col("doc_id").alias("id"), "text")).select("qid").distinct().withColumn("gold", F.lit(True))
    best = R.vector_leg(question_vectors(spark, d), vectors(spark, d), 2).where("id <> qid").groupBy("qid").agg(F.max(F.round("score", 6)).alias("b")).join(gold, "qid", "left")
    return best.crossJoin(floors).groupBy("floor").agg(F.count_if(F.expr("b >= floor and gold is not null")).alias("answered"), F.count_if(F.expr("b >= floor and gold is null")).alias("leaked"))


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"WITH tok AS (SELECT item_id, unnest({QTOKENS.format('text')}) AS w FROM benchmark), h AS (SELECT item_id, {FNV.format('w')} AS h FROM tok) SELECT item_id, h % 1536 AS idx, CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM h GROUP BY 1, 2")
def hash_embed_sparse(spark, d):
    tok = t(spark, d, "benchmark").select("item_id", F.explode(T.query_tokens(F.col("text"))).alias("w"))
    return tok.groupBy("item_id", V.hashed_index(F.col("w")).alias("idx")).agg(F.sum(V.hashed_sign(F.col("w"))).alias("weight"))


@query(f"WITH tok AS (SELECT item_id, unnest({QTOKENS.format('text')}) AS w FROM benchmark), h AS (SELECT item_id, {FNV.format('w')} AS h FROM tok), v AS (SELECT item_id, h % 1536 AS idx, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS w FROM h GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM v GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w) / any_value(na.n * nb.n), 6) AS cosine FROM v a JOIN v b ON a.idx = b.idx AND a.item_id < b.item_id JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY 1, 2 HAVING any_value(na.n * nb.n) > 0")
def hash_embed_cosine(spark, d):
    v = hash_embed_sparse(spark, d)
    n = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n")).where("n > 0")
    v = v.join(n, "item_id").withColumn("u", F.col("weight"))
    a, b = (v.select(F.col("item_id").alias(x), "idx", F.col("u").alias(f"u{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    return a.join(b, "idx").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("ua") * F.col("ub")) / F.first(F.col("na") * F.col("nb")), 6).alias("cosine"))


# --- chains, renames, staleness ---

def links(spark, d):
    return memories(spark, d).select("id", "superseded_by")


@query(f"WITH RECURSIVE {MEM}, c(id, cur, depth) AS (SELECT id, id, 0 FROM mem UNION ALL SELECT c.id, m.superseded_by, depth + 1 FROM c JOIN mem m ON m.id = c.cur WHERE m.superseded_by IS NOT NULL) SELECT id, max_by(cur, depth) AS head, CAST(max(depth) AS BIGINT) AS depth FROM c GROUP BY 1")
def supersede_head(spark, d):
    return H.heads(links(spark, d))


def order_links(spark, d):
    """A customer's orders correct each other in turn: chains of a dozen and more."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("superseded_by"), F.col("o_orderdate").alias("ts"), "o_custkey")


OLINKS = "ol AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by, o_custkey FROM orders), busy AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), member AS (SELECT max(id) AS id FROM ol WHERE o_custkey IN (SELECT o_custkey FROM busy))"


@query(f"WITH RECURSIVE {OLINKS}, fwd(id, n) AS (SELECT id, 0 FROM member UNION ALL SELECT ol.superseded_by, n + 1 FROM fwd JOIN ol ON ol.id = fwd.id WHERE ol.superseded_by IS NOT NULL), bck(id, n) AS (SELECT arg_max(id, n), 0 FROM fwd UNION ALL SELECT ol.id, n + 1 FROM bck JOIN ol ON ol.superseded_by = bck.id) SELECT id, CAST((SELECT max(n) FROM bck) - n AS INTEGER) AS depth FROM bck")
def supersede_chain(spark, d):
    """The chain of the busiest customer's orders, from any one of its members."""
    every = order_links(spark, d)
    busy = every.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("id").alias("member")).orderBy(F.desc("n"), "o_custkey").first()
    return H.chain_of(every, busy.member).select("id", "depth")


@query(f"WITH RECURSIVE {OLINKS}, c(id, cur, depth) AS (SELECT id, id, 0 FROM ol UNION ALL SELECT c.id, ol.superseded_by, depth + 1 FROM c JOIN ol ON ol.id = c.cur WHERE ol.superseded_by IS NOT NULL) SELECT id, max_by(cur, depth) AS head, CAST(max(depth) AS BIGINT) AS depth FROM c GROUP BY 1")
def deep_heads(spark, d):
    return H.heads(order_links(spark, d))


@query(f"WITH {MEM}, p AS (SELECT id AS old, id + 1 AS new FROM mem WHERE id % 10 IN (2, 3) UNION ALL SELECT id, id - 1 FROM mem WHERE id % 10 = 3 UNION ALL SELECT id, id FROM mem WHERE id % 10 = 5 UNION ALL SELECT id, -5 FROM mem WHERE id % 10 = 6 UNION ALL SELECT id, id + 5 FROM mem WHERE id % 10 = 1) SELECT old, new, CASE WHEN old = new THEN 'self' WHEN new NOT IN (SELECT id FROM mem) THEN 'unknown' WHEN old % 10 = 2 THEN 'same' WHEN old % 10 = 1 THEN 'fork' WHEN new = old - 1 THEN 'cycle' ELSE 'ok' END AS verdict FROM p")
def cycle_check(spark, d):
    m = links(spark, d)
    case = lambda where, new: m.where(where).select(F.col("id").alias("old"), new.cast("long").alias("new"))
    i = F.col("id")
    p = case("id % 10 in (2, 3)", i + 1).unionAll(case("id % 10 = 3", i - 1)).unionAll(case("id % 10 = 5", i)).unionAll(case("id % 10 = 6", F.lit(-5))).unionAll(case("id % 10 = 1", i + 5))
    return H.would_cycle(m, p)


def touched_parts(spark, d):
    """(p, o, date): the parts that each order touches, once each."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // H.PART))  # both are dealt by order: equal rows meet there, and a task's share doesn't grow
    touched = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).repartition(parts, "o").distinct()
    return touched.join(o.select(F.col("o_orderkey").alias("o"), day.alias("date")).repartition(parts, "o").distinct(), "o")


def changes(spark, d, chain: int = 0, rows: DataFrame | None = None):
    """Commits are orders, touched paths their parts (touched_parts(), or rows as it gave them). Newest first by seq.

    Three parts of every fifty were each renamed to the next, so paths have up to four names; the first `chain` parts
    likewise, in one chain; and three parts around in a ring.
    """
    rows = touched_parts(spark, d) if rows is None else rows
    name = lambda c: F.concat(F.lit("src/p"), c.cast("string"))
    p = F.col("p")
    ring = p.isin(310, 311, 312)
    renamed = (p < chain) | ring | (p % 50 < 3)
    to = F.when(p == 312, F.lit(310)).otherwise(p + 1)
    return rows.select((-F.col("date") * 100_000_000_000 - F.col("o") * 10_000 - F.col("p")).alias("seq"), F.when(renamed, name(to)).otherwise(name(p)).alias("path"), F.when(renamed, name(p)).alias("previous_path"), F.when(renamed, "renamed").otherwise("modified").alias("kind"), F.md5(F.col("o").cast("string")).alias("sha"), "date", "o")


def _chg(chain: int) -> str:
    renamed = f"(l_partkey < {chain} OR l_partkey IN (310, 311, 312) OR l_partkey % 50 < 3)"
    return f"""chg AS (SELECT DISTINCT -(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 100000000000) - l_orderkey * 10000 - l_partkey AS seq, CASE WHEN {renamed} THEN 'src/p' || CASE WHEN l_partkey = 312 THEN 310 ELSE l_partkey + 1 END ELSE 'src/p' || l_partkey END AS path,
 CASE WHEN {renamed} THEN 'src/p' || l_partkey END AS previous_path, CASE WHEN {renamed} THEN 'renamed' ELSE 'modified' END AS kind, md5(CAST(l_orderkey AS VARCHAR)) AS sha, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS date, l_orderkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


CHG = _chg(0)


@query(f"WITH {CHG} SELECT path FROM chg UNION SELECT previous_path FROM chg WHERE previous_path IS NOT NULL")
def changed_path_universe(spark, d):
    return H.changed_paths(changes(spark, d))


@query(f"WITH RECURSIVE {_chg(200)}, rn AS (SELECT previous_path, max_by(path, seq) AS path FROM chg WHERE previous_path IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT path FROM chg UNION SELECT previous_path FROM rn), c(path, name) AS (SELECT path, path FROM p UNION SELECT c.path, rn.path FROM c JOIN rn ON rn.previous_path = c.name) SELECT path, name FROM c")
def rename_closure(spark, d):
    ch = Scratch(spark, "feed").keep(changes(spark, d, chain=200), "changes")
    return H.path_closure(H.changed_paths(ch), H.rename_map(ch))


def order_memories(ch: DataFrame):
    """Every order as a memory anchored on its parts, as of its date."""
    ch = ch.repartition("o")  # an order's rows meet once, for its anchors, its date and what joins them
    anchors = ch.select(F.col("o").alias("id"), F.coalesce("previous_path", "path").alias("path")).distinct()
    m = ch.groupBy(F.col("o").alias("id")).agg(F.max("date").alias("as_of")).withColumn("suspect", F.col("id") % 30 == 0).withColumn("suspect_reason", F.when(F.col("suspect"), "kept from before"))
    return anchors, m


#: The closure is over renames, so the recursion stops at names already seen.
STALE = f"""{CHG}, rn AS (SELECT previous_path, max_by(path, seq) AS path FROM chg WHERE previous_path IS NOT NULL GROUP BY 1),
 anc AS (SELECT DISTINCT o AS id, coalesce(previous_path, path) AS path FROM chg), mm AS (SELECT o AS id, max(date) AS as_of, o % 30 = 0 AS suspect FROM chg GROUP BY 1, 3),
 cl(path, name) AS (SELECT DISTINCT path, path FROM anc UNION SELECT cl.path, rn.path FROM cl JOIN rn ON rn.previous_path = cl.name),
 nm AS MATERIALIZED (SELECT DISTINCT id, name, as_of FROM anc JOIN cl USING (path) JOIN mm USING (id)),
 tc AS MATERIALIZED (SELECT seq, date, path AS name FROM chg UNION SELECT seq, date, previous_path FROM chg WHERE previous_path IS NOT NULL),
 hit AS MATERIALIZED (SELECT DISTINCT nm.id, tc.seq FROM nm JOIN tc ON tc.name = nm.name WHERE tc.date > nm.as_of), met AS (SELECT hit.id, chg.* FROM hit JOIN chg ON chg.seq = hit.seq),
 f AS (SELECT id, count(*) AS n, max(date) AS newest, min_by(kind || ' ' || CASE WHEN kind = 'renamed' THEN previous_path || ' -> ' || path ELSE path END || ' in ' || substr(sha, 1, 8), seq) AS why FROM met GROUP BY 1)"""


@query(f"WITH RECURSIVE {STALE} SELECT mm.id, n IS NOT NULL OR suspect AS possibly_stale, CASE WHEN n > 1 THEN why || ' (+' || (n - 1) || ' more)' WHEN n = 1 THEN why WHEN suspect THEN 'kept from before' END AS reason, newest, coalesce(n, 0) AS n_changes FROM mm LEFT JOIN f ON f.id = mm.id")
def stale_verdicts(spark, d):
    rows = Scratch(spark, "feed").keep(touched_parts(spark, d), "rows")  # a feed is a table; here a join makes it, and its names and hashes need no room
    ch = changes(spark, d, rows=rows)
    anchors, m = order_memories(ch)
    return H.verdicts(anchors, m, ch, H.path_closure(ch.select(F.coalesce("previous_path", "path").alias("path")), H.rename_map(ch)), by_seq=True)


@query(f"WITH RECURSIVE {STALE} SELECT count(*) AS candidates, count(*) FILTER (n IS NOT NULL OR suspect) AS marked FROM mm LEFT JOIN f ON f.id = mm.id")
def mark_suspects(spark, d):
    return stale_verdicts(spark, d).agg(F.count("*").alias("candidates"), F.count_if("possibly_stale").alias("marked"))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7 AND l_orderkey % 10 NOT IN (1, 2)")
def anchor_semijoin(spark, d):
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("ps"))
    m = li.select("id", F.transform(F.filter("ps", lambda p: p % 2 == 0), lambda p: F.struct(p.cast("string").alias("path"), F.lit(None).cast("string").alias("symbol"))).alias("anchors"), F.transform(F.filter("ps", lambda p: p % 2 == 1), lambda p: p.cast("string")).alias("related_nodes"), F.when((F.col("id") % 10).isin(1, 2), F.col("id") + 1).alias("superseded_by"))
    return H.on_paths(m, t(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").cast("string").alias("path"))).select("id")


# --- links ---

def touches(spark, d):
    return changes(spark, d).select(F.coalesce("previous_path", "path").alias("file"), F.col("o").alias("commit"), "date", F.col("o").alias("seq"))


FOLLOW = f"{CHG}, tch AS (SELECT coalesce(previous_path, path) AS file, o, date FROM chg), fu AS (SELECT o AS source, p AS target, file FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n, lag(o) OVER w AS p, lag(date) OVER w AS pd FROM tch WINDOW w AS (PARTITION BY file ORDER BY date, o)) WHERE n <= 60 AND p IS NOT NULL AND date - pd <= 14)"


@query(f"WITH {FOLLOW} SELECT source, target, file FROM fu")
def follows_up(spark, d):
    return H.follow_ups(touches(spark, d), 14, 60)


SHARE = "si AS (SELECT b.o_orderkey AS source, a.o_orderkey AS target, a.o_custkey AS ref FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6))"


@query(f"WITH {SHARE} SELECT source, target, ref FROM si")
def shares_issue(spark, d):
    return H.shared_references(t(spark, d, "orders").select(F.col("o_custkey").alias("ref"), F.col("o_orderkey").alias("commit")))


REVERTING = """cm AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_orderkey % 20 = 10 THEN 'Revert "change ' || o_custkey % 50 || '"' ELSE 'change ' || o_custkey % 50 END AS subject, CAST(o_orderdate AS DATE) AS date,
 CASE WHEN o_orderkey % 20 = 0 THEN substr(md5(CAST(o_orderkey - 1 AS VARCHAR)), 1, 12) WHEN o_orderkey % 20 = 15 THEN (SELECT md5(CAST(min(p.o_orderkey) AS VARCHAR)) FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderkey <> orders.o_orderkey) WHEN o_orderkey % 20 = 5 THEN md5(CAST(o_orderkey - 2 AS VARCHAR)) END AS ref FROM orders),
 rs AS (SELECT a.sha AS source, b.sha AS target FROM cm a JOIN cm b ON starts_with(b.sha, a.ref)),
 rq AS (SELECT sha AS source, date, regexp_extract(subject, '^Revert "(.+)"$', 1) AS quoted FROM cm WHERE starts_with(subject, 'Revert')),
 rv AS (SELECT * FROM rs UNION ALL SELECT source, target FROM (SELECT rq.source, cm.sha AS target, row_number() OVER (PARTITION BY rq.source ORDER BY cm.date DESC, cm.sha DESC) AS r FROM rq JOIN cm ON cm.subject = quoted AND cm.date <= rq.date) WHERE r = 1)"""


@query(f"WITH {REVERTING} SELECT source, target FROM rv")
def revert_links(spark, d):
    key = lambda c: F.md5(c.cast("string"))
    each = Window.partitionBy("o_custkey")
    mates = t(spark, d, "orders").withColumn("o1", F.min("o_orderkey").over(each)).withColumn("o2", F.min(F.when(F.col("o_orderkey") != F.col("o1"), F.col("o_orderkey"))).over(each))
    mate = F.when(F.col("o_orderkey") == F.col("o1"), F.col("o2")).otherwise(F.col("o1"))
    k, topic = F.col("o_orderkey"), F.concat(F.lit("change "), (F.col("o_custkey") % 50).cast("string"))
    subject = F.when(k % 20 == 10, F.concat(F.lit('Revert "'), topic, F.lit('"'))).otherwise(topic)
    body = F.when(k % 20 == 0, F.concat(F.lit("This reverts commit "), F.substring(key(k - 1), 1, 12), F.lit("."))).when(k % 20 == 15, F.concat(F.lit("This reverts commit "), key(mate))).when(k % 20 == 5, F.concat(F.lit("This reverts commit "), key(k - 2)))
    return H.reverts(mates.select(key(k).alias("sha"), subject.alias("subject"), body.alias("body"), F.col("o_orderdate").cast("date").alias("date")))


@query("SELECT o_orderkey AS id FROM orders WHERE 'commit ' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) IN (SELECT 'commit ' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) FROM lineitem WHERE l_quantity > 49)")
def memories_for_commits(spark, d):
    m = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.commit_action(F.md5(F.col("o_orderkey").cast("string"))).alias("action"))
    return H.memories_of(m, t(spark, d, "lineitem").where("l_quantity > 49").select(F.md5(F.col("l_orderkey").cast("string")).alias("sha"))).select("id")


EDGES = f"{FOLLOW}, {SHARE}, {REVERTING}, ky AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders), ed AS (SELECT DISTINCT source, target, 'follows_up' AS relation, 1 AS strength, 0.5 AS confidence FROM fu UNION ALL SELECT source, target, 'shares_issue', 2, 0.8 FROM si UNION ALL SELECT a.k, b.k, 'reverts', 3, 1.0 FROM rv JOIN ky a ON a.sha = source JOIN ky b ON b.sha = target), best AS (SELECT source, target, max_by(relation, strength) AS relation, max(confidence) AS confidence FROM ed GROUP BY 1, 2)"


def edges(spark, d):
    """The three relations, the strongest for each pair. A few reverts concern orders that also share a customer."""
    key = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("sha"))
    named = lambda c: key.select(F.col("k").alias(f"{c}_k"), F.col("sha").alias(c))
    rule = lambda df, relation, strength, confidence: df.select("source", "target", F.lit(relation).alias("relation"), F.lit(strength).alias("strength"), F.lit(4 - strength).alias("rule"), F.lit(confidence).alias("confidence"))
    r = revert_links(spark, d).join(named("source"), "source").join(named("target"), "target").select(F.col("source_k").alias("source"), F.col("target_k").alias("target"))
    f = follows_up(spark, d).select("source", "target").distinct()
    return H.strongest(rule(r, "reverts", 3, 1.0).unionAll(rule(shares_issue(spark, d), "shares_issue", 2, 0.8)).unionAll(rule(f, "follows_up", 1, 0.5)))


@query(f"WITH {EDGES} SELECT source, target, relation FROM best")
def link_precedence(spark, d):
    return edges(spark, d).select("source", "target", "relation")


@query(f"WITH {EDGES}, rk AS (SELECT c_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM customer JOIN orders ON o_custkey = c_custkey), h AS (SELECT * FROM rk WHERE rank <= 5), bw AS (SELECT source AS id, target AS other, confidence FROM best UNION ALL SELECT target, source, confidence FROM best), al AS (SELECT qid, id, rank, CASE WHEN rank <= 2 THEN 0 ELSE 2 END AS step, CAST(NULL AS DOUBLE) AS confidence FROM h UNION ALL SELECT qid, other, rank, 1, CAST(confidence AS DOUBLE) FROM h JOIN bw USING (id) WHERE rank <= 2), u AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY step, confidence DESC, rank) = 1), pl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step, confidence DESC, rank, id) AS place FROM u) SELECT qid, id, CAST(place AS INTEGER) AS place, CASE step WHEN 0 THEN 'by_meaning' WHEN 1 THEN 'linked' ELSE 'backfill' END AS provenance FROM pl WHERE place <= 5")
def linked_arm(spark, d):
    """A customer's five dearest orders as an answer, of which links may replace all but two."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return E.linked_arm(o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("rank")), edges(spark, d), 5, 2)


@query(f"WITH {EDGES}, m AS (SELECT source AS id, relation FROM best UNION ALL SELECT target, relation FROM best) SELECT (SELECT count(*) FROM best) AS n_edges, count(DISTINCT id) AS linked, round(count(DISTINCT id) / (SELECT count(*) FROM orders), 6) AS share FROM m")
def link_coverage(spark, d):
    e = edges(spark, d)
    ends = e.select("source").unionAll(e.select("target")).distinct().agg(F.count("*").alias("linked"))
    return e.agg(F.count("*").alias("n_edges")).crossJoin(ends).crossJoin(t(spark, d, "orders").agg(F.count("*").alias("n"))).select("n_edges", "linked", F.round(F.col("linked") / F.col("n"), 6).alias("share"))


@query(f"WITH {EDGES}, seeds AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 30), both_ways AS (SELECT source AS id, target AS other, confidence FROM best UNION ALL SELECT target, source, confidence FROM best), n AS (SELECT other AS id, CAST(confidence AS DOUBLE) AS confidence, CAST(rank AS INTEGER) AS seed_rank, row_number() OVER (PARTITION BY other ORDER BY confidence DESC, rank) AS r FROM seeds JOIN both_ways USING (id) WHERE other NOT IN (SELECT id FROM seeds)) SELECT id, confidence, seed_rank FROM n WHERE r = 1 ORDER BY confidence DESC, seed_rank, id LIMIT 10")
def one_hop(spark, d):
    top = t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    seeds = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))).select(F.col("o_orderkey").alias("id"), "rank")
    return H.one_hop(seeds, edges(spark, d), 10)


# --- accesses and tiers ---

DAY = 86_400_000


def event_log(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").select("event_id", "event_type", ms.alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("id"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor(ms / DAY).cast("string")).alias("session"))


EV = f"ev AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, user_id || '-' || (epoch_us(ts) // 1000 // {DAY}) AS session FROM events)"
ACC = f"{EV}, wr AS (SELECT id, min_by(session, event_id) AS session FROM ev WHERE event_type = 'signup' GROUP BY 1), acc AS (SELECT ev.id, ev.session, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN any_value(wr.session) IS NOT DISTINCT FROM ev.session THEN 'self' ELSE 'provisional' END AS outcome FROM ev LEFT JOIN wr ON wr.id = ev.id WHERE event_type IN ('click', 'view') GROUP BY 1, 2)"


def access_rows(spark, d):
    ev = event_log(spark, d)
    writers = ev.where("event_type = 'signup'").groupBy("id").agg(F.min_by("session", "event_id").alias("session"))
    return TI.accesses(ev.where("event_type in ('click', 'view')"), writers)


@query(f"WITH {ACC} SELECT id, session, hits, first_seen, last_seen, outcome FROM acc")
def session_upsert(spark, d):
    return access_rows(spark, d).select("id", "session", "hits", "first_seen", "last_seen", "outcome")


@query(f"WITH {ACC} SELECT id, CAST(sum(hits) AS BIGINT) AS access_count, max(last_seen) AS last_accessed FROM acc GROUP BY 1")
def access_counters(spark, d):
    return access_rows(spark, d).groupBy("id").agg(F.sum("hits").alias("access_count"), F.max("last_seen").alias("last_accessed"))


SET = f"{ACC}, st AS (SELECT session, CASE WHEN count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'purchase') THEN 'rejected' ELSE 'confirmed' END AS verdict, max(ts) AS settled_at, max(event_id) AS settle_seq FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1), us AS (SELECT DISTINCT id, session FROM ev WHERE event_type = 'click'), sd AS (SELECT acc.id, acc.session, hits, last_seen, CASE WHEN outcome <> 'provisional' OR verdict IS NULL THEN outcome WHEN verdict = 'rejected' THEN 'rejected' WHEN us.id IS NOT NULL THEN 'confirmed' ELSE 'unused' END AS outcome, settled_at, settle_seq FROM acc LEFT JOIN st ON st.session = acc.session LEFT JOIN us ON us.id = acc.id AND us.session = acc.session)"


def settled(spark, d):
    ev = event_log(spark, d)
    e = ev.where("event_type in ('purchase', 'error')").groupBy("session").agg(F.when(F.count_if(F.col("event_type") == "error") > F.count_if(F.col("event_type") == "purchase"), "rejected").otherwise("confirmed").alias("outcome"), F.max("ts").alias("settled_at"), F.max("event_id").alias("settle_seq"))
    return TI.settle(access_rows(spark, d), e, ev.where("event_type = 'click'").select("id", "session"))


@query(f"WITH {SET} SELECT outcome, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM sd GROUP BY 1")
def settle_outcomes(spark, d):
    return settled(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


NOW = 1_706_745_600_000  # 2024-02-01
START = NOW - C.CREDIT_WINDOW_DAYS * DAY
STATES = f"""{SET}, me AS (SELECT CAST(i AS BIGINT) AS id, CASE i % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS tier, {NOW} - (i % 400) * {DAY} AS created_at, {NOW} - (i % 200) * {DAY // 4} AS tier_changed_at, (i % 5) * 100 AS credit_watermark, i % 37 = 0 AS cold FROM (SELECT p_partkey AS i FROM part)),
 lc AS (SELECT id, max(settled_at) AS lc FROM sd WHERE outcome = 'confirmed' GROUP BY 1),
 ts AS (SELECT me.id, tier, created_at, tier_changed_at, credit_watermark, cold, count(*) FILTER (outcome = 'confirmed') AS confirmed_sessions, count(*) FILTER (outcome = 'confirmed' AND settle_seq > credit_watermark AND settled_at >= {START}) AS promotion_credit,
  coalesce(max(settle_seq) FILTER (outcome = 'confirmed' AND settle_seq > credit_watermark AND settled_at >= {START}), credit_watermark) AS credit_seq, count(*) FILTER (outcome = 'rejected' AND settled_at > greatest(tier_changed_at, coalesce(lc, tier_changed_at))) AS rejected_since,
  CAST(coalesce(sum(hits), 0) AS BIGINT) AS access_count, max(last_seen) AS last_accessed FROM me LEFT JOIN sd ON sd.id = me.id LEFT JOIN lc ON lc.id = me.id GROUP BY 1, 2, 3, 4, 5, 6)"""


def states(spark, d):
    return TI.tier_states(tier_memories(spark, d), settled(spark, d), START)


def tier_memories(spark, d):
    i = F.col("p_partkey").cast("long")
    return t(spark, d, "part").select(i.alias("id"), F.element_at(F.array(*map(F.lit, C.TIERS)), (i % 3 + 1).cast("int")).alias("tier"), (F.lit(NOW) - i % 400 * DAY).alias("created_at"), (F.lit(NOW) - i % 200 * (DAY // 4)).alias("tier_changed_at"), (i % 5 * 100).alias("credit_watermark"), (i % 37 == 0).alias("cold"))


@query(f"WITH {STATES} SELECT id, tier, created_at, tier_changed_at, credit_watermark, cold, confirmed_sessions, promotion_credit, credit_seq, rejected_since, access_count, last_accessed FROM ts")
def tier_states(spark, d):
    return states(spark, d)


DECIDE = "CASE WHEN tier = 'short' AND promotion_credit >= 1 THEN 'promoted_distinct_session' WHEN tier = 'mid' AND promotion_credit >= 2 THEN 'promoted_sustained' WHEN idle > lim AND tier = 'short' THEN 'gc_candidate' WHEN idle > lim THEN 'demoted_idle' WHEN rejected_since >= 3 AND tier <> 'short' THEN 'demoted_rejected' ELSE 'unchanged' END"


DECIDED = f"{STATES}, x AS (SELECT *, ({NOW} - coalesce(last_accessed, created_at)) / {DAY} AS idle, CASE tier WHEN 'short' THEN 30 WHEN 'mid' THEN 90 ELSE 180 END AS lim FROM ts), y AS (SELECT *, {DECIDE} AS reason FROM x), dec AS (SELECT *, CASE WHEN reason = 'promoted_distinct_session' THEN 'mid' WHEN reason = 'promoted_sustained' THEN 'long' WHEN reason LIKE 'demoted%' THEN CASE tier WHEN 'long' THEN 'mid' ELSE 'short' END ELSE tier END AS new_tier FROM y)"


@query(f"WITH {DECIDED} SELECT id, reason, new_tier FROM dec")
def tier_decisions(spark, d):
    return TI.decide(states(spark, d), NOW, DAY).select("id", "reason", "new_tier")


@query(f"WITH {DECIDED} SELECT id, new_tier AS tier, CASE WHEN new_tier <> tier THEN {NOW} ELSE tier_changed_at END AS tier_changed_at, CASE WHEN new_tier <> tier THEN greatest(credit_watermark, credit_seq) ELSE credit_watermark END AS credit_watermark FROM dec")
def apply_tier_changes(spark, d):
    changes = TI.tier_changes(TI.decide(states(spark, d), NOW, DAY), NOW)
    return TI.apply_tier_changes(tier_memories(spark, d).select("id", "tier", "tier_changed_at", "credit_watermark"), changes)


@query(f"WITH {DECIDED}, td AS (SELECT DISTINCT id FROM acc WHERE outcome = 'provisional' AND session IN (SELECT session FROM st)) SELECT id, new_tier AS tier, reason FROM dec WHERE new_tier <> tier AND id IN (SELECT id FROM td)")
def settle_session(spark, d):
    """What settling decides: the memories that settled sessions touched, and no others."""
    ev = event_log(spark, d)
    touched = TI.touched_by(access_rows(spark, d), ev.where("event_type in ('purchase', 'error')").select("session"))
    return TI.tier_changes(TI.decide(states(spark, d).join(touched, "id", "left_semi"), NOW, DAY), NOW).select("id", "tier", "reason")


@query(f"WITH {STATES} SELECT id, coalesce(last_accessed, tier_changed_at) AS idle_since FROM ts WHERE tier = 'short' AND NOT cold AND coalesce(last_accessed, tier_changed_at) < {NOW - 2 * DAY} ORDER BY 2, 1 LIMIT 1000")
def idle_candidates(spark, d):
    return TI.idle_candidates(states(spark, d), NOW - 2 * DAY)


REPLAY = "ev AS (SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS id, event_id AS seq, CASE WHEN event_type IN ('error', 'signup') THEN 'rejected' ELSE 'confirmed' END AS outcome, event_type IN ('click', 'purchase') AS relied FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM ev), every AS (SELECT s.s AS strategy, n.*, CASE s.s WHEN 'raw' THEN true WHEN 'broad' THEN outcome = 'confirmed' ELSE outcome = 'confirmed' AND relied END AS counts FROM n, (VALUES ('raw'), ('broad'), ('narrow')) s(s))"


@query(f"""WITH RECURSIVE {REPLAY}, f(strategy, id, k, tier, credit, rejected, total) AS (SELECT DISTINCT strategy, id, CAST(0 AS BIGINT), 'short', 0, 0, 0 FROM every
 UNION ALL SELECT strategy, id, k, CASE WHEN up THEN CASE tier WHEN 'short' THEN 'mid' ELSE 'long' END WHEN down THEN CASE tier WHEN 'long' THEN 'mid' ELSE 'short' END ELSE tier END, CASE WHEN up OR down THEN 0 ELSE c END, CASE WHEN up OR down THEN 0 ELSE r END, total FROM (
  SELECT *, (tier = 'short' AND c >= 1) OR (tier = 'mid' AND c >= 2) AS up, NOT ((tier = 'short' AND c >= 1) OR (tier = 'mid' AND c >= 2)) AND r >= 3 AND tier <> 'short' AS down FROM (
   SELECT e.strategy, e.id, e.k, f.tier, f.credit + CASE WHEN counts THEN 1 ELSE 0 END AS c, CASE WHEN counts THEN 0 WHEN e.strategy <> 'raw' AND outcome = 'rejected' THEN f.rejected + 1 ELSE f.rejected END AS r, f.total + CASE WHEN counts THEN 1 ELSE 0 END AS total FROM f JOIN every e ON e.strategy = f.strategy AND e.id = f.id AND e.k = f.k + 1))),
 last AS (SELECT strategy, id, arg_max(tier, k) AS tier, arg_max(total, k) AS total FROM f GROUP BY 1, 2)
 SELECT strategy, CAST(count(*) FILTER (tier = 'short') AS BIGINT) AS short, count(*) FILTER (tier = 'mid') AS mid, count(*) FILTER (tier = 'long') AS long, CAST(sum(total) AS BIGINT) AS credit, round(coalesce(count(*) FILTER (tier = 'long' AND CAST(id AS BIGINT) % 8 <> 0) / nullif(count(*) FILTER (tier = 'long'), 0), 1.0), 6) AS long_precision FROM last GROUP BY 1""")
def promotion_replay(spark, d):
    """The ordered fold over real sessions; every eighth memory is taken as wrong, for the precision of what reached long."""
    ev = t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("error", "signup"), "rejected").otherwise("confirmed").alias("outcome"), F.col("event_type").isin("click", "purchase").alias("relied"))
    out = None
    for name in ("raw", "broad", "narrow"):
        r = TI.replay_strategy(ev, name)
        n = lambda x: F.count_if(F.col("tier") == x)
        sound = F.count_if((F.col("tier") == "long") & (F.col("id").cast("long") % 8 != 0))
        one = r.agg(n("short").alias("short"), n("mid").alias("mid"), n("long").alias("long"), F.sum("credit").alias("credit"), F.round(F.coalesce(sound / F.nullif(n("long"), F.lit(0)), F.lit(1.0)), 6).alias("long_precision")).select(F.lit(name).alias("strategy"), "*")
        out = one if out is None else out.unionAll(one)
    return out


# --- events, context, streams ---

@query("WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'ExperienceRecorded' WHEN 'purchase' THEN 'ExperienceSuperseded' WHEN 'view' THEN 'CodeChanged' WHEN 'signup' THEN 'SymbolAdded' ELSE event_type END AS t FROM events) SELECT count(*) FILTER (t LIKE 'Experience%') AS applied, count(*) FILTER (t IN ('CodeChanged', 'SymbolAdded')) AS retired, count(*) FILTER (t NOT LIKE 'Experience%' AND t NOT IN ('CodeChanged', 'SymbolAdded')) AS unrecognised FROM e")
def event_replay_counts(spark, d):
    names = F.create_map(*map(F.lit, ["click", "ExperienceRecorded", "purchase", "ExperienceSuperseded", "view", "CodeChanged", "signup", "SymbolAdded"]))
    return S.replay_counts(t(spark, d, "events").select(F.coalesce(F.try_element_at(names, F.col("event_type")), "event_type").alias("event_type")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_occurrence_dedupe(spark, d):
    return S.first_occurrences(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("WITH RECURSIVE r AS (SELECT conv_id AS grp, CAST(turn AS BIGINT) AS rank, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), f(grp, k, rank, shown, rest) AS (SELECT grp, k, rank, least(len, 3000), greatest(3000 - len, 200) FROM r WHERE k = 1 UNION ALL SELECT r.grp, r.k, r.rank, least(r.len, f.rest), greatest(f.rest - r.len, 200) FROM f JOIN r ON r.grp = f.grp AND r.k = f.k + 1) SELECT grp, rank, shown FROM f")
def body_budget(spark, d):
    return S.body_budget(t(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("rank"), F.length("text").alias("len")))


@query("SELECT conv_id AS qid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, conv_id * 100 + turn) AS INTEGER) AS place, conv_id * 100 + turn AS id FROM conversations WHERE turn < 3")
def context_topn(spark, d):
    """A conversation's first three turns as its answers, put in order by the library: the longest counts as the newest."""
    turns = t(spark, d, "conversations").select(F.col("conv_id").alias("qid"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("turn") + 1).alias("rank"), F.length("text").alias("ts"))
    return CX.build_context(turns.select("qid", "id", "rank"), turns.select("id", "ts"), most=3).select("qid", "place", "id")


@query("SELECT conv_id AS qid, '# Context: talk ' || conv_id || chr(10) || chr(10) || '## Prior Experience' || chr(10) || chr(10) || string_agg('- [' || role || '] ' || CASE WHEN turn % 3 = 0 THEN '(no recorded outcome)' ELSE substr(text, 1, 60) END || CASE WHEN turn % 4 = 1 THEN ' — **old** (since ' || turn || ')' ELSE '' END || CASE WHEN turn % 2 = 1 THEN chr(10) || '  - ' || length(text) ELSE '' END, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def chat_context(spark, d):
    """Conversations as the contexts that the library renders: outcomes, staleness with its reason, and lessons."""
    n = F.col("turn")
    rows = t(spark, d, "conversations").select(
        F.col("conv_id").alias("qid"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("question"), n.alias("place"), F.col("role").alias("task"), F.when(n % 3 != 0, F.substring("text", 1, 60)).alias("result"),
        F.when(n % 2 == 1, F.array(F.length("text").cast("string"))).alias("lessons"), F.when(n % 4 == 1, "old").alias("staleness"), F.when(n % 4 == 1, F.concat(F.lit("since "), n.cast("string"))).alias("staleness_reason"),
    )
    return S.render_contexts(rows)


@query("SELECT o_orderpriority AS stratum, count(*) AS n, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS precision_ FROM orders GROUP BY 1")
def stratified_precision(spark, d):
    """All edges from customers to their orders, by priority, judged by their price."""
    judged = t(spark, d, "orders").select(F.col("o_orderpriority").alias("relation"), (F.col("o_totalprice") > 150000).alias("good"))
    return E.precision_by(judged).select(F.col("relation").alias("stratum"), "n", F.round("precision", 6).alias("precision_"))


@query("SELECT conv_id, turn, round((CASE WHEN contains(lower(text), 'a') OR contains(lower(text), 'zu') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'qu') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'er') THEN 1 ELSE 0 END) / 3.0, 6) AS score FROM conversations WHERE text IS NOT NULL")
def keyword_grading(spark, d):
    rows = t(spark, d, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.round(E.keyword_score(F.col("text"), [["A", "zu"], ["qu"], ["License", "er"]]), 6).alias("score"))


@query("SELECT l_linestatus AS condition, count(*) AS n, round(avg(CAST(l_discount AS DOUBLE)), 6) AS mean_score, round(avg(CAST(l_linenumber AS DOUBLE)), 6) AS mean_turns, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_seconds, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS total_cost FROM lineitem GROUP BY 1")
def run_summary(spark, d):
    f = lambda c, name: F.col(c).cast("double").alias(name)
    runs = t(spark, d, "lineitem").select(F.col("l_linestatus").alias("condition"), f("l_discount", "score"), f("l_linenumber", "turns"), f("l_quantity", "seconds"), f("l_extendedprice", "cost"))
    s = E.run_summary(runs)
    return s.select("condition", "n", *(F.round(c, 6).alias(c) for c in ("mean_score", "mean_turns", "mean_seconds")), F.round("total_cost", 2).alias("total_cost"))


@query(f"WITH {SET}, k AS (SELECT id, CAST(sum(CASE WHEN outcome = 'confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS credit FROM sd GROUP BY 1) SELECT credit, count(*) AS n FROM k GROUP BY 1")
def credit_histogram(spark, d):
    return E.credit_histogram(settled(spark, d).select("id", (F.col("outcome") == "confirmed").cast("long").alias("credit")))


@query("WITH s AS (SELECT o_orderpriority AS relation, o_totalprice > 150000 AS good FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT o_orderpriority AS relation, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT relation, count(*) AS k, count(*) FILTER (good) AS g FROM s GROUP BY 1) SELECT round(sum(g) / sum(k), 6) AS precision_, round(sum(CAST(g AS DOUBLE) / k * n) / sum(n), 6) AS weighted FROM k JOIN p USING (relation)")
def weighted_precision(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("relation"), (F.col("o_totalprice") > 150000).alias("good"), "o_orderkey")
    r = E.weighted_precision(o.where("o_orderkey % 5 = 0"), o.groupBy("relation").agg(F.count("*").alias("n")))
    return r.select(F.round("precision", 6).alias("precision_"), F.round("weighted", 6).alias("weighted"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    """As a stream: hours counted once the watermark has passed them, and the open ones when the events end."""
    w = EV_.finished(EV_.read_events(spark, f"{d}/events.parquet"), EV_.tumbling_counts)
    return w.select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, d):
    """As a stream of sessions, appended when they are over."""
    s = EV_.finished(EV_.read_events(spark, f"{d}/events.parquet"), EV_.sessions)
    return s.select("user_id", F.unix_millis("start").alias("start_ms"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_watermark(spark, d):
    return EV_.finished(EV_.read_events(spark, f"{d}/events.parquet"), lambda e: EV_.distinct_keys(e, ["user_id", "event_type"], "100 days"), close=False)


@query(f"""WITH {EV}, a AS (SELECT session, id, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_id, (ts, event_id)) AS first_id, min((ts, event_id)) AS at FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
 s AS (SELECT session, (ts, event_id) AS at, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'confirmed' END AS kind FROM ev WHERE event_type IN ('purchase', 'error')),
 d AS (SELECT a.session, a.id, min(s.at) AS s_at, arg_min(kind, s.at) AS kind FROM a JOIN s ON s.session = a.session AND s.at > a.at GROUP BY 1, 2),
 u AS (SELECT DISTINCT d.session, d.id FROM d JOIN ev ON ev.session = d.session AND ev.id = d.id AND event_type = 'click' AND (ev.ts, ev.event_id) < d.s_at)
 SELECT a.session, a.id, hits, first_seen, last_seen, CASE WHEN kind IS NULL THEN 'provisional' WHEN kind = 'rejected' THEN 'rejected' WHEN u.id IS NOT NULL THEN 'confirmed' ELSE 'unused' END AS outcome FROM a LEFT JOIN d ON d.session = a.session AND d.id = a.id LEFT JOIN u ON u.session = a.session AND u.id = a.id""")
def access_stream(spark, d):
    """Keyed state: a session's accesses, settled by its purchases and errors in the order of their time."""
    e = EV_.read_events(spark, f"{d}/events.parquet")

    def plan(events):
        kind = F.when(F.col("event_type").isin("click", "view"), "access").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "confirmed")
        session = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.unix_millis("ts") / DAY).cast("string"))
        rows = events.select(session.alias("session"), F.get_json_object("props", "$.k").cast("long").alias("id"), F.coalesce(kind, F.when(F.col("event_id").isNull(), "access")).alias("kind"), (F.col("event_type") == "click").alias("used"), F.coalesce("event_id", F.lit(0)).cast("long").alias("seq"), "ts")
        return EV_.access_state(rows.where("kind is not null").fillna({"id": -1, "used": False}))

    return EV_.finished(e, plan)


# --- the memory's life ---

@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'ExperienceRecorded' WHEN event_type = 'purchase' THEN 'ExperienceSuperseded' ELSE event_type END AS event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 r AS (SELECT k AS id, arg_min('text ' || event_id, event_id) AS payload FROM e WHERE event_type = 'ExperienceRecorded' GROUP BY 1), l AS (SELECT k AS id, arg_max(user_id + 1000, event_id) AS superseded_by FROM e WHERE event_type = 'ExperienceSuperseded' GROUP BY 1)
 SELECT CAST(r.id AS VARCHAR) AS id, payload, CAST(superseded_by AS VARCHAR) AS superseded_by FROM r LEFT JOIN l USING (id)""")
def replay_events(spark, d):
    """What the event log projects to: each memory as first recorded, with its latest link."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type").isin("click", "view"), "ExperienceRecorded").when(F.col("event_type") == "purchase", "ExperienceSuperseded").otherwise(F.col("event_type"))
    ev = t(spark, d, "events").select("event_id", kind.alias("event_type"), k.alias("id"), (F.col("user_id") + 1000).cast("string").alias("new_id"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("payload"))
    return S.replay(ev)


@query("""WITH c AS (SELECT conv_id AS id, max(turn) AS turns, min_by(text, turn) AS text FROM conversations GROUP BY 1) SELECT id, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_lessons, CASE id % 3 WHEN 0 THEN 'src/a.ts#f' WHEN 1 THEN 'src/n' || id || '.ts' ELSE '' END AS anchors, id % 2 = 1 AS suspect FROM c""")
def decode_rows(spark, d):
    """Stored rows, whose lists are JSON text and flags numbers, as the engine's types; anchors fall back on related nodes."""
    i = F.col("conv_id")
    rows = t(spark, d, "conversations").groupBy(i.alias("id")).agg(F.first("role").alias("task")).select(
        "id", F.when(F.col("id") % 4 == 0, "[]").when(F.col("id") % 4 == 1, '["a", "b"]').when(F.col("id") % 4 == 2, '["only"]').otherwise('{"not": "a list"}').alias("lessons"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit('["'), F.md5(F.col("id").cast("string")), F.lit('", "src/n'), F.col("id").cast("string"), F.lit('.ts", " "]'))).otherwise("[]").alias("related_nodes"),
        F.when(F.col("id") % 3 == 0, '[{"path": "src/a.ts", "symbol": "f"}]').otherwise("[]").alias("anchors"), (F.col("id") % 2).alias("suspect"), F.lit(0).alias("cold"),
    )
    return L.decode_rows(rows).select("id", F.size("lessons").alias("n_lessons"), F.array_join(F.transform("anchors", A.format_anchor), ",").alias("anchors"), "suspect")


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderdate AS ts, 'c' || o_custkey AS path FROM orders WHERE o_orderkey % 10 NOT IN (1, 2)), q AS (SELECT c_custkey AS qid, 'c' || c_custkey AS anchor FROM customer) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id) AS INTEGER) AS rank FROM q JOIN m ON m.path = anchor""")
def anchor_recency(spark, d):
    o, path = t(spark, d, "orders"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    struct = F.struct(path.alias("path"), F.lit(None).cast("string").alias("symbol"))
    even = F.col("o_orderkey") % 2 == 0
    m = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.when(even, F.array(struct)).otherwise(F.array().cast("array<struct<path:string,symbol:string>>")).alias("anchors"), F.when(~even, F.array(path)).alias("related_nodes"), F.when((F.col("o_orderkey") % 10).isin(1, 2), F.col("o_orderkey")).alias("superseded_by"))
    return L.newest_on_anchor(m, t(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor")))


@query("""SELECT conv_id AS qid, string_agg('--- prior knowledge ' || (turn + 1) || ' (' || CASE WHEN turn % 2 = 0 THEN 'unknown source' ELSE 'commit ' || turn END || CASE WHEN conv_id % 3 = 0 THEN ' · touched 2 file(s)' ELSE '' END || ', confidence 0.7) ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def why_context(spark, d):
    rows = t(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("commit "), F.col("turn").cast("string"))).alias("action"), F.array("text").alias("lessons"), F.lit("").alias("observation"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("related_nodes"), F.lit(0.7).alias("confidence"))
    return L.why_context(rows, "/repo")


@query("SELECT conv_id, turn FROM conversations WHERE length(text) >= 25")
def worth_asking(spark, d):
    return t(spark, d, "conversations").where(T.worth_asking(F.col("text"))).select("conv_id", "turn")
