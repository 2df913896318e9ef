"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import STOPWORDS

# Words that mark an explaining commit, and trailer lines that don't count.
EXPLAINING = r"(?i)\b(fix|revert|regress|workaround|perf|breaking|bug|instead|because|so that|decision|decided|decides|chose|chosen|choosing|rather than|trade-?offs?|supersedes?|superseded|deliberately|intentionally|on purpose)\b"
TRAILER = r"(?i)^(co-authored-by|signed-off-by|-{3,}|\*\s*$)"
# Fixed value: what points at code instead of explaining it.
LOCATION = r"(^|\s)[-*•\d.)]+\s|[\w@./-]*/[\w@./-]+|[\w-]+\.[a-z]{1,5}\b|[A-Za-z_$][\w$]*(?:[.#][\w$]+)+"


def query_tokens(text: Column) -> Column:
    """camelCase split, ASCII words, lower-cased, longer than two, no stopwords; duplicates stay."""
    parts = F.split(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^a-zA-Z0-9_]+")
    low = F.transform(parts, F.lower)
    return F.filter(low, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def query_terms(text: Column) -> Column:
    return F.array_distinct(query_tokens(text))


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; neither camelCase nor stopwords matter to the index."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigram_sequence(text: Column) -> Column:
    """All three-letter windows of each word, padded by two blanks before and one after; duplicates stay."""
    return F.flatten(F.transform(index_tokens(text), _word_trigrams))


def _word_trigrams(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))


def trigram_set(text: Column) -> Column:
    return F.array_distinct(trigram_sequence(text))


def meaningful_body(body: Column) -> Column:
    return F.trim(F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.rlike(F.trim(x), F.lit(TRAILER))), "\n"))


def is_explanatory(subject: Column, body: Column, vocabulary: str = EXPLAINING, least: int = 200) -> Column:
    m = meaningful_body(body)
    return (F.length(m) >= least) & F.rlike(F.concat(subject, F.lit(" "), m), F.lit(vocabulary))


def lesson(subject: Column, body: Column) -> Column:
    """Subject and body without trailers, blank runs closed up."""
    return F.concat(subject, F.lit("\n\n"), F.regexp_replace(meaningful_body(body), r"\n{3,}", "\n\n"))


def prose_words(text: Column) -> Column:
    """How many words longer than one letter remain once locations are removed."""
    return F.size(F.filter(F.split(F.regexp_replace(text, LOCATION, " "), "[^A-Za-z']+"), lambda w: F.length(w) > 1))


def reject_reason(understanding: Column, least_chars: int = 200, least_words: int = 25) -> Column:
    """Why a report is refused, null where it is accepted."""
    t = F.trim(understanding)
    return F.when(F.length(t) < least_chars, "too_short").when(prose_words(t) < least_words, "bare_locations")


def search_text(task: Column, digest: Column, observation: Column) -> Column:
    return F.concat(task, F.lit(" "), F.coalesce(digest, observation))


def issue_refs(text: Column) -> Column:
    found = F.concat(F.regexp_extract_all(text, F.lit(r"#(\d{1,6})\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)github\.com/[\w.-]+/[\w.-]+/(?:issues|pull)/(\d{1,6})\b"), F.lit(1)))
    return F.array_distinct(found)


def reverted_shas(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)this reverts commit ([0-9a-f]{7,40})"), F.lit(1))


def reverted_subject(subject: Column) -> Column:
    found = F.regexp_extract(subject, r'(?i)^revert\s+"(.+)"\s*$', 1)
    return F.when(found != "", found)


def excerpt(text: Column, most: int = 400) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def commit_action(sha: Column) -> Column:
    return F.concat(F.lit("commit "), F.substring(sha, 1, 8))


def sha_of(action: Column) -> Column:
    """The short sha of a captured commit's action; other actions as they are."""
    return F.trim(F.regexp_replace(action, "^commit ", ""))


def scout_action(source: Column) -> Column:
    return F.when(source.isNull(), "scout-report").otherwise(F.concat(F.lit("scout-report "), source))


def gap_label(ms: Column) -> Column:
    hours = ms / 3600000.0
    return F.when(hours < 48, F.format_string("%.1fh", hours)).otherwise(F.format_string("%.1fd", hours / 24))


def digest_prompt(task: Column, paths: Column, body: Column, most: int = 12_000) -> Column:
    """What a digest runner is asked: the task, its files and the first part of the body."""
    files = F.when(F.size(paths) > 0, F.array_join(paths, ", ")).otherwise(F.lit("(none recorded)"))
    head = F.lit("Condense this engineering memory to at most 120 words in three lines labelled What, Why and Where.")
    return F.concat_ws("\n", head, F.concat(F.lit("TASK: "), task), F.concat(F.lit("FILES: "), files), F.lit("BODY:"), F.substring(body, 1, most))


def digest_accepted(digest: Column, most: int = 1200) -> Column:
    return F.length(F.trim(digest)).between(1, most)


def worth_asking(prompt: Column, least: int = 25) -> Column:
    """Prompts long enough to look anything up for: shorter ones are commands and nods."""
    return F.length(prompt) >= least


def json_items(text: Column) -> Column:
    """A JSON array's elements as strings, objects as their JSON text; anything else has none."""
    return F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def shown_body(body: Column, budget: Column, id_: Column) -> Column:
    """A body within its budget, else cut there with a pointer to the whole."""
    n = F.length(body)
    more = F.concat(F.lit("\n_(… "), (n - budget).cast("string"), F.lit(" more chars — `recollect show "), id_.cast("string"), F.lit("`)_"))
    return F.when(n > budget, F.concat(F.substr(body, F.lit(1), budget.cast("int")), more)).otherwise(body)


def heading(task: Column, action: Column, ts: Column, reason: Column, legs: Column, score: Column) -> Column:
    """The two lines over a hit: its task; its source, day, reason, legs and score."""
    return F.concat(F.lit("### "), task, F.lit("\n_"), F.coalesce(action, F.lit("unknown source")), F.lit(" · "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" · "), reason, F.lit(" ("), F.array_join(legs, "+"), F.lit("), score "), F.format_string("%.4f", score), F.lit("_\n"))
