"""Filling a store: reports, history, digests and vectors. Runners and embedders are passed in; what is missing is a worklist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import chunk_rows
from ..functions.text import digest_accepted, digest_prompt, query_tokens, search_text
from ..functions.vectors import mean_pool
from ..sources import git
from ..sources.scratch import Scratch
from .lifecycle import Memory
from .store import Store

Embedder = Callable[[Column], Column]


def _fnv1a(token: str) -> int:
    h = 2166136261
    for c in token.encode("ascii", "replace"):
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h


def hash_embedder(dim: int = 1536) -> Embedder:
    """The deterministic provider: signed counts of a text's tokens by hash, of length one; no tokens, a zero vector."""

    def run(tokens: pd.Series) -> pd.Series:
        out = []
        for words in tokens:
            v = np.zeros(dim)
            for h in map(_fnv1a, words if words is not None else ()):
                v[h % dim] += 1 if h % 2 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(out)

    udf = F.pandas_udf(run, "array<float>")
    return lambda text: udf(query_tokens(text))


def embed(rows: DataFrame, embedder: Embedder, size: int = 1000) -> DataFrame:
    """(id, vec) of rows (id, text): the pooled vectors of a text's chunks; null where the pool has no length."""
    pieces = chunk_rows(rows.select("id", "text"), size=size)
    each = pieces.select("id", F.struct("pos", embedder(F.col("chunk")).alias("v")).alias("c"))
    return each.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("cs")).select("id", mean_pool(F.transform("cs", lambda c: c.v)).alias("vec"))


def missing_vectors(store: Store, limit: int | None = None) -> DataFrame:
    """Memories without a vector of their present text, oldest first."""
    rows = store.current().where("vec is null").orderBy("ts", "id")
    return (rows if limit is None else rows.limit(limit)).select("id", search_text(F.col("task"), F.col("digest"), F.col("observation")).alias("text"))


def backfill_vectors(store: Store, embedder: Embedder | None, limit: int | None = None) -> int:
    """Vectors for what has none; how many. Without an embedder none, and answers stay lexical."""
    if embedder is None:
        return 0
    found = Scratch(store.spark, "vectors").keep(embed(missing_vectors(store, limit), embedder).where("vec is not null").select("id", F.lit("embedding").alias("kind"), F.col("vec").cast("array<float>").alias("vec")), "found")
    n = found.count()
    if n:
        store.note(found)
    return n


def capture_history(memory: Memory, repo: str, scope: str = "", limit: int = 500, embedder: Embedder | None = None, now=None) -> dict[str, int]:
    """Explaining commits that are not recorded yet, oldest first, as memories anchored on their files; counts of what was done."""
    backfilled = backfill_vectors(memory, embedder)
    found = Scratch(memory.spark, "history").keep(git.commits(memory.spark, repo, scope, limit), "commits")
    recorded = memory.remember(git.as_memories(found, memory.current().select("action")), now)
    mined = found.count()
    return {"mined": mined, "recorded": recorded, "already_recorded": mined - recorded, "embeddings_backfilled": backfilled, "embedded": backfill_vectors(memory, embedder)}


def capture_stream(memory: Memory, repo: str, checkpoint: str, scope: str = "") -> int:
    """capture_history() as a stream: records what the history has gained since the last run; how many memories that made.

    The stream's checkpoint holds the head that was reached. A batch is one commit of the memory, and a memory's id
    follows from its commit, so a batch that is run again after a failure records nothing twice.
    """
    made: list[int] = []

    def record(batch: DataFrame, _: int) -> None:
        found = Scratch(memory.spark, "arrived").keep(batch, "commits")
        made.append(memory.remember(git.as_memories(found, memory.current().select("action"))))

    query = git.commit_stream(memory.spark, repo, scope).writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(made)


def first_sentences(prompt: str, most: int = 600) -> str:
    """A runner without a model: the beginning of the body, up to the last full stop."""
    body = prompt.split("BODY:\n", 1)[-1].strip()[:most]
    return body[: body.rfind(".") + 1] or body


def distill(store: Store, runner: Callable[[str], str] = first_sentences, limit: int = 200, concurrency: int = 4) -> int:
    """Digests for current memories without one, oldest first; a runner that fails or says too much leaves the memory on the list."""
    todo = store.current().where("digest is null and superseded_by is null").orderBy("ts", "id").limit(limit)
    paths = F.transform(F.coalesce("anchors", F.array().cast("array<struct<path:string,symbol:string>>")), lambda a: a.path)
    asked = todo.select("id", digest_prompt(F.col("task"), paths, F.col("observation")).alias("prompt")).repartition(concurrency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str:
            try:
                return runner(prompt)
            except Exception:  # noqa: BLE001 - any failure of the external runner means: no digest this time
                return ""

        for f in frames:
            yield pd.DataFrame({"id": f["id"], "text": [one(p).strip() for p in f["prompt"]]})

    good = asked.mapInPandas(run, "id string, text string").where(digest_accepted(F.col("text"))).persist()
    n = good.count()
    if n:
        store.note(good.select("id", F.lit("digest").alias("kind"), "text"))
    good.unpersist()
    return n


def record_reports(store: Store, judged: DataFrame, now: str) -> dict[str, int]:
    """Accepted reports (sources.files.judged_reports) as memories; counts of recorded and of each reason to refuse."""
    refused = {r.reject_reason: r.n for r in judged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n")).collect()}
    new = judged.where("reject_reason is null").drop("reject_reason").withColumn("ts", F.to_timestamp(F.lit(now)))
    rows = new.withColumn("id", F.substring(F.sha2(F.concat_ws("\n", "action", "task", "observation"), 256), 1, 32))
    return {"recorded": store.remember(rows, now) if isinstance(store, Memory) else store.record(rows), **refused}


def relink(store: Store, rows: DataFrame) -> int:
    """Links of a transfer (id, superseded_by) whose target has arrived since; only memories without a link take one."""
    now = store.current().select("id", F.col("superseded_by").alias("has"))
    open_ = rows.where("superseded_by is not null").select("id", "superseded_by").join(now.where("has is null"), "id")
    found = open_.join(now.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi").persist()
    n = found.count()
    if n:
        store.note(found.select("id", F.lit("superseded").alias("kind"), F.col("superseded_by").alias("text")))
    found.unpersist()
    return n
