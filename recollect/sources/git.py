"""Git history as Spark data sources: "gitlog" (commits with their files, also as a stream) and "gitchanges" (touched paths, newest first).

A read is split into ranges of commits, each of which git lists in a task of its own; only their number is counted
beforehand. A change's seq follows from its commit's place in the history, so it is the same however the read is split.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.anchors import change_kind, in_scope, unquote_git_path
from ..functions.text import commit_action, is_explanatory, lesson

LOG = "sha string, short_sha string, date timestamp, subject string, body string, files array<string>"
CHANGES = "seq long, path string, previous_path string, status string, sha string, date timestamp"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, timeout=120).stdout


def _date(text: str) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError:
        return None


#: Commits of one range at least, and seq values that a commit has for its paths.
LEAST_RANGE, PATHS_OF_COMMIT = 64, 1 << 24


class _Range(InputPartition):
    """The commits of a revision from `skip` on, newest first."""

    def __init__(self, revision: str, skip: int, count: int):
        self.revision, self.skip, self.count = revision, skip, count


def _log_rows(repo: str, part: _Range, paths: list[str]) -> Iterator[tuple]:
    text = _git(repo, "log", "--name-only", f"--skip={part.skip}", f"-n{part.count}", "--format=%x1e%H%x1f%aI%x1f%s%x1f%b%x1f", part.revision, *paths)
    for record in text.split("\x1e")[1:]:
        sha, date, subject, body, files = record.split("\x1f")
        yield sha, sha[:8], _date(date), subject, body.strip(), [unquote_git_path(f) for f in files.split("\n") if f]


def _change_rows(repo: str, part: _Range, paths: list[str]) -> Iterator[tuple]:
    text = _git(repo, "log", "--no-merges", "--name-status", "-M50%", f"--skip={part.skip}", f"-n{part.count}", "--format=%x1e%H%x1f%aI", part.revision, *paths)
    for at, record in enumerate(text.split("\x1e")[1:], part.skip):
        head, *lines = record.strip("\n").split("\n")
        sha, date = head.split("\x1f")
        for i, line in enumerate(filter(None, lines)):
            status, *named = line.split("\t")
            named = [unquote_git_path(p) for p in named]
            yield at * PATHS_OF_COMMIT + i, named[-1], named[0] if len(named) > 1 else None, status, sha, _date(date)


def _ranges(repo: str, revision: str, limit: int | None, wanted: int, flags: list[str], paths: list[str]) -> list[_Range]:
    """The newest `limit` commits of a revision in at most `wanted` ranges of equal size."""
    newest = [] if limit is None else [f"-n{limit}"]
    n = int(_git(repo, "rev-list", "--count", *flags, *newest, revision, *paths))
    size = max(LEAST_RANGE, -(-n // max(1, wanted)))
    return [_Range(revision, at, min(size, n - at)) for at in range(0, n, size)]


class _Options:
    """Options of a source: path, limit, partitions and within, git's own path arguments, so that its limit counts commits within them."""

    def __init__(self, options: dict):
        self.repo, self.limit, self.wanted = options["path"], int(options.get("limit", "400")), int(options.get("partitions", "8"))
        named = [p for p in options.get("within", "").split("\n") if p not in ("", ".", "*")]
        self.paths = ["--", *named] if named else ["--"]


class _Reader(_Options, DataSourceReader):
    def __init__(self, options: dict, changes: bool):
        super().__init__(options)
        self.changes = changes

    def partitions(self) -> list[_Range]:
        head = _git(self.repo, "rev-parse", "HEAD").strip()  # commits that come meanwhile shift no range
        return _ranges(self.repo, head, self.limit, self.wanted, ["--no-merges"] if self.changes else [], self.paths)

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        return (_change_rows if self.changes else _log_rows)(self.repo, partition, self.paths) if partition else iter(())


class _Stream(_Options, DataSourceStreamReader):
    """Commits in the order in which they arrive at the head: an offset is the sha of a head, and a batch what lies between two."""

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        return {"sha": _git(self.repo, "rev-parse", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if start["sha"] == end["sha"]:
            return []
        span = f"{start['sha']}..{end['sha']}" if start["sha"] else end["sha"]
        return _ranges(self.repo, span, None, self.wanted, [], self.paths)

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        return _log_rows(self.repo, partition, self.paths) if partition else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the stream's own checkpoint."""


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class GitChanges(GitLog):
    @classmethod
    def name(cls) -> str:
        return "gitchanges"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


def commits(spark: SparkSession, repo: str, scope: str = "", limit: int = 400, explanatory: bool = True) -> DataFrame:
    """The newest `limit` commits within the scope, with their files in scope and outside tests; by default only those that explain themselves.

    The scope is a bare prefix of paths for explaining commits, and ends at a path's component for all commits, as the
    two readers of the history are used.
    """
    spark.dataSource.register(GitLog)
    df = spark.read.format("gitlog").option("limit", limit).option("within", _prefix(scope, explanatory)).load(repo)
    return _within(df, scope, explanatory)


def commit_stream(spark: SparkSession, repo: str, scope: str = "", explanatory: bool = True) -> DataFrame:
    """commits(), all of them, as a stream: what the head gains between two triggers is a batch."""
    spark.dataSource.register(GitLog)
    df = spark.readStream.format("gitlog").option("within", _prefix(scope, explanatory)).load(repo)
    return _within(df, scope, explanatory)


def _prefix(scope: str, explanatory: bool) -> str:
    return scope if scope in ("", ".", "*") else scope if not explanatory else f"{scope.rstrip('*')}*"


def _within(df: DataFrame, scope: str, explanatory: bool) -> DataFrame:
    df = df.withColumn("files", F.filter("files", lambda f: in_scope(f, scope, boundary=not explanatory) & ~F.contains(f, F.lit("/tests/")))).where(F.size("files") > 0)
    return df.where(is_explanatory(F.col("subject"), F.col("body"))) if explanatory else df


def changed_paths_since(spark: SparkSession, repo: str, since=None, limit: int = 1000, paths: list[str] = ()) -> DataFrame:
    """The change feed, of all paths or those named; since compares author dates, undated commits stay."""
    spark.dataSource.register(GitChanges)
    df = spark.read.format("gitchanges").option("limit", limit).option("within", "\n".join(paths)).load(repo).withColumn("kind", change_kind(F.col("status"))).drop("status")
    return df if since is None else df.where(F.col("date").isNull() | (F.col("date") > F.lit(since)))


def corpus_revision(repo: str) -> str:
    """The short sha of the commit that is checked out."""
    return _git(repo, "rev-parse", "--short", "HEAD").strip()


def as_memories(history: DataFrame, recorded: DataFrame) -> DataFrame:
    """Commits as memories, those recorded (action) left out, each action once, the oldest; in order of their time, oldest first."""
    rows = history.withColumn("action", commit_action(F.col("sha"))).join(recorded.select("action"), "action", "left_anti")
    first = rows.groupBy("action").agg(F.min_by(F.struct("sha", "subject", "body", "files", "date"), F.struct("date", "sha")).alias("c"))
    told = lesson(F.col("c.subject"), F.col("c.body"))
    anchors = F.transform("c.files", lambda f: F.struct(f.alias("path"), F.lit(None).cast("string").alias("symbol")))
    out = first.select(F.sha2("action", 256).alias("id"), F.col("c.subject").alias("task"), told.alias("observation"), "action", F.array(told).alias("lessons"), F.col("c.files").alias("related_nodes"), anchors.alias("anchors"), F.lit(0.7).alias("confidence"), F.col("c.date").alias("ts"))
    return out.orderBy("ts", "action")
