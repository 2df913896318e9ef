"""JSON files: scout reports, corrections, inline records, transfer documents, result sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.anchors import format_anchor, parse_any_anchor, relative_path
from ..functions.text import reject_reason, scout_action

SCOUT = "task string, understanding string, anchors array<string>, lessons array<string>, result string, source string, confidence double"
CORRECTION = "supersedes string, task string, observation string, anchors array<string>, lessons array<string>, confidence double"


RECORD = "task string, observation string, action string, result string, lessons array<string>, files array<string>, confidence double"


def scout_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCOUT).json(path, multiLine=True)


def corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION).json(path, multiLine=True).fillna({"confidence": 0.8})


def correction_rows(rows: DataFrame) -> DataFrame:
    """Corrections as memories beside what they supersede; anchors left out stay null, to be inherited."""
    anchors = F.array_distinct(F.transform("anchors", parse_any_anchor))
    nodes = F.transform(anchors, format_anchor)
    return rows.select("supersedes", "task", "observation", F.concat(F.lit("refine-memory: corrects "), "supersedes").alias("action"), F.coalesce("lessons", F.array("observation")).alias("lessons"), anchors.alias("anchors"), nodes.alias("related_nodes"), "confidence")


def inline_record(spark: SparkSession, text: str, repo: str = ".") -> DataFrame:
    """One memory from a JSON object's text: task, observation, files (made relative to the repository), confidence 0.7 by default."""
    made = json.loads(text)
    made["files"] = [relative_path(f, repo) for f in made.get("files") or []]
    r = spark.createDataFrame([(json.dumps(made),)], "t string").select(F.from_json("t", RECORD).alias("r")).select("r.*")
    anchors = F.transform("files", lambda f: F.struct(f.alias("path"), F.lit(None).cast("string").alias("symbol")))
    return r.select("task", "observation", "action", "result", F.coalesce("lessons", F.array("observation")).alias("lessons"), F.col("files").alias("related_nodes"), anchors.alias("anchors"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))


def judged_reports(reports: DataFrame) -> DataFrame:
    """Reports as memories with reject_reason: null where understanding and anchors suffice."""
    anchors = F.array_distinct(F.transform(F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: F.trim(a) != ""), parse_any_anchor))
    anchors = F.filter(anchors, lambda a: F.trim(a.path) != "")
    rows = reports.withColumn("anchors", anchors)
    return rows.select("task", F.col("understanding").alias("observation"), scout_action(F.col("source")).alias("action"), "result", "anchors", F.coalesce("lessons", F.array("understanding")).alias("lessons"), F.coalesce("confidence", F.lit(0.55)).alias("confidence"), F.coalesce(reject_reason(F.col("understanding")), F.when(F.size("anchors") == 0, "no_anchor")).alias("reject_reason"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
