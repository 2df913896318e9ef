"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_setting = threading.RLock()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without one a temporary folder, but only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="recollect-")
    return _local[app]


class Scratch:
    """Writes a plan once and reads it back, which cuts its lineage: a lost executor costs a reread, not a recomputation.

    Tables go when the application ends (Hadoop's deleteOnExit), or earlier by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._path(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
        """df as a written table; batch_bytes bounds what Python workers get at once, where rows are whole texts.

        The bound is a setting of the session, so writes that set it take turns; another query that is planned
        meanwhile gets smaller batches too, which changes no result.
        """
        where = f"{self.root}/{name}"
        if batch_bytes is None:
            df.write.mode("overwrite").parquet(where)
        else:
            with _setting:
                before = self.spark.conf.get(BATCH)
                self.spark.conf.set(BATCH, batch_bytes)
                try:
                    df.write.mode("overwrite").parquet(where)
                finally:
                    self.spark.conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def settle(self) -> None:
        """Let go what was shuffled for the tables that are written: Spark deletes it when the driver collects its garbage."""
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)
