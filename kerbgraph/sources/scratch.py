"""Tables of intermediate results in the folder that all executors share, and their end."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rounds of a loop after which the shuffle files of earlier ones are let go.
ROUNDS = 6


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), a new folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = context.get() if context.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, safe from lost executors, with a short lineage. The table goes when
    the application ends; use Tables for those that nobody reads later."""
    spark = df.sparkSession
    where = f"{folder(spark)}/kerbgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, files = _path(spark, where)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


class Tables:
    """The intermediate tables of one job. Each is deleted by `drop` or at the end of the block, so that disk holds what is still read
    and no more. What the block returns must be written by `written`, which outlives it.

    At the end the driver's garbage goes too: only then does Spark let go of the shuffle files of jobs that are over.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{folder(spark)}/kerbgraph/job-{uuid.uuid4().hex}", {}
        self.made = self.rounds = 0

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`. Of an earlier table of the same name nothing is deleted: df may read it."""
        self.made += 1
        where = f"{self.root}/{name}-{self.made}"
        df.write.parquet(where)
        self.paths[where] = name
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for where, name in list(self.paths.items()):
            if name in names:
                path, files = _path(self.spark, where)
                files.delete(path, True)
                del self.paths[where]

    def keep_last(self, *names: str) -> None:
        """Delete all but the newest table of each name. Loops end their rounds by it, so every few rounds the shuffle files of those that are
        over go, too."""
        for name in names:
            for where in [w for w, n in self.paths.items() if n == name][:-1]:
                path, files = _path(self.spark, where)
                files.delete(path, True)
                del self.paths[where]
        self.rounds += 1
        if self.rounds % ROUNDS == 0:
            release(self.spark)

    def __exit__(self, *error: object) -> None:
        path, files = _path(self.spark, self.root)
        files.delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let go of DataFrames that nobody holds, and with them of their shuffle files and broadcasts."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
