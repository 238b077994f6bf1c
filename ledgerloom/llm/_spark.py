"""Small helpers around the Spark session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.session import shared_folder

#: A side of a join is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers what Spark hands to Python at a time, for the session: a batch of texts then has some megabytes, whatever
    their lengths, on either side."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that nothing behind it runs again."""
    shared_folder(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job, written to the shared checkpoint folder: what reads them doesn't run again what made them, and an
    executor's loss costs nothing. They are dropped as soon as their successors are written."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, table in self.paths.items():
            if any(table is t for t in tables):
                self._delete(path)

    def drop_all(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when that action ends; for jobs of several passes that cut() joins."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
