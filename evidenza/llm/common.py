"""Helpers shared by the text and vector operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch may hold, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one if all runs in one process (tests), else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidenza-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run within go as these end.

    Otherwise they stay until the driver happens to collect its garbage, and those of many steps add up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    Intermediate tables can be dropped as soon as nothing lazy reads them; the rest go when the
    interpreter ends. The shuffle files of writing a table go as it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/evidenza-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Write `df` once and return the table read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        with brief_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._evidenza_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._evidenza_path)


def once(udf):
    """Evaluate a costly function once for each row: the optimizer copies only deterministic ones into filters."""
    return udf.asNondeterministic()


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
