"""Folders for what a job writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import StoreError


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where all runs in one process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="evidenza-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder, removed when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(clear)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to a folder of its own and read back, where several parts of a plan need it."""
    path, schema = workspace(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `_rank`, their number from 0 in the given order (in the order they stand, without one).

    They are sorted by ranges and written once with their place in their range, so that what is computed again after a
    lost executor cannot number them otherwise; the ranges' counts, one row each, give the rest. No task holds them all.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    path, schema = workspace(rows.sparkSession, "ranked"), T.StructType([*rows.schema.fields, T.StructField("_id", T.LongType())])
    placed.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.schema(schema).parquet(path).withColumn("_p", F.shiftright("_id", 33))
    parts = held.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(shift), "_p").withColumn("_rank", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_id", "_before")
