"""Shared pieces: tables, the shared scratch folder, written stages, numbering, batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for every contract that counts words: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"

_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing and the master is plain ``local``, a folder of this
    process stands in; on a cluster a missing setting is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="groundwork-")
            atexit.register(shutil.rmtree, _local_root, True)
        root = _local_root
    return f"{root.rstrip('/')}/groundwork-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts lineage, survives lost executors, computes once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Arrow batches of few rows: texts may be long, and Python workers have little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it many times."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *order: Column, path: str) -> DataFrame:
    """Adds ``rank`` from 0 in the given order, without bringing the rows to one task.

    Rows are sorted by ranges and written with their partition and place in it; the
    partitions' sizes, one row each, give the offsets.
    """
    place = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_pos", T.LongType())])
    rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    rows.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(place).parquet(path)
    sizes = rows.groupBy("_pid").agg(F.count("*").alias("_n")).collect()  # one row a partition
    starts, at = {}, 0
    for pid, n in sorted((r["_pid"], r["_n"]) for r in sizes):
        starts[pid] = at
        at += n
    if not starts:
        return rows.withColumn("rank", F.lit(0).cast("long")).drop("_pid", "_pos")
    offsets = df.sparkSession.createDataFrame(sorted(starts.items()), "_pid int, _start long")
    return rows.join(F.broadcast(offsets), "_pid").withColumn("rank", F.col("_start") + F.col("_pos")).drop("_pid", "_pos", "_start")


def tidy() -> None:
    """Gives freed memory of this Python worker back: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function over batches that leaves no freed memory behind."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]

