"""Versioned documents, traces and plain-text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a trace whose values are never written.
SECRET = "(?i)(key|token|secret|password|authorization)"


def next_versions(existing: DataFrame, changes: DataFrame, key: str = "draft_id") -> DataFrame:
    """``changes`` with the version that follows the latest of their key; 1 for a new key."""
    last = existing.groupBy(key).agg(F.max("version").alias("__last"))
    return changes.join(last, key, "left").withColumn("version", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def append_versions(spark: SparkSession, path: str, changes: DataFrame, key: str = "draft_id") -> None:
    """Appends to the table of versions under ``path``; Spark's committer publishes all rows or none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        changes = next_versions(spark.read.parquet(path), changes, key)
    else:
        changes = changes.withColumn("version", F.lit(1))
    changes.write.mode("append").parquet(path)


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key: a partial aggregate, no sort."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def trace_json(fields: Column) -> Column:
    """A map of fields as one line of JSON, secrets masked."""
    return F.to_json(F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"], F.when(e["key"].rlike(SECRET), "[REDACTED]").otherwise(e["value"])))))


def expired(files: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Files (path, modificationTime) older than their time to live; deleting them is the caller's act."""
    return files.where(F.col("modificationTime") < now - F.make_interval(secs=F.lit(ttl_seconds))).select("path")


def record_text(title: Column, sections: Column) -> Column:
    """A record (title, array of (heading, lines)) as plain text in the given order."""
    shown = F.transform(F.filter(sections, lambda s: F.size(s["lines"]) > 0), lambda s: F.concat(s["heading"], F.lit("\n"), F.array_join(F.transform(s["lines"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.array_join(shown, "\n\n"))
