"""Intervals of months: unions, overlaps, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, key: str, start: str = "start", end: str = "end", whole: bool = True) -> DataFrame:
    """Unions of each key's intervals; ends in the month before a start are adjacent and join.

    Ends before starts are turned round; rows without a start or an end are left out. Without
    ``whole`` rows are taken as they are, and those that lack a start or an end come last.
    """
    s, e = (F.least(start, end), F.greatest(start, end)) if whole else (F.col(start), F.col(end))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    if whole:
        rows = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.select(key, s.alias("s"), e.alias("e"))
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", (reach.isNull() | F.coalesce(F.col("s") > reach + 1, F.lit(False))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "__run").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("__run")


def union_months(rows: DataFrame, key: str, start: str = "start", end: str = "end", whole: bool = True) -> DataFrame:
    """months: total of the union; years: rounded half to even, one at least."""
    total = merged(rows, key, start, end, whole).groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("months"))
    return total.withColumn("years", F.greatest(F.lit(1), F.bround(F.col("months") / 12).cast("long")))


def overlapping(rows: DataFrame, key: str, order: str, start: str = "start", end: str = "end", window: int = 12) -> DataFrame:
    """Pairs of a key's intervals, first < second by ``order``, that share a month.

    Rows meet only in ``window``-month slots that both touch, and a pair comes from the
    first slot that both have: an equi-join that a long history does not make quadratic
    unless its intervals truly overlap.
    """
    slot = F.explode(F.sequence(F.floor(F.col(start) / window), F.floor(F.col(end) / window))).alias("__slot")
    r = rows.where(F.col(start) <= F.col(end)).select(key, order, start, end, slot)
    a, b = r.alias("a"), r.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__slot") == F.col("b.__slot")) & (F.col(f"a.{order}") < F.col(f"b.{order}"))
    shared = (F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}"))
    first = F.col("a.__slot") == F.floor(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) / window)
    out = a.join(b, hit).where(shared & first)
    months = F.least(F.col(f"a.{end}"), F.col(f"b.{end}")) - F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) + 1
    return out.select(F.col(f"a.{key}").alias(key), F.col(f"a.{order}").alias("first"), F.col(f"b.{order}").alias("second"), months.cast("long").alias("months"))


def out_of_order(rows: DataFrame, key: str, order: str, start: str = "start") -> DataFrame:
    """Neighbours by ``order`` of which the first starts before the second; newest should be first."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = rows.withColumn("next", F.lead(order).over(w)).withColumn("__next_start", F.lead(start).over(w))
    return nxt.where(F.col(start) < F.col("__next_start")).select(key, F.col(order).alias("first"), F.col("next").alias("second"))


def newest_first(rows: DataFrame, key: str, order: str, start: str = "start") -> DataFrame:
    """``rank`` from 1 by start, latest first, then by ``order``; rows without a start last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(start).desc_nulls_last(), order)))


def counts_for_tenure(identity: Column, markers: tuple[str, ...]) -> Column:
    """Whether none of the markers occurs in the record's names."""
    low = F.lower(F.coalesce(identity, F.lit("")))
    return ~F.exists(F.array(*map(F.lit, markers)), lambda m: low.contains(m))
