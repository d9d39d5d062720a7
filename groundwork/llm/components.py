"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each step's result is a written table. The minima that a step
joins back are tables of one row a node, so adaptive execution can split a hot node's
edges. Steps repeat until the edges no longer change: O(log^2 n) times at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): component is the smallest node reachable.

    Nodes without an edge to another node are absent. Nulls and loops are ignored,
    repeated edges count once, and an empty table gives an empty table.
    """
    spark = edges.sparkSession
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{folder}/edges",
    )
    mark, step, last = _mark(e), 0, f"{folder}/edges"
    while True:
        here = f"{folder}/step{step}"
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), f"{here}/low")
        big = written(
            both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            f"{here}/large",
        )
        low = written(big.groupBy("u").agg(F.min("v").alias("m")), f"{here}/low2")
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{here}/small")
        was, mark = mark, _mark(e)
        removed(spark, last)
        for part in ("low", "large", "low2"):
            removed(spark, f"{here}/{part}")
        last, step = f"{here}/small", step + 1
        if mark == was:
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
