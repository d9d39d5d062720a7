"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every document's size (words) is counted and written; sources are summed.
2. Targets are the sources' weighted shares, stopped at twice a source's size.
3. Blocks of ``block`` words go to sources by the highest quotients v / (2k - 1), and a
   source's blocks to its shards in the same way by their sizes: integer quotas.
   Shards are hash parts of a source with about sqrt(documents) rows, so a hot source
   is many groups, not one.
4. Within a shard, documents lie in seeded order and the quota takes whole rounds of
   the shard, then the first blocks of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: A shard's documents: at least so many, or the square root of its source's documents.
SHARD_ROWS = 512


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = 150, cap: int = 2) -> DataFrame:
    """``sources`` (src, source_size, docs) with ``target`` (double).

    Sorted by cap / weight, the sources that stop at their cap are a prefix, so one
    running sum finds the level that all others share. Works on one row a source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = every.orderBy(F.col("most") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("weight").over(every))
    s = s.withColumn("before", F.sum("most").over(order) - F.col("most")).withColumn("w_left", F.col("all_w") - F.sum("weight").over(order) + F.col("weight"))
    # Twice the words still to share; integers, so that nothing is rounded before the last division.
    s = s.withColumn("left2", F.col("total") * share_percent - F.col("before") * 100)
    big = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products of longs may not fit a long
    s = s.withColumn("full", big("most") * 100 * F.col("w_left") <= big("left2") * F.col("weight"))
    s = s.withColumn("kept_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every))
    s = s.withColumn("rest", F.col("total") * share_percent - F.sum(F.when(F.col("full"), F.col("most") * 100).otherwise(0)).over(every))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise((big("rest") * F.col("weight")).cast("double") / (100.0 * F.col("kept_w")))
    return s.withColumn("target", target).select("src", "source_size", "docs", "target")


def apportion(parties: DataFrame, votes: str, seats: Column, within: list[str], name: list[str]) -> DataFrame:
    """``parties`` with ``quota`` (long): ``seats`` dealt by Sainte-Lague in each ``within`` group.

    A divisor above V / (2H - n) gives no party too many seats and one below
    V / (2H + n) gives enough in all; only the about 2n quotients between them are
    sorted. Ties go to the first by ``name``. Parties without votes get none.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v, h = F.col(votes).cast("double"), F.col("_h")
    p = parties.withColumn("_h", seats.cast("long"))
    p = p.withColumn("_v", F.sum(v).over(group)).withColumn("_n", F.count(F.when(v > 0, 1)).over(group))
    sure = F.when((2 * h > F.col("_n")) & (v > 0), F.greatest(F.floor(v * (2 * h - F.col("_n")) / (2 * F.col("_v")) * (1 - 1e-12) + 0.5 - 1e-9), F.lit(0))).otherwise(0).cast("long")
    most = F.when(v > 0, F.floor(v * (2 * h + F.col("_n")) / (2 * F.col("_v")) * (1 + 1e-12) + 0.5 + 1e-9)).otherwise(0).cast("long")
    p = p.withColumn("_sure", sure).withColumn("_most", F.when(h > 0, most).otherwise(0)).withColumn("_open", h - F.sum("_sure").over(group))
    q = p.where("_most > _sure").select(*within, *name, "_open", v.alias("_votes"), F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    best = group.orderBy((F.col("_votes") / (2 * F.col("_k") - 1)).desc(), *name, "_k")
    won = q.withColumn("_r", F.row_number().over(best)).where("_r <= _open").groupBy(*within, *name).agg(F.count("*").alias("_won"))
    out = p.join(won, [*within, *name], "left").withColumn("quota", F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0)))
    return out.select(*parties.columns, "quota")


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = 150, cap: int = 2, block: int = 32, seed: int = 42, carried: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source) to doc_id, size, source_size, target, taken.

    A null or empty text has size 0 and takes 0; a null source is a source of its own,
    last. Repeated rows are documents of their own (ties in the seeded order go by
    size, so equal rows may swap but the result does not change). An empty table gives
    an empty table. ``taken`` never exceeds ``cap`` times the size. Sources, one row
    each after the sums, are ranked in one task; documents never are. ``carried``: further
    columns of ``docs``, narrow ones, to bring along.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    src = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    sized = written(docs.select("doc_id", *carried, src.alias("src"), n_words(F.col("text")).alias("size")), f"{folder}/sized")
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = written(targets(sources, weights, share_percent, cap), f"{folder}/targets")
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5)
    sources = apportion(sources, "target", seats, [], ["src"]).withColumnRenamed("quota", "blocks")
    parts = F.ceil(F.col("docs") / F.greatest(F.lit(SHARD_ROWS), F.floor(F.sqrt("docs")))).cast("long")
    sources = written(sources.withColumn("parts", parts), f"{folder}/sources")
    key = _seeded(F.col("doc_id"), seed)
    rows = sized.join(sources.select("src", "parts"), "src").withColumn("key", key)
    rows = rows.withColumn("part", F.conv(F.substring("key", 1, 15), 16, 10).cast("long") % F.col("parts"))
    rows = written(rows.select("doc_id", *carried, "src", "size", "key", "part"), f"{folder}/rows")
    shards = rows.groupBy("src", "part").agg(F.sum("size").alias("part_size")).join(sources, "src")
    shards = apportion(shards, "part_size", F.col("blocks"), ["src"], ["part"])
    words = F.least(F.col("quota") * block, F.col("part_size") * cap)
    shards = written(shards.select("src", "part", "part_size", "source_size", "target", words.alias("quota_words")), f"{folder}/shards")
    order = Window.partitionBy("src", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.withColumn("before", F.sum("size").over(order) - F.col("size")).join(shards, ["src", "part"])
    rounds = F.when(F.col("part_size") > 0, F.floor(F.col("quota_words") / F.col("part_size"))).otherwise(0).cast("long")
    last = F.least(F.greatest(F.col("quota_words") - rounds * F.col("part_size") - F.col("before"), F.lit(0)), F.col("size"))
    return dealt.select("doc_id", *carried, "size", "source_size", "target", (rounds * F.col("size") + last).cast("long").alias("taken"))
