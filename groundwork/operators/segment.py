"""From texts to ordered pieces with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare_form, let

#: Lengths that are summed up at a time.
RUN = 256
#: What ends a sentence, and what separates items in one.
SENTENCE, ITEM = r"[。；;！？!?\r\n]+", r"[，,、]+"


def _starts(lengths: Column) -> Column:
    """Running totals before each length. Arrays grow by copies, so they grow in runs of RUN, and runs are put together once."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    totals = lambda n: F.aggregate(n, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda b: totals(F.slice(lengths, b * RUN + 1, F.lit(RUN))))

    def together(rs: Column) -> Column:
        before = totals(F.transform(rs, lambda r: r["at"]))["all"]
        return let(before, lambda at: F.flatten(F.transform(rs, lambda r, i: F.transform(r["all"], lambda x: x + F.get(at, i)))))

    return let(runs, together)


def _pieces(text: Column, cut: str) -> Column:
    """array of (start, piece): code points from 0, pieces between matches of ``cut``."""
    parts = F.split(text, cut, -1)
    seps = F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    lengths = lambda p, s: F.transform(p, lambda x, i: F.length(x) + F.coalesce(F.length(F.get(s, i)), F.lit(0)))
    return let(F.struct(parts.alias("p"), seps.alias("s")), lambda v: F.arrays_zip(let(lengths(v["p"], v["s"]), _starts).alias("start"), v["p"].alias("piece")))


def pieces(docs: DataFrame, cut: str, id_col: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """``docs`` to (id, pos, start, end, piece): stripped pieces of ``least`` characters or more.

    substring(text, start + 1, end - start) = piece for every row. Stays within each
    row: no shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(id_col, F.posexplode(_pieces(t, cut)).alias("at", "x")).select(id_col, "at", F.col("x.start").alias("s"), F.col("x.piece").alias("raw"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^[ \t\r\n\f]+", ""))
    rows = rows.select(id_col, "at", (F.col("s") + lead).alias("start"), F.regexp_replace("raw", r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "").alias("piece"))
    rows = rows.where(F.length("piece") >= least)
    return rows.select(id_col, F.col("at").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("piece")).cast("long").alias("end"), "piece")


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Physical lines, stripped, with offsets; blank ones are left out."""
    return pieces(docs, r"[\r\n]", id_col, text)


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    return pieces(docs, SENTENCE, id_col, text, least)


def dedup_consecutive(rows: DataFrame, id_col: str = "doc_id", pos: str = "pos", value: str = "piece") -> DataFrame:
    """Drops a row equal to the one before it in its document."""
    w = Window.partitionBy(id_col).orderBy(pos)
    return rows.withColumn("__was", F.lag(value).over(w)).where(F.col("__was").isNull() | (F.col("__was") != F.col(value))).drop("__was")


def carry_heading(rows: DataFrame, is_heading: Column, id_col: str = "doc_id", pos: str = "pos", value: str = "piece") -> DataFrame:
    """As-of: ``heading``, the nearest heading at or before each row, else the document's first one."""
    w = Window.partitionBy(id_col).orderBy(pos)
    nearest = F.last(F.when(is_heading, F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first(F.when(is_heading, F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("heading", F.coalesce(nearest, first))


def islands(rows: DataFrame, starts: Column, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``record``: number of rows that start a record, up to each row; 0 before the first."""
    w = Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def coalesce_wrapped(rows: DataFrame, continues: Column, id_col: str = "doc_id", pos: str = "pos", value: str = "piece") -> DataFrame:
    """Joins each row that continues the one before into it, in order."""
    marked = islands(rows, ~continues, id_col, pos)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]), " ")
    return marked.groupBy(id_col, "record").agg(F.min(pos).alias(pos), joined.alias(value)).drop("record")


def under_budget(rows: DataFrame, budget: int, id_col: str = "doc_id", pos: str = "pos", value: str = "piece") -> DataFrame:
    """The first rows of each document of which the lengths sum to ``budget`` at most."""
    w = Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.length(value)).over(w).cast("long")).where(F.col("used") <= budget)


def dedup_first(rows: DataFrame, key: Column, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Keeps the first row of each key in each document."""
    w = Window.partitionBy(id_col, "__key").orderBy(pos)
    return rows.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def normal_lines(docs: DataFrame) -> DataFrame:
    """Lines with their compare form."""
    return lines(docs).withColumn("norm", compare_form(F.col("piece")))
