"""Before and after: what a rewrite may not change."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words that claim a level of ownership, highest first.
OWNERSHIP = ((3, "主导|负责人|牵头|独立负责|全面负责|led|headed|owned"), (2, "负责|管理|设计|开发|实现|组织|构建|built|designed|developed|managed"), (1, "参与|协助|支持|配合|assisted|supported|participated"))


def ownership_level(x: Column) -> Column:
    """3 led, 2 did, 1 helped, 0 nothing said."""
    out = F.lit(0)
    for level, words in reversed(OWNERSHIP):
        out = F.when(F.coalesce(x, F.lit("")).rlike(f"(?i){words}"), level).otherwise(out)
    return out


def number_counts(x: Column) -> Column:
    """Numbers with units as a sorted multiset."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?\s*(?:%|[A-Za-z]{1,4}|[\x{4e00}-\x{9fff}])?"), F.lit(0)), X.match_form))


def likeness(a: Column, b: Column) -> Column:
    """difflib's ratio: no edit distance gives the same."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)


def is_trivial(before: Column, after: Column) -> Column:
    """Whether a rewrite changes wording only: equal plain forms, or alike without a new number."""
    same = X.evidence_form(before) == X.evidence_form(after)
    return same | ((likeness(before, after) >= 0.88) & (F.size(F.array_except(number_counts(after), number_counts(before))) == 0))


def diagnostics(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``reasons``: why an after text may not stand for its before text; empty if it may."""
    b, a = F.coalesce(F.col(before), F.lit("")), F.coalesce(F.col(after), F.lit(""))
    latin = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9+.#/_-]+"), F.lit(0)), F.lower))
    rules = {
        "empty": a == "",
        "ownership_raised": ownership_level(a) > ownership_level(b),
        "shrunk": (F.length(b) >= 20) & (F.length(a) < F.greatest(F.lit(12), F.floor(F.length(b) * 0.58))),
        "new_number": F.size(F.array_except(F.array_distinct(number_counts(a)), number_counts(b))) > 0,
        "new_name": F.size(F.array_except(latin(a), latin(b))) > 0,
    }
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


def guarded(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``accepted``: the after text if no rule objects, else the before text."""
    return diagnostics(rows, before, after).withColumn("accepted", F.when(F.size("reasons") == 0, F.col(after)).otherwise(F.col(before)))


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Change log of two tables of values: clear, remove, add or replace by key; equal compare forms are no change."""
    j = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys, "full")
    action = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").when(X.strip(F.col("after")) == "", "clear").otherwise("replace")
    return j.withColumn("action", action).where(~X.compare_form(F.col("before")).eqNullSafe(X.compare_form(F.col("after"))) | (F.col("action").isin("add", "remove")))
