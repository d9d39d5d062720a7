"""Alignment with requirements, ranking, audit scores and roll-ups."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X


def alignment(rows: DataFrame, requirement: str, text: str, shown: int = 15) -> DataFrame:
    """``rows`` with matched, missing (``shown`` at most) and coverage, the percentage of keywords found."""
    words, low = X.keywords(F.col(requirement)), F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("__w", words).withColumn("__l", low)
    hit = F.filter("__w", lambda w: F.col("__l").contains(F.lower(w)))
    miss = F.filter("__w", lambda w: ~F.col("__l").contains(F.lower(w)))
    share = F.when(F.size("__w") == 0, 0).otherwise(F.bround(100.0 * F.size(hit) / F.greatest(F.size("__w"), F.lit(1)))).cast("long")
    return rows.withColumn("matched", F.slice(hit, 1, shown)).withColumn("missing", F.slice(miss, 1, shown)).withColumn("coverage", share).drop("__w", "__l")


def bullet_density(x: Column) -> Column:
    """Evidence in a bullet: change, result, numbers, percentages, money, several numbers."""
    t = F.coalesce(x, F.lit(""))
    has = lambda p: F.when(t.rlike(p), 1).otherwise(0)
    change, result = X.metric_strength(t) == "strong", t.rlike(f"{L.RESULTS}|(?i)improved|reduced|increased|achieved|delivered")
    many = F.size(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))) >= 2
    return F.when(change, 4).otherwise(0) + F.when(result, 2).otherwise(0) + has("[0-9]") + 3 * has(r"[0-9]+(?:\.[0-9]+)?\s*%") + 3 * has(r"[0-9]+(?:\.[0-9]+)?\s*(?:万|亿)?元") + F.when(many, 2).otherwise(0)


def ranked_bullets(rows: DataFrame, key: str, pos: str, value: str, target: Column, top: int | None = None) -> DataFrame:
    """``rank`` from 1: overlap with the target plus three times the density, then density, overlap, length; stable."""
    plain = lambda x: X.let(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""), lambda t: X.grams(t, 2))
    rows = rows.withColumn("density", bullet_density(F.col(value)).cast("long")).withColumn("overlap", F.when(F.coalesce(target, F.lit("")) == "", 0).otherwise(F.size(F.array_intersect(plain(F.col(value)), plain(target)))).cast("long"))
    order = [(F.col("overlap") + 3 * F.col("density")).desc(), F.col("density").desc(), F.col("overlap").desc(), F.least(F.length(value), F.lit(120)).desc(), F.col(pos)]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    return rows if top is None else rows.where(F.col("rank") <= top)


def vote(rows: DataFrame, lexicon: dict[str, tuple[str, ...]], *texts: str, strong: dict[str, tuple[str, ...]] | None = None, other: str = "other", last: float = 1.0) -> DataFrame:
    """``label`` and ``votes``: the class with most of its words in the texts; first class on ties, else ``other``.

    Strong words count two and a half times; the last of several texts ``last`` times.
    """
    low = [(F.lower(F.coalesce(F.col(t), F.lit(""))), last if len(texts) > 1 and t == texts[-1] else 1.0) for t in texts]
    hits = lambda words: sum((F.when(t.contains(w.lower()), weight).otherwise(0.0) for w in words for t, weight in low), F.lit(0.0))
    scores = F.array(*[F.struct((hits(words) + 2.5 * hits((strong or {}).get(name, ()))).alias("v"), F.lit(-i).alias("i"), F.lit(name).alias("n")) for i, (name, words) in enumerate(lexicon.items())])
    best = F.array_max("__scores")
    rows = rows.withColumn("__scores", scores)
    return rows.withColumn("label", F.when(best["v"] > 0, best["n"]).otherwise(other)).withColumn("votes", best["v"]).drop("__scores")


def audit_score(rows: DataFrame, base: Column, high: Column, medium: Column, low: Column, model: Column | None = None) -> DataFrame:
    """``score``: mean and model score blended, less the weight of issues, under the caps for many or grave issues."""
    clamp = lambda x: F.bround(F.least(F.lit(10.0), F.greatest(F.lit(1.0), x)), 1)
    b = clamp(base)
    blended = clamp(b * 0.75 + (clamp(model) if model is not None else b) * 0.25)
    n = high + medium + low
    cap = F.least(F.when(high >= 2, 7.6).when(high == 1, 8.2).when(medium >= 5, 8.4).otherwise(10.0), F.when(n >= 6, 7.8).when(n >= 4, 8.6).otherwise(10.0))
    weight = high * L.SEVERITY_WEIGHT["high"] + medium * L.SEVERITY_WEIGHT["medium"] + low * L.SEVERITY_WEIGHT["low"]
    return rows.withColumn("score", F.least(clamp(blended - weight * 0.2), cap))


def issue_list(rows: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """Issues (key, pos, project, bullet_index, dimension, severity, problem): distinct, grave first, ``limit`` a key."""
    dim = F.when(F.col("dimension").isin(*L.AUDIT_DIMENSIONS), F.col("dimension")).otherwise("technical_depth")
    sev = F.when(F.lower("severity").isin(*L.SEVERITY_ORDER), F.lower("severity")).otherwise("medium")
    rows = rows.withColumn("dimension", dim).withColumn("severity", sev)
    one = Window.partitionBy(key, "project", "bullet_index", "dimension", "problem").orderBy("pos")
    rows = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    order = F.element_at(F.create_map(*[F.lit(x) for kv in L.SEVERITY_ORDER.items() for x in kv]), F.col("severity"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order, "project", "bullet_index", "pos"))).where(F.col("rank") <= limit)


def bullet_signals(rows: DataFrame, value: str) -> DataFrame:
    """Whether a bullet tells action, result, context, a metric and something specific."""
    t = F.coalesce(F.col(value), F.lit(""))
    specific = t.rlike(r"[A-Z][A-Za-z0-9_+./-]{3,}") | t.rlike(f"[\\x{{4e00}}-\\x{{9fff}}]{{2,}}(?:{L.SPECIFIC_NOUNS})")
    return rows.withColumns({"action": t.rlike(L.ACTIONS), "result": t.rlike(L.RESULTS), "context": t.rlike(L.CONTEXTS), "metric": t.rlike(rf"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:{L.SCORE_UNITS}|万元|客户|学生|病例)"), "specific": specific})


def expression_score(signals: DataFrame, key: str) -> DataFrame:
    """Up to 20 points for action, result and context, up to 20 for metrics and specifics, by share of bullets."""
    n = lambda *cs: sum((F.sum(F.col(c).cast("int")) for c in cs), F.lit(0))
    star = F.least(F.lit(20.0), n("action", "result", "context") / (F.count("*") * 3) * 20.0)
    traced = F.least(F.lit(20.0), n("metric", "specific") / (F.count("*") * 2) * 20.0)
    return signals.groupBy(key).agg(F.bround(star + traced, 1).alias("expression"))


def completeness_score(hard: Column, soft: Column, conflicts: Column) -> Column:
    """30 points less 4 for each hard gap, 2 for each soft one, and 2 for each conflict up to 6."""
    return F.greatest(F.lit(0.0), F.least(F.lit(30.0), 30.0 - 4.0 * hard - 2.0 * soft - F.least(F.lit(6.0), 2.0 * conflicts)))


def total_score(fabricated: Column, *parts: Column) -> Column:
    """The parts' sum within 0 and 100; zero if anything is fabricated."""
    return F.when(fabricated, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(sum(parts, F.lit(0.0)), 1))))


def shrunk(source_len: Column, now_len: Column, least_source: int = 200) -> Column:
    """Whether a candidate lost too much text: at most 35 % of a source of ``least_source`` characters, or 120.

    The share is a decimal: in binary 35 % of 360 falls short of 126.
    """
    return (source_len >= least_source) & (now_len <= F.greatest(F.lit(120), F.floor(source_len * F.lit(Decimal("0.35")))))


def rollup(rows: DataFrame, group: list[str], usable: Column) -> DataFrame:
    """Counts and usable rate by group, with the grand total where the group is null."""
    return rows.rollup(*group).agg(F.count("*").alias("n"), F.bround(F.avg(usable.cast("int")), 4).alias("usable_rate"))
