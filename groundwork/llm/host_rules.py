"""Quality rules, and the verdict of a document's host upon it.

Each document's measures are computed once, in SQL functions, and written. Failures of
the base rule are summed by host; every host's rate is shrunk towards the corpus rate
by a beta prior fitted to the hosts' rates by moments; a host whose shrunk rate is too
high rejects its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, scratch, written

SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as a repeat.
WINDOW = 5


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text.

    Windows are compared by the chained 64-bit hash of their words. Texts without a
    repeated hash, nearly all, end at the distinct count; the others sort (hash, place)
    and add up the places that repeated windows cover.
    """
    n = F.size(words)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        places = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"])))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n <= window, F.lit(0)).otherwise(let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def measures(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the ``carried`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null text measures as an empty one: all zero.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *carried, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = let(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return base.select(
        "doc_id",
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        let(F.col("words"), lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
    )


def failed(least_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by moments of ``hosts`` (host_docs, host_failed): one row of sums.

    The hosts' variance about the corpus rate, less what sampling explains, gives the
    prior's weight, kept between 1 and 10,000 documents.
    """
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    got = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count("*").alias("h")).first()
    if not got["h"]:
        return 1.0, 1.0
    m = min(max(got["f"] / got["n"], 1e-6), 1 - 1e-6)
    spread = max(got["ff"] - got["n"] * m * m, 0.0) - (got["h"] - 1) * m * (1 - m)  # weighted squares beyond sampling
    between = spread / max(got["n"], 1.0)
    weight = 1e4 if between <= 0 else min(max(m * (1 - m) / between - 1, 1.0), 1e4)
    return m * weight, (1 - m) * weight


def host_rules(docs: DataFrame, host: str = "source", most_failed: float = 0.5, **rule) -> DataFrame:
    """``docs`` (doc_id, text, host) to the measures, base_failed, host_rate and kept.

    A null host is a host of its own. Repeated rows count as documents of their own.
    An empty table gives an empty table. ``kept`` is false where the base rule failed
    or the host's shrunk rate of failures is above ``most_failed``.
    """
    folder = scratch(docs.sparkSession)
    src = F.coalesce(F.concat(F.lit("a"), F.col(host).cast("string")), F.lit("b"))
    rows = measures(docs.select("doc_id", "text", src.alias("__host")), "__host").withColumn("base_failed", failed(**rule))
    rows = written(rows, f"{folder}/measures")
    hosts = written(rows.groupBy("__host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), f"{folder}/hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failed") + alpha) / (F.col("host_docs") + alpha + beta)
    out = rows.join(hosts, "__host").withColumn("host_rate", rate)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most_failed)).drop("__host", "host_docs", "host_failed")
