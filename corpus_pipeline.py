"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage is written as Parquet and read back before the next, so a lost executor
costs at most part of one stage. All stages but the last return the columns of
documents. Null and empty texts: rejected by the first stage, and each other stage takes
them as texts without words. Repeated rows: the second stage keeps one document of each
group of near copies, whichever repeats hold it. Empty tables give empty tables. Columns beyond those of documents are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import bpe, mixing, pii, quality_model, simhash
from groundwork.llm.common import WORD, removed, scratch, table, written
from groundwork.llm.queries import byte_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    judged = quality_model.quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), with_text=True)
    return judged.where("kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of least id, and of its texts the least by hash.

    Documents are told apart by id and text, so rows without an id and texts that share
    one are judged each for itself; rows with an id go before rows without. Of rows
    equal in both, the least by the other columns stays.
    """
    folder = scratch(spark)
    docs = docs.select(*COLUMNS)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = written(simhash.simhash_groups(docs.select(name.alias("doc_id"), "text")).select("doc_id.*", "kept"), f"{folder}/groups")
    names = ["id", "hash"]
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    gone = written(groups.where("not kept").select(*names).distinct(), f"{folder}/gone")
    # Only names travel: few are looked up in a broadcast, if Spark finds them small; else the texts are dealt once.
    kept = docs.join(gone, same, "left_anti")
    often = written(groups.where("kept").groupBy(*names).count().where("count > 1").select(*names), f"{folder}/often")
    if often.limit(1).count():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        least = F.min(F.struct(*rest)).alias("row")
        once = kept.join(often, same, "left_semi").groupBy("doc_id", "text").agg(least).select("doc_id", "text", "row.*").select(*COLUMNS)
        kept = kept.join(often, same, "left_anti").unionByName(once)
    return kept


def no_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    changed = pii.pseudonymised(docs.select(*COLUMNS), pii.secret_key(spark))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents as the mix takes their words.

    A document comes out once for each whole time that it is taken. Where a shard's
    quota ends within a document, that document's last row has the words taken of it.
    Rows of equal id and text are one document, taken as often as all of them.
    """
    folder = scratch(spark)
    docs = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text", "source"))
    taken = written(mixing.mix(docs, carried=("__key",)), f"{folder}/mixed")
    taken = taken.groupBy(F.col("__key").alias("__k")).agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
    taken = written(taken.where("taken > 0"), f"{folder}/taken")
    if taken.where("rows > 1").limit(1).count():
        docs = docs.dropDuplicates(["__key"])
    rows = docs.join(taken, F.col("__key") == F.col("__k"))
    copy = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("__copy")
    rows = rows.select("*", copy).withColumn("__words", F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size")))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    text = F.when(F.col("__words") == F.col("size"), F.col("text")).otherwise(words)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the ids of the text, and whether they decode to its bytes."""
    rows = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), byte_codec())
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")



STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", one_of_each),
    ("pii surrogates", no_pii),
    ("source mix", mixed),
    ("byte-level bpe", encoded),
]

#: The stages use trained models, fingerprints and merges: no SQL. The tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/stage{k}")
        if 1 <= k < len(STAGES) - 1:  # what this stage read is read by nothing more, and may hold personal data
            removed(spark, f"{folder}/stage{k - 1}")
    return docs
