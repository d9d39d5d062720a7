"""Token counts through a cache of digests.

Contents are known by the SHA-256 of their normal form, tokenizers by a digest of their
file. Narrow rows (digest, doc_id) are joined to the stored counts; one document of each
missing digest is encoded, whole; the new counts are appended to the cache and all
documents read theirs from it. The normal form is the tokenizer's own: where its first
step rewrites texts (case, white space), texts that it makes equal share a count.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch, small_batches, texts, written

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
_loaded: dict[str, object] = {}


class Tokenizer:
    """The library's counts for a vocabulary file: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        self.version = hashlib.sha256(self.kind.encode() + self.data).hexdigest()[:32]
        parsed = json.loads(self.data) if self.kind == "tokenizers" else {}
        self.rewrites = parsed.get("normalizer") is not None
        self.marks = [t["content"] for t in parsed.get("added_tokens") or []]

    def normal_form(self):
        """A function from a text to what its digest is taken of; equal results mean equal counts.

        Strings that the library looks for before it rewrites anything keep a text as it is.
        """
        import tokenizers

        rewrite = tokenizers.Tokenizer.from_str(self.data.decode()).normalizer.normalize_str
        return lambda text: "r" + text if any(m in text for m in self.marks) else "n" + rewrite(text)

    def counter(self):
        if self.version not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            if self.kind == "sentencepiece":
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
                _loaded[self.version] = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
            else:
                import tokenizers

                model = tokenizers.Tokenizer.from_str(self.data.decode())
                model.no_truncation()
                model.no_padding()
                _loaded[self.version] = lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]
        return _loaded[self.version]


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def encoded(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, text) to (digest, n_tokens), each batch on its own; repeats within a batch are encoded once."""

    def run(batches):
        count = tokenizer.counter()
        for b in batches:
            first: dict[bytes, str] = {}
            for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                first.setdefault(d, t)
            keys, values, got = list(first), list(first.values()), []
            for k in range(0, len(values), 32):
                got += count(values[k : k + 32])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(got, pa.int64())], CACHE.names)

    return rows.mapInArrow(lean(run), CACHE)


def digested(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, text (null: empty) and the digest of its normal form; the tables of a rewriting tokenizer need Python for it."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if not tokenizer.rewrites:
        return base.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def run(batches):
        form = tokenizer.normal_form()
        for b in batches:
            digest = [hashlib.sha256(form(t).encode()).digest() for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.binary())], ["doc_id", "text", "digest"])

    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField("digest", T.BinaryType())]))


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = 512) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty. Repeated rows and copies are encoded once; an empty table
    gives an empty table; other columns are ignored. ``cache`` is a folder that later
    calls, with any tokenizer, may share: they encode only what it lacks, and of the
    stored counts they gather only those of their own texts. None: a new one.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    small_batches(spark)
    path = f"{cache or folder + '/cache'}/version={tokenizer.version}"
    full = digested(docs, tokenizer)
    keyed = written(full.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), f"{folder}/keyed")
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    stored = _exists(spark, path)
    if stored:
        wanted = wanted.join(spark.read.schema(CACHE).parquet(path), "digest", "left_anti")
    wanted = written(wanted.withColumnRenamed("digest", "miss"), f"{folder}/wanted")
    # Built from the narrow side: texts are dealt once and never sorted.
    misses = full.join(wanted, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    encoded(misses.select("digest", "text"), tokenizer).write.mode("append").parquet(path)
    counts = spark.read.schema(CACHE).parquet(path)
    if stored:
        counts = counts.join(keyed.select("digest").distinct(), "digest", "left_semi")
    # A null doc_id or repeated rows may have been encoded in two batches: one count a digest.
    counts = written(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), f"{folder}/counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
