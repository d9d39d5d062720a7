"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit of a fingerprint has a vector of radius + 1 bits; each non-zero vector v
gives a mask of the bits whose vector has an odd product with v. Any ``radius``
differing bits span less than the whole space, so some v is orthogonal to them all:
its mask skips every differing bit, and the pair collides in that table, without fail.

Equal fingerprints are one class from the start. Within a table's bucket all classes
near the least one are linked to it; only the others are compared with the bucket, a
block of them with a part of its members, and give spanning links. No task holds a
whole bucket, and no pair of a group is ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch, small_batches, texts, written
from .components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
STEP = 1 << 16
#: Classes far from their bucket's least one, and members of the bucket, that are compared at a time.
FAR_ROWS, MEMBER_ROWS = 512, 4096


def fingerprint(text: str, words: int = 4) -> int:
    """Fingerprint of a whole text, unsigned; zero if it has no word."""
    w = text.encode().translate(_LOWER).split()  # bytes split at 20 and 09-0D only
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: max(1, len(w) - words + 1)].tolist()
    end = end[min(words, len(w)) - 1 :].tolist()
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(start), STEP):
        got = np.array([h(line[i:j], 42) for i, j in zip(start[k : k + STEP], end[k : k + STEP], strict=True)], "<u8")
        counts += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * counts > len(start)) * (1 << np.arange(64, dtype=np.uint64))).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and fp (its 64 bits as a signed long); a null text counts as empty."""
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    schema = T.StructType([base.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema.names)

    return base.mapInArrow(lean(run), schema)


def masks(radius: int = 4, bits: int = 64) -> list[int]:
    """The covering masks, 2^(radius+1) - 1 of them, each of about half the bits."""
    every = (1 << (radius + 1)) - 1
    vector = [1 + i % every for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vector) if (m & v).bit_count() % 2) for v in range(1, every + 1)]


def near_links(classes: DataFrame, radius: int, folder: str) -> DataFrame:
    """``classes`` (fp, distinct) to links (a, b) that connect just what chains of near pairs connect.

    One exchange deals (key, fingerprint), summed up before it: a bucket of two gives its
    pair outright. Only buckets of three and more are joined back to their members.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    # A key is a hash of table and masked bits: should two buckets meet, their members are only compared in vain.
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    keyed = classes.select("fp", F.explode(keys).alias("k"))
    buckets = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("n > 1")
    buckets = written(buckets, f"{folder}/buckets")
    apart = lambda x: F.bit_count(F.col(x).bitwiseXOR(F.col("least")))
    two = buckets.where((F.col("n") == 2) & (apart("most") <= radius)).select(F.col("most").alias("a"), F.col("least").alias("b"))
    rows = written(keyed.join(buckets.where("n > 2").select("k", "least"), "k"), f"{folder}/rows")
    near = rows.where((apart("fp") <= radius) & (F.col("fp") != F.col("least"))).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    far = rows.where(apart("fp") > radius).select("k", "fp")
    sizes = rows.groupBy("k").agg(F.ceil(F.count("*") / MEMBER_ROWS).cast("int").alias("parts"), F.ceil(F.count(F.when(apart("fp") > radius, 1)) / FAR_ROWS).cast("int").alias("blocks"))
    sizes = written(sizes.where("blocks > 0"), f"{folder}/sizes")
    place = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int").alias(c[:-1])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(c[:-1])
    one = far.join(sizes, "k").select("k", place("blocks"), every("parts"), "fp", F.lit(True).alias("is_far"))
    others = rows.select("k", "fp").join(sizes, "k").select("k", every("blocks"), place("parts"), "fp", F.lit(False).alias("is_far"))

    def spanning(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        mask = group.column("is_far").to_numpy(zero_copy_only=False).astype(bool)
        mine, members = np.unique(fp[mask]), np.unique(fp)
        label = np.arange(len(members))
        for x in mine:
            hit = np.flatnonzero(np.bitwise_count(members ^ x) <= radius)
            joined = np.unique(label[hit])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        odd = label != np.arange(len(members))
        a, b = members[odd].view(np.int64), members[label[odd]].view(np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    rest = one.unionByName(others).groupBy("k", "block", "part").applyInArrow(spanning, "a long, b long")
    return two.union(near).union(rest)


def simhash_groups(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint (hex), component_id, kept.

    Documents whose fingerprints differ in ``radius`` bits at most are linked;
    component_id is the smallest doc_id reachable. Texts without words, null ones too,
    have fingerprint zero and are linked like any other. Repeated rows come out as
    often. A null doc_id is never a smallest one unless its group has no other. kept:
    doc_id equals component_id. An empty table gives an empty table.
    """
    folder = scratch(docs.sparkSession)
    fps = written(fingerprints(docs, words), f"{folder}/fps")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), f"{folder}/classes")
    links = written(near_links(classes.select("fp"), radius, folder), f"{folder}/links")
    part = connected_components(links, f"{folder}/components")
    named = classes.join(part, classes["fp"] == part["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    named = written(named, f"{folder}/named")
    least = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), f"{folder}/least")
    groups = written(named.join(least, "root").select("fp", "component_id"), f"{folder}/groups")
    out = fps.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
