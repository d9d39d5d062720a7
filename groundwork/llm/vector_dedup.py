"""Embedding near-dedup by sorted projection passes, with an exact check behind them.

Equal vectors are one representative from the start. Random hyperplanes through the
vectors' mean give each representative, for every pass, a word of signs; in each pass
the representatives of a label lie in the lexicographic order of their words, each is
held against a bounded window of neighbours, and near pairs by a further sketch are
verified in double precision. Verified pairs of all passes are united.

A window may cut a pair off, so an exact check follows. In the first pass's order,
neighbours make up blocks, each within a ball; two blocks of a label are compared, by
one task, unless their balls lie too far apart for any link. That gives each vector's
number of links, and the links that the passes missed. No pair of a dense group is listed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch, small_batches, written
from .components import connected_components

#: Rows and bytes (in double precision) of a block, at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 23
#: Differing bits of two sketches, of 64, from which a neighbour is not verified; and candidates that a
#: vector proposes in a pass. The exact check has what they leave out.
FAR_BITS, PROPOSED = 20, 4


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None if it is null, zero or has a null or non-finite part."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and x.values.null_count == 0 and len(x.values):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            v = v if np.isfinite(v).all() and v.any() else None
        out.append(v)
    return out


def unit_rows(data: list[bytes]) -> np.ndarray:
    """Vectors of one length, as ``packed`` writes them, as rows of norm one in double precision."""
    kind = np.float32 if data[0][0] else np.float64
    v = np.frombuffer(b"".join(x[1:] for x in data), kind).astype(np.float64).reshape(len(data), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small parts stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def packed(v: np.ndarray) -> bytes:
    """A vector's bytes, in single precision (first byte 1) where that says the same."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"\1" + single.tobytes() if (single == v).all() else b"\0" + v.tobytes()


def length_of(data: bytes) -> int:
    return len(data) // (4 if data[0] else 8)


def _means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length; one row a partition and length comes to the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for v in _matrix(b.column(0)):
                if v is not None:
                    v = v / np.abs(v).max()
                    sums[len(v)] = sums.get(len(v), 0.0) + np.append(v / math.sqrt(v @ v), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["s"])

    out: dict[int, np.ndarray] = {}
    for r in vectors.select("embedding").mapInArrow(lean(run), "s binary").collect():
        s = np.frombuffer(r["s"], np.float64)
        out[len(s) - 1] = out.get(len(s) - 1, 0.0) + s
    return {d: s[:-1] / s[-1] for d, s in out.items()}


def _alike(vec: list[bytes | None]):
    """The places and unit rows of each kind and length of vectors."""
    for kind in {(len(v), v[0]) for v in vec if v}:
        at = [i for i, v in enumerate(vec) if v and (len(v), v[0]) == kind]
        yield at, unit_rows([vec[i] for i in at])


def words(u: np.ndarray, mean: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` words of 64 signs for each row of ``u``, as signed longs."""
    planes = np.random.default_rng([seed, u.shape[1]]).standard_normal((u.shape[1], 64 * count))
    signs = np.packbits((u - mean) @ planes > 0, axis=1, bitorder="little")
    return signs.view("<u8").view(np.int64).reshape(len(u), count)


def _prepared(vectors: DataFrame, means: dict[int, np.ndarray], seed: int) -> DataFrame:
    """vec_id, label, and the vector's digest, bytes and first word (null if it links with nothing)."""
    base = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    schema = T.StructType([base.schema["vec_id"], *T._parse_datatype_string("label string, digest binary, vec binary, word long").fields])

    def run(batches):
        for b in batches:
            vec = [None if v is None else packed(v) for v in _matrix(b.column(2))]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            word: list[int | None] = [None] * len(vec)
            for at, u in _alike(vec):
                for i, w in zip(at, words(u, means[u.shape[1]], 1, seed)[:, 0].tolist(), strict=True):
                    word[i] = w
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(vec, pa.binary()), pa.array(word, pa.int64())], schema.names)

    return base.mapInArrow(lean(run), schema)


def _in_blocks(reps: DataFrame) -> DataFrame:
    """``reps`` (label, rep, dim, n, vec, word) in the order of their words, with ``block``: the first member's key."""
    order = ["label", "dim", "word", "rep"]
    rows = reps.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        block, held, of = None, 0, None
        for b in batches:
            out = []
            for label, rep, dim in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != (label, dim) or held >= max(min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)), 1):
                    block, held, of = rep, 0, (label, dim)
                held += 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "block"])

    return rows.mapInArrow(lean(run), T.StructType([*reps.schema.fields, T.StructField("block", T.LongType())]))


def passed(blocks: DataFrame, means: dict[int, np.ndarray], least: float, passes: int, window: int, seed: int, folder: str) -> DataFrame:
    """Verified pairs (a, b) that the sorted passes find: narrow rows, sorted by ranges, each held against its neighbours."""

    def hashed(batches):
        for b in batches:
            label, rep, vec = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for at, u in _alike(vec):
                w = words(u, means[u.shape[1]], passes + 1, seed)
                group = np.array([int.from_bytes(hashlib.blake2b(f"{u.shape[1]}/{label[i]}".encode(), digest_size=8).digest(), "little", signed=True) for i in at])
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(group ^ (p + 1)), pa.array(w[:, p]), pa.array(rep[at]), pa.array(w[:, passes])], ["g", "word", "rep", "sketch"])

    def neighbours(batches):
        g, rep, sketch = (np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            tail = slice(-window, None)
            old = len(g[tail])
            g, rep, sketch = (np.concatenate([x[tail], b.column(c).to_numpy()]) for x, c in ((g, 0), (rep, 2), (sketch, 3)))
            n = len(g)
            apart = np.full((window, n), 65, np.uint8)  # of each row and its neighbours before it
            for k in range(1, min(window, n - 1) + 1):
                differ = np.bitwise_count((sketch[k:] ^ sketch[:-k]).view(np.uint64))
                apart[k - 1, k:] = np.where(g[k:] == g[:-k], differ, 65)
            best = np.argsort(apart, axis=0, kind="stable")[:PROPOSED, old:]
            at = np.broadcast_to(np.arange(old, n), best.shape)
            near = np.take_along_axis(apart[:, old:], best, axis=0) < FAR_BITS
            x, y = rep[at[near]], rep[(at - best - 1)[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    keyed = blocks.select("label", "rep", "vec").mapInArrow(lean(hashed), "g long, word long, rep long, sketch long")
    order = ["g", "word", "rep"]
    found = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(neighbours), "a long, b long")
    found = written(found.distinct(), f"{folder}/candidates")
    vec = blocks.select("rep", "vec")
    both = found.join(vec.toDF("a", "va"), "a").join(vec.toDF("b", "vb"), "b")

    def verified(batches):
        for b in batches:
            a, c = b.column(b.schema.get_field_index("va")).to_pylist(), b.column(b.schema.get_field_index("vb")).to_pylist()
            ok = [length_of(x) == length_of(y) and bool(unit_rows([x])[0] @ unit_rows([y])[0] >= least) for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)).filter(pa.array(ok, pa.bool_())) for k in ("a", "b")], ["a", "b"])

    return written(both.mapInArrow(lean(verified), "a long, b long"), f"{folder}/verified")


def _rows_of(group: pa.Table) -> np.ndarray:
    vec = group.column("vec").to_pylist()
    u = np.empty((len(vec), length_of(vec[0])))
    for at, some in _alike(vec):
        u[at] = some
    return u


def _balls(blocks: DataFrame) -> DataFrame:
    """(block, label, dim, centre, reach): each block's ball by angles, of at most BLOCK_ROWS rows in one task."""

    def ball(group: pa.Table) -> pa.Table:
        u = _rows_of(group)
        c = u.sum(axis=0)
        c = c / (np.sqrt(c @ c) or 1.0)
        reach = float(np.arccos(np.clip(u @ c, -1, 1)).max()) if c.any() else math.pi
        return pa.table({"block": group.column("block")[:1], "label": group.column("label")[:1], "dim": pa.array([u.shape[1]], pa.int64()), "centre": pa.array([c.tolist()]), "reach": pa.array([reach])})

    return blocks.select("block", "label", "vec").groupBy("block").applyInArrow(ball, "block long, label string, dim long, centre array<double>, reach double")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def compared(blocks: DataFrame, least: float, folder: str) -> DataFrame:
    """The exact check over ``blocks`` (label, rep, n, vec, block): rows (a, b, null), spanning links, and (a, null, part), links of ``a`` counting copies."""
    balls = written(_balls(blocks), f"{folder}/balls")
    x, y = balls.select("label", "dim", F.col("block").alias("lo"), F.col("centre").alias("c1"), F.col("reach").alias("r1")), balls.select("label", "dim", F.col("block").alias("hi"), F.col("centre").alias("c2"), F.col("reach").alias("r2"))
    room = F.least(F.col("r1") + F.col("r2") + math.acos(least) + 1e-6, F.lit(math.pi))
    pairs = x.join(y, ["label", "dim"]).where("lo <= hi").where((F.col("lo") == F.col("hi")) | (_dot(F.col("c1"), F.col("c2")) >= F.cos(room) - 1e-9))
    pairs = written(pairs.select("lo", "hi"), f"{folder}/pairs")
    sides = pairs.select("lo", "hi", F.col("lo").alias("block")).union(pairs.where("lo <> hi").select("lo", "hi", F.col("hi").alias("block")))
    rows = blocks.select("block", "rep", "n", "vec").join(sides, "block")

    def compare(group: pa.Table) -> pa.Table:
        block, n, rep = group.column("block").to_numpy(), group.column("n").to_numpy(), group.column("rep").to_numpy()
        lo, hi = group.column("lo").to_numpy()[0], group.column("hi").to_numpy()[0]
        u, got, root = _rows_of(group), np.zeros(len(rep), np.int64), np.arange(len(rep))
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        v = u[y]
        for k in range(0, len(x), 256):
            mine = x[k : k + 256]
            linked = u[mine] @ v.T >= least
            if lo == hi:
                linked[np.arange(len(mine)), k + np.arange(len(mine))] = False
            for at in np.flatnonzero(linked.any(axis=1)):
                hit, me = y[linked[at]], mine[at]
                got[me] += n[hit].sum()
                if lo != hi:
                    got[hit] += n[me]
                if (root[hit] != root[me]).any():
                    joined = np.unique(np.append(root[hit], root[me]))
                    root[np.isin(root, joined)] = joined[0]
        odd, some = np.flatnonzero(root != np.arange(len(rep))), np.flatnonzero(got)
        a, b = np.concatenate([rep[odd], rep[some]]), np.concatenate([rep[root[odd]], np.zeros(len(some), np.int64)])
        part, count = np.concatenate([np.zeros(len(odd), np.int64), got[some]]), np.arange(len(a)) >= len(odd)
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=count), "part": pa.array(part, mask=~count)})

    return written(rows.groupBy("lo", "hi").applyInArrow(compare, "a long, b long, part long"), f"{folder}/found")


def vector_groups(vectors: DataFrame, least: float = 0.98, passes: int = 8, window: int = 32, seed: int = 42) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to vec_id, n_links, component_id, kept: a row for each row.

    Rows with a null label, or a vector that is null, empty, zero or has a null or
    non-finite part, link with nothing: no links, their own component. Vectors of
    unlike lengths do not link. Repeated rows and equal vectors count as separate
    vectors and link with each other. An empty table gives an empty table. ``passes``,
    ``window`` and ``seed`` decide what the passes find by themselves, never the result.
    """
    folder = scratch(vectors.sparkSession)
    small_batches(vectors.sparkSession, 1024)
    means = _means(vectors)
    rows = written(_prepared(vectors, means, seed), f"{folder}/rows")
    sound = rows.where(F.col("label").isNotNull() & F.col("digest").isNotNull())
    reps = sound.groupBy("label", "digest").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.any_value("vec").alias("vec"), F.any_value("word").alias("word"))
    # A null or repeated vec_id could name two representatives: nodes are numbered.
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), f"{folder}/reps")
    single = F.hex(F.substr("vec", F.lit(1), F.lit(1))) == "01"
    dim = ((F.length("vec") - 1) / F.when(single, 4).otherwise(8)).cast("long").alias("dim")
    blocks = written(_in_blocks(reps.select("label", "rep", dim, "n", "vec", "word")), f"{folder}/blocks")
    near = passed(blocks, means, least, passes, window, seed, folder)
    found = compared(blocks, least, folder)
    links = near.union(found.where("b is not null").select("a", "b"))
    part = written(connected_components(links, f"{folder}/components"), f"{folder}/part")
    others = found.where("part is not null").groupBy(F.col("a").alias("node")).agg(F.sum("part").alias("others"))
    ids = reps.select("rep", "label", "digest", "least_id", "n")
    smallest = part.join(ids, part["node"] == ids["rep"]).groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = part.join(smallest, "component").join(others, "node").select(F.col("node").alias("rep"), "component_id", "others")
    info = ids.join(linked, "rep", "left").select("label", "digest", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    info = written(info, f"{folder}/info")
    alone = rows.where(F.col("label").isNull() | F.col("digest").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.select("vec_id", "label", "digest").join(info, ["label", "digest"]).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
