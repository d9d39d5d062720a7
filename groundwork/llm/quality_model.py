"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters, four at a time: invented or rare words are no reason to
reject a text, odd spelling, shouting and symbol soup are. It learns from every trusted
text, each once, but one in five, and those judge: the thresholds come from them. A bit
for each document says which ones teach, so that neither texts nor ids travel for it.
A caller may ask for a bounded sample to learn from (``sample``); nothing here does.

Scoring is by joins. Documents are taken in blocks of neighbouring rows; a block gives
its distinct n-grams, which are joined, spread over the cluster by n-gram, with the
model's counts (each order's probabilities and back-off weights), and the log
probabilities return to their block, where the documents, packed, meet them. What is
gathered grows with the blocks, never with the square of anything, and no table that
grows is broadcast.

A language's threshold is a quantile of its own trusted documents' log perplexities,
each less an allowance for short texts that a document to be judged gets too.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, numbered, scratch, small_batches, texts, tidy, written

ORDER = 4
#: Bits of a character in a packed n-gram.
BITS = 15
#: Rows of a block by the size of their texts: (least bytes, rows). Longer texts have blocks of their own kind.
#: A kind's texts are less than four times as long as its shortest, so a block stays below 128 MB
#: and the few long texts of a file still share blocks, and with them their n-grams.
BLOCKS = ((0, 4096), *((1 << k, 1 << (27 - k - 2)) for k in range(15, 23, 2)), (1 << 23, 1))
#: Characters of a text that are packed at a time.
STEP = 1 << 20
#: One in so many trusted texts judges and does not teach.
JUDGES = 5
#: Bits of a row's number in its file that one bitmap of teaching rows covers.
MARKED = 15
#: N-grams of teaching texts that are counted at a time.
HELD = 1 << 21
#: A language with fewer judges, trusted documents that did not teach, takes no limit below that of all.
LEAST_JUDGES = 20

_UNKNOWN, _START = 0, 1


class Alphabet:
    """The characters that the model knows, numbered. Digits count as 0 and white space as a blank.

    A character that no trusted text has cannot be told from another such one by the
    model, so one number stands for them all without changing any probability.
    """

    def __init__(self, code_points):
        self.known = sorted({_plain(int(c)) for c in code_points})
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {"known": self.known, "table": None}

    def numbers(self, text: str) -> np.ndarray:
        if self.table is None:
            self.table = np.full(0x110000, _UNKNOWN, np.int16)
            self.table[self.known] = np.arange(_START + 1, _START + 1 + len(self.known))
            self.table[48:58], self.table[9:14] = self.table[48], self.table[32]
        return self.table[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def grams(self, text: str) -> np.ndarray:
        """The packed n-grams of a text, one for each character, the first ones padded."""
        c = np.concatenate([np.full(ORDER - 1, _START, np.int64), self.numbers(text).astype(np.int64)])
        n, out = len(c) - ORDER + 1, 0
        for k in range(ORDER):
            out = (out << BITS) | c[k : k + n]
        return np.asarray(out, np.int64)


def _plain(c: int) -> int:
    return 48 if 48 <= c <= 57 else 32 if 9 <= c <= 13 else c


def alphabet(sample: DataFrame) -> Alphabet:
    """The characters of ``sample`` (text), the most frequent ones should there be more than a number has room for.

    One row a character comes to the driver, at most ``1 << BITS``.
    """

    def run(batches):
        for b in batches:
            c, n = np.unique(np.frombuffer("".join(texts(b.column(0))).encode("utf-32-le"), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["c", "n"])

    counts = sample.select("text").mapInArrow(lean(run), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return Alphabet(r["c"] for r in counts.orderBy(F.desc("n"), "c").limit((1 << BITS) - 4).collect())


def _suffix(g, k: int):
    return g.bitwiseAND(F.lit((1 << (BITS * k)) - 1))


def _counted(sample: DataFrame, letters: Alphabet) -> DataFrame:
    def run(batches):
        held, room = [], HELD

        def out():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "c"])

        for b in batches:
            for t in texts(b.column(0)):
                for k in range(0, len(t), STEP):
                    held.append(letters.grams(t[max(k - ORDER + 1, 0) : k + STEP])[ORDER - 1 if k else 0 :])
                    room -= len(held[-1])
                    if room <= 0:
                        yield out()
                        held, room = [], HELD
        if held:
            yield out()

    return sample.select("text").mapInArrow(lean(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order from the numbers of n-grams seen once to four times."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(n[k]) for k in range(4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


class Model:
    """Tables of each order k: ``seen[k]`` (g, p) and ``back[k]`` (h, w); ``floor``: any unknown character."""

    def __init__(self, letters: Alphabet, seen: dict[int, DataFrame], back: dict[int, DataFrame], floor: float):
        self.letters, self.seen, self.back, self.floor = letters, seen, back, floor


def train(sample: DataFrame, folder: str) -> Model:
    """Kneser-Ney tables of ``sample`` (text): highest order by counts, lower ones by the n-grams that they continue."""
    letters = alphabet(sample)
    counts = {ORDER: written(_counted(sample, letters), f"{folder}/count{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = written(counts[k + 1].groupBy(_suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")), f"{folder}/count{k}")
    size = counts[1].count() + 1
    seen, back, lower = {}, {}, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k])
        c, h = F.col("c"), F.shiftright("g", BITS)
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        left = counts[k].withColumn("h", h)
        back[k] = written(left.groupBy("h").agg((F.sum(cut) / F.sum("c")).alias("w"), F.sum("c").alias("s")), f"{folder}/back{k}")
        rows = left.join(back[k], "h")
        if lower is None:
            base = rows.withColumn("q", F.lit(1.0 / size))
        else:
            base = rows.withColumn("low", _suffix(F.col("g"), k - 1)).join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
        seen[k] = written(base.select("g", ((F.col("c") - cut) / F.col("s") + F.col("w") * F.col("q")).alias("p")), f"{folder}/seen{k}")
        lower = seen[k]
    first = back[1].first()
    return Model(letters, seen, back, (first["w"] if first else 1.0) / size)


def log_probabilities(distinct: DataFrame, model: Model) -> DataFrame:
    """``distinct`` (g) to (g, lp): the last character's log probability, backed off order by order."""
    rows, p = distinct, F.lit(model.floor)
    for k in range(1, ORDER + 1):
        here = model.seen[k].select(F.col("g").alias(f"g{k}"), F.col("p").alias(f"p{k}"))
        rows = rows.withColumn(f"g{k}", _suffix(F.col("g"), k)).join(here, f"g{k}", "left")
        if k > 1:
            rows = rows.withColumn(f"h{k}", F.shiftright(f"g{k}", BITS)).join(model.back[k].select(F.col("h").alias(f"h{k}"), F.col("w").alias(f"w{k}")), f"h{k}", "left")
            p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(1.0)) * p)
        else:
            p = F.coalesce(F.col("p1"), p)
    return rows.select("g", F.log(p).cast("float").alias("lp"))


def from_files(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` as it is if its rows know their files; else written and read back."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return written(docs, folder)
    return docs


def scored(docs: DataFrame, model: Model, folder: str, carried: list[str], with_text: bool) -> DataFrame:
    """``docs``, read from files, to the ``carried`` columns, text if asked for, n (characters) and nats (mean surprise a character).

    Blocks are known by file and row, so that a task that runs again makes the same
    ones; BLOCKS bounds the bytes of one. An empty or null text has n 0 and null nats.
    """
    letters, size = model.letters, F.coalesce(F.octet_length("text"), F.lit(0))
    kind, per = F.lit(0), F.lit(BLOCKS[0][1])
    for k, (least, rows_) in enumerate(BLOCKS[1:], 1):
        kind, per = F.when(size >= least, k).otherwise(kind), F.when(size >= least, rows_).otherwise(per)
    block = F.xxhash64(F.col("_metadata.file_path"), kind, F.floor(F.col("_metadata.row_index") / per))
    base = docs.select(block.alias("__block"), F.coalesce("text", F.lit("")).alias("__text"), F.col("text").isNull().alias("__null"), *carried)

    def distinct_grams(batches):
        held: dict[int, list] = {}  # of each kind of block the one that is open

        def out(block):
            g = np.unique(np.concatenate(held.pop(block)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block, np.int64)), pa.array(g)], ["block", "g"])

        for b in batches:
            blocks, t = b.column(0).to_numpy(), texts(b.column(1))
            for block in dict.fromkeys(blocks.tolist()):
                if block not in held and len(held) > len(BLOCKS):
                    yield out(next(iter(held)))
                mine = held.pop(block, [])
                for i in np.flatnonzero(blocks == block):
                    mine += [np.unique(letters.grams(t[i][max(k - ORDER + 1, 0) : k + STEP])[ORDER - 1 if k else 0 :]) for k in range(0, max(len(t[i]), 1), STEP)]
                    if len(mine) > 32:
                        mine = [np.unique(np.concatenate(mine))]
                held[block] = [np.unique(np.concatenate(mine))]
        for block in list(held):
            yield out(block)

    packed = T.StructType([T.StructField("__block", T.LongType()), T.StructField("__z", T.BinaryType()), *base.schema.fields[2:]])

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(x.encode()) for x in texts(b.column(1))], pa.binary()), *b.columns[2:]], packed.names)

    pairs = written(base.select("__block", "__text").mapInArrow(lean(distinct_grams), "block long, g long"), f"{folder}/pairs")
    known = written(log_probabilities(pairs.select("g").distinct(), model), f"{folder}/known")
    tables = pairs.join(known, "g").select(F.col("block").alias("__block"), "g", "lp")
    kept_fields = [f for f in base.schema.fields[3:]]
    result = T.StructType([*kept_fields, *([T.StructField("text", T.StringType())] if with_text else []), T.StructField("n", T.LongType()), T.StructField("nats", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        g, lp = right.column("g").to_numpy(), right.column("lp").to_numpy().astype(np.float64)
        order = np.argsort(g, kind="stable")
        g, lp = g[order], lp[order]
        open_, out, at = zstandard.ZstdDecompressor(), [], 0
        for batch in left.to_batches(max_chunksize=128):
            n, nats, back = [], [], []
            for z, null in zip(batch.column("__z"), batch.column("__null").to_pylist(), strict=True):
                t = open_.decompress(z.as_py()).decode()
                total = 0.0
                for k in range(0, len(t), STEP):
                    got = letters.grams(t[max(k - ORDER + 1, 0) : k + STEP])[ORDER - 1 if k else 0 :]
                    total -= float(lp[np.searchsorted(g, got)].sum())
                n.append(len(t))
                nats.append(total / len(t) if len(t) else None)
                if with_text:
                    back.append(None if null else t)
            cols = [batch.column(f.name) for f in kept_fields] + [pa.array(back, pa.string())] * with_text
            out.append(pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(nats, pa.float64())], result.names))
        tidy()
        return pa.Table.from_batches(out)

    rows = base.mapInArrow(lean(pack), packed)
    return rows.groupBy("__block").cogroup(tables.groupBy("__block")).applyInArrow(score, result)


def trusted(labels: DataFrame) -> DataFrame:
    """The ids labelled good and never bad."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return good.where("quality = 1").select("doc_id")


def teaching(docs: DataFrame, good: DataFrame, folder: str) -> tuple[DataFrame, list[int]]:
    """The texts (text) of all ``good`` ids that teach, each once, and the digests of the languages' first judges.

    ``docs`` is read from files. Copies are on one side, as ``judges`` tells by their
    digest. Ids, digests and places travel to find a text's first place; then one bit a
    row comes to the driver and goes with the tasks that read the texts, in bitmaps of
    ``1 << MARKED`` rows of a file, and only where a row teaches.
    """
    file, row = F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")
    named = docs.where("length(text) > 0").select("doc_id", "lang", F.xxhash64("text").alias("digest"), file, row)
    named = written(named.join(good, "doc_id", "left_semi").select("lang", "digest", "file", "row"), f"{folder}/named")
    first = sorted({r["digest"] for r in named.groupBy("lang").agg(F.min("digest").alias("digest")).collect()})  # one row a language
    place = named.where(~judges(F.col("digest"), first)).groupBy("digest").agg(F.min(F.struct("file", "row")).alias("at")).select("at.*")
    bit = F.col("row").bitwiseAND(F.lit((1 << MARKED) - 1))
    bits = place.groupBy("file", F.shiftright("row", MARKED).alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"), F.max(bit).alias("last"))
    bits = bits.select("file", "part", F.substring("bits", 1, F.shiftright("last", 3).cast("int") + 1).alias("bits"))
    marks = {(r["file"], r["part"]): bytes(r["bits"]) for r in bits.collect()}

    def run(batches):
        for b in batches:
            files, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts, at = rows >> MARKED, rows & ((1 << MARKED) - 1)
            mine = np.zeros(len(rows), bool)
            for key in set(zip(files.tolist(), parts.tolist(), strict=True)):
                here = np.flatnonzero((files == key[0]) & (parts == key[1]))
                flags = np.frombuffer(marks.get(key, b""), np.uint8)
                here = here[at[here] >> 3 < len(flags)]
                mine[here] = flags[at[here] >> 3] >> (at[here] & 7).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(mine))], ["text"])

    return docs.select(file, row, "text").mapInArrow(lean(run), "text string"), first


def judges(digest, first: list[int]):
    """Whether a trusted text of this digest judges: one in ``JUDGES`` does, and each language's first."""
    return (F.pmod(digest, F.lit(JUDGES)) == 0) | digest.isin(first)


def trusted_sample(docs: DataFrame, good: DataFrame, sample: int, folder: str) -> DataFrame:
    """Up to ``sample`` documents of ``good`` ids, the languages in turn, by the order of their ids' digests, each text once.

    At most so many ids are broadcast. A language's first of each five does not teach and is left out.
    """
    digest = F.md5(F.col("doc_id").cast("string"))
    named = docs.select("doc_id", "lang").distinct().join(good, "doc_id", "left_semi").withColumn("digest", digest)
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id"))).where(F.col("rank") <= sample)
    ids = written(named.orderBy("rank", "digest", "doc_id", "lang").limit(sample).where("rank % 5 <> 1").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")), f"{folder}/ids")
    hit = (F.col("doc_id") == F.col("__id")) & F.col("lang").eqNullSafe(F.col("__lang"))
    picked = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), hit, "left_semi").where("length(text) > 0")
    return written(picked.dropDuplicates(["text"]), f"{folder}/sample")


def quantiles(rows: DataFrame, shares: tuple[float, ...], path: str) -> dict[tuple, tuple[int, dict[float, float]]]:
    """Of each series of ``rows`` (series, x, tie) its number of rows and, for each share, the least x that so many rows do not exceed.

    Exact: rows are ranked by ranges, and those at the ranks sought are looked up.
    """
    ranked = numbered(rows, F.col("series"), F.col("x"), F.col("tie"), path=path)
    spans = ranked.groupBy("series").agg(F.min("rank").alias("start"), F.count("*").alias("n")).collect()  # one row a series
    place = {(tuple(r["series"]), q): r["start"] + max(math.ceil(Fraction(str(q)) * r["n"]), 1) - 1 for r in spans for q in shares}
    at = {r["rank"]: r["x"] for r in ranked.where(F.col("rank").isin(sorted(set(place.values())))).collect()}  # one row a series and share
    return {tuple(r["series"]): (r["n"], {q: at[place[tuple(r["series"]), q]] for q in shares}) for r in spans}


def thresholds(scores: DataFrame, upper: float, reach: float, short: float, folder: str) -> dict[str | None, float]:
    """Limits by language from trusted documents' ``scores`` (lang, __digest, n, nats, taught); None stands for all languages together.

    The limit is the ``upper`` quantile of the judges, the documents that did not teach.
    Where they are too few for it, fewer than 1 / (1 - upper), it lies beyond the highest
    by ``reach`` times the distance of the median to the upper decile of all trusted
    documents, over the root of their number. Quantiles are those of all rows, never of a summary.
    """
    x, lang, judge = F.col("nats") - short / F.sqrt(F.greatest("n", F.lit(1))), F.col("lang"), ~F.col("taught")
    name = lambda every, own: F.struct(F.lit(every).alias("every"), (F.lit(None).cast("string") if every else lang).alias("lang"), F.lit(own).alias("own"))
    names = [name(True, False), F.when(judge, name(True, True)), F.when(lang.isNotNull(), name(False, False)), F.when(lang.isNotNull() & judge, name(False, True))]
    rows = scores.select(F.explode(F.array_compact(F.array(*names))).alias("series"), x.alias("x"), F.col("__digest").alias("tie"))
    found = quantiles(rows, (upper, 1.0, 0.9, 0.5), f"{folder}/ranked")

    if (True, None, True) not in found or found[True, None, True][0] == found[True, None, False][0]:
        return {}
    spread = found[True, None, False][1][0.9] - found[True, None, False][1][0.5]

    def limit(every: bool, of: str | None) -> float:
        n, own = found[every, of, True]
        return own[upper] if n * (1 - upper) >= 1 else own[1.0] + reach * spread / n**0.5

    out: dict[str | None, float] = {None: limit(True, None)}
    for every, of, own in found:
        if own and not every:
            out[of] = limit(False, of) if found[False, of, True][0] >= LEAST_JUDGES else max(limit(False, of), out[None])
    return out


def quality(docs: DataFrame, labels: DataFrame, sample: int | None = None, upper: float = 0.998, reach: float = 6.0, short: float = 3.0, with_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, lang and any other columns) to its columns, n, nats, perplexity, most, kept.

    The model learns from all trusted texts that do not judge, or from ``sample`` documents
    at most if that is given.

    ``kept``: nats, the log of the perplexity a character, is at most ``most``, the
    language's threshold plus ``short`` / sqrt(n); see ``thresholds``. A language without
    judges, or a null one, takes the threshold of all. Null and empty texts have no
    perplexity and are not kept; without trusted texts that teach and others that judge,
    all others are. Repeated rows score alike, columns of the names that are added are
    replaced, and an empty table gives an empty table. The text is left out unless asked
    for. Blocks go by files and rows, so a table that is none is written first.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    small_batches(spark)
    docs = from_files(docs, f"{folder}/docs")
    good = written(trusted(labels), f"{folder}/good")
    first: list[int] = []
    if sample is None:
        picked, first = teaching(docs, good, folder)
    else:
        picked = trusted_sample(docs, good, sample, folder)
    model = train(picked, f"{folder}/model")
    carried = [c for c in docs.columns if c not in ("text", "n", "nats", "perplexity", "most", "kept")]
    digested = docs.withColumn("__digest", F.xxhash64("text"))
    out = written(scored(digested, model, f"{folder}/scoring", [*carried, "__digest"], with_text), f"{folder}/scored")
    scores = out.where("n > 0").join(good, "doc_id", "left_semi").groupBy("lang", "__digest").agg(F.min("n").alias("n"), F.min("nats").alias("nats"))
    if sample is None:
        scores = scores.withColumn("taught", ~judges(F.col("__digest"), first))
    else:
        taught = F.broadcast(picked.select(F.xxhash64("text").alias("__digest"), F.lit(True).alias("taught")).distinct())
        scores = scores.join(taught, "__digest", "left").withColumn("taught", F.coalesce("taught", F.lit(False)))
    limits = thresholds(written(scores, f"{folder}/scores"), upper, reach, short, folder)
    known = [x for lang, m in limits.items() if lang is not None for x in (F.lit(lang), F.lit(float(m)))]
    overall = F.lit(float(limits.get(None, "inf")))
    most = F.coalesce(F.create_map(*known)[F.col("lang")], overall) if known else overall
    out = out.drop("__digest").withColumn("perplexity", F.exp("nats")).withColumn("most", most + short / F.sqrt(F.greatest("n", F.lit(1))))
    return out.withColumn("kept", F.coalesce(F.col("nats") <= F.col("most"), F.lit(False)))
