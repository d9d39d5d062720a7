"""Toxicity by maximum-scoring segments of token log-odds.

Learning uses a bounded sample of labelled documents (``sample``). Features are words
with their beginnings and ends; each has the log-odds of toxic against other documents
under an informative Dirichlet prior, whose pseudo-counts follow the sample's overall
rates. A word scores as the largest log-odds among its features that are certain enough,
else as a small loss. A linear scan finds all maximal segments of positive score (Ruzzo and
Tompa). Scores of chance segments have an extreme-value distribution (Karlin and
Altschul) whose parameters come from out-of-fold scores of clean documents; a logistic
curve over the calibrated segments gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch, small_batches, texts, written

WORDS = re.compile(r"[^\W\d_]+")
#: Score of a word without a certain feature.
LOSS = -1.0
#: Words that a worker remembers.
REMEMBERED = 200_000
#: A passage is significant if fewer than so many are expected by chance in its document.
EXPECTED = 0.05


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its ends of 4 and 5."""
    n = len(word)
    return ["w" + word, *("a" + word[:k] for k in range(3, 7) if k < n), *("z" + word[-k:] for k in (4, 5) if k < n)]


def segments(scores: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) in linear time.

    ``scores`` has the words of positive score, (place, score) in order; all between
    score ``loss``. Each candidate keeps the running totals before and after it and the
    place of the nearest candidate to its left with a lower total before, so what lies
    between is never looked at again. A candidate without such a neighbour settles all
    that came earlier: they leave the list.
    """
    out: list[tuple[int, int, float]] = []
    held: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, left neighbour
    total, at = 0.0, 0
    for place, s in scores:
        total += loss * (place - at)
        before, first = total, place
        total += s
        at = place + 1
        left = len(held) - 1
        while True:
            while left >= 0 and held[left][0] >= before:
                left = held[left][4]
            if left < 0 or held[left][1] >= total:
                break
            before, _, first, _, further = held[left]
            del held[left:]
            left = further
        if left < 0:
            out += [(i, j, after - b) for b, after, i, j, _ in held]
            held.clear()
        held.append((before, total, first, place, left))
    return out + [(i, j, after - b) for b, after, i, j, _ in held]


class Scorer(dict):
    """Word to score; ``certain`` maps a feature to its log-odds."""

    def __init__(self, certain: dict[str, float]):
        super().__init__()
        self.certain = certain

    def __missing__(self, word: str) -> float:
        found = [self.certain[f] for f in features(word.lower()) if f in self.certain]
        s = self[word] = max(found) if found else LOSS
        return s

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the segments."""
        words = WORDS.findall(text)
        if len(self) > REMEMBERED:
            self.clear()
        return len(words), segments([(i, s) for i, s in enumerate(map(self.__getitem__, words)) if s > 0])


def _half(doc_id):
    return F.pmod(F.crc32(F.concat(F.lit("half:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), F.lit(2)).cast("int")


def held_out(doc_id):
    """Whether the CRC-32 of the id as text leaves 1 modulo 3. A null id counts as text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3 == 1


def sampled(docs: DataFrame, labels: DataFrame, sample: int, folder: str) -> DataFrame:
    """Up to ``sample`` labelled documents to learn from, by the order of their ids' digests.

    At most so many ids are broadcast. A document with several labels is toxic if any says
    so, and of documents with one text the least id stands for all, toxic if any is; so
    reruns learn from the same rows.
    """
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    ids = written(ids, f"{folder}/ids")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return written(picked.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") == 1).alias("toxic"), _half(F.col("doc_id")).alias("half")), f"{folder}/sample")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, and the documents with it by half and label: t0, c0, t1, c1."""
    kinds = ("t0", "c0", "t1", "c1")

    def run(batches):
        for b in batches:
            counts = {k: Counter() for k in kinds}
            for t, toxic, half in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts[("t" if toxic else "c") + str(half)].update({f for w in {x.lower() for x in WORDS.findall(t)} for f in features(w)})
            names = list(set().union(*counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in kinds)], ["feature", *kinds])

    rows = sample.select("text", "toxic", "half").mapInArrow(lean(run), "feature string, t0 long, c0 long, t1 long, c1 long")
    return rows.groupBy("feature").agg(*[F.sum(k).alias(k) for k in kinds])


def log_odds(t, c, n_t: float, n_c: float, prior: float):
    """Log-odds and certainty of ``t`` of n_t against ``c`` of n_c documents.

    The prior is worth ``prior`` documents for each class, at the overall rate.
    Certainty is the root of the likelihood ratio: it also holds where c is zero.
    """
    rate = (t + c + 0.5) / (n_t + n_c + 1.0)
    odds = lambda k, n: F.log((k + prior * rate) / (n + prior - k - prior * rate))
    part = lambda k, n: F.when(k > 0, k * F.log(k / ((t + c) * (n / max(n_t + n_c, 1.0))))).otherwise(0.0)
    return odds(t, n_t) - odds(c, n_c), F.sqrt(F.greatest(2 * (part(t, n_t) + part(c, n_c)), F.lit(0.0)))


class Model:
    """What scoring needs: certain features, extreme-value parameters, logistic weights."""

    def __init__(self, certain, rate: float, spread: float, weights):
        self.certain, self.rate, self.spread, self.weights = certain, rate, spread, weights

    def inputs(self, n: int, scores: list[float]) -> tuple[float, float]:
        """The best segment's and all segments' calibrated scores."""
        x = [self.rate * s - math.log(self.spread * max(n, 1)) for s in scores]
        return max([-5.0, *x]) / 5, math.log1p(sum(v for v in x if v > 0))

    def score(self, n: int, scores: list[float]) -> float:
        a, b = self.inputs(n, scores)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1] * a + self.weights[2] * b))))


def extreme_value(words: int, positive: list[float], found: list[tuple[int, float]]) -> tuple[float, float]:
    """Rate and spread from clean documents: words, scores of positive words, (words, score) of segments."""
    s = np.array([*positive, 8.0])  # one chance word more, so that the rate is finite
    p = 1 / (words + 2.0)
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        high = p * np.exp(np.minimum(mid * s, 700)).sum() + (1 - len(s) * p) * math.exp(mid * LOSS)
        lo, hi = (lo, mid) if high > 1 else (mid, hi)
    got = [v for _, v in found]
    x = float(np.median(got)) if got else 8.0
    return lo, max(sum(v >= x for v in got), 0.5) / (max(words, 1) * math.exp(-lo * x))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, certainty: float = 4.5, least_docs: int = 3, prior: float = 10.0) -> Model:
    """Learns from ``sample`` labelled documents at most; without toxic ones all scores are low.

    What reaches the driver is bounded by the sample: features certain enough, and for
    each sampled document its number of words and its segments.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    small_batches(spark)
    picked = sampled(docs, labels, sample, folder)
    sizes = {(r["half"], r["toxic"]): r["n"] for r in picked.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = written(_feature_counts(picked), f"{folder}/counts")
    n = lambda toxic, halves: float(sum(sizes.get((h, toxic), 0) for h in halves))
    certain = {}
    for name, halves in (("all", (0, 1)), ("0", (0,)), ("1", (1,))):
        t, c = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0.0)) for k in "tc")
        delta, z = log_odds(t, c, n(True, halves), n(False, halves), prior)
        rows = counts.where(t >= least_docs).select("feature", delta.alias("d"), z.alias("z")).where(f"z >= {certainty} and d > 0").collect()
        certain[name] = {r["feature"]: r["d"] for r in rows}

    def run(batches):
        scorers = [Scorer(certain["1"]), Scorer(certain["0"])]  # each half by what the other taught
        for b in batches:
            out = []
            for t, half in zip(texts(b.column(0)), b.column(2).to_pylist(), strict=True):
                words, found = scorers[half].scan(t)
                out.append((words, [s for _, _, s in found], [s for s in map(scorers[half].__getitem__, WORDS.findall(t)) if s > 0] if found else []))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.int64()), (1, pa.list_(pa.float64())), (2, pa.list_(pa.float64()))))], ["toxic", "n", "found", "positive"])

    rows = picked.select("text", "toxic", "half").mapInArrow(lean(run), "toxic boolean, n long, found array<double>, positive array<double>").collect()
    clean = [r for r in rows if not r["toxic"]]
    rate, spread = extreme_value(sum(r["n"] for r in clean), [s for r in clean for s in r["positive"]], [(r["n"], s) for r in clean for s in r["found"]])
    model = Model(certain["all"], rate, spread, (-4.0, 0.0, 0.0))
    if any(r["toxic"] for r in rows) and clean:
        x = np.array([(1.0, *model.inputs(r["n"], r["found"])) for r in rows])
        model.weights = tuple(logistic(x, np.array([float(r["toxic"]) for r in rows])).tolist())
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, held_out, score, predicted, and passages.

    passages: the significant segments, as code point spans of the text with their
    scores. Null and empty texts have no words and get the lowest score. Repeated rows
    score alike; an empty table gives an empty table. No shuffle.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *T._parse_datatype_string("score double, predicted int, passages array<struct<start:int,end:int,score:double>>").fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scorer = Scorer(model.certain)
        for b in batches:
            scores, passages = [], []
            for t in texts(b.column(1)):
                n, found = scorer.scan(t)
                scores.append(model.score(n, [s for _, _, s in found]))
                sure = [x for x in found if model.spread * n * math.exp(-model.rate * x[2]) <= EXPECTED]
                places = [m.span() for m in WORDS.finditer(t)] if sure else []
                passages.append([{"start": places[i][0], "end": places[j][1], "score": s} for i, j, s in sure])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, span)], schema.names)

    return base.mapInArrow(lean(run), schema)
