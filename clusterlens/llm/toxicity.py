"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: the labelled rows, or a sample of about ``LEARNING_ROWS`` of them where there are more, whose
ids and labels are sent to the tasks. Documents that hold a word are counted among toxic and other learning rows. A word's weight is its log-odds between the two, under a Dirichlet prior of ``PRIOR`` documents
spread as the word is over both, and half a document. Words that two documents or fewer hold, or whose
log-odds are below ``MIN_ODDS`` or less than ``MIN_Z`` standard deviations, say nothing. Every word costs
``DRIFT``, known or not, so a clean text drifts downwards. The number of words with a weight is bounded by
the counts: of each a share of ``MIN_SHARE`` of the toxic or the other documents has it.

Scoring: one pass over a text finds all its maximal-scoring segments (each the best within itself,
none contained in another), in linear time. Segment scores of chance texts follow an extreme-value
law: of words drawn as clean documents have them, a text of n words has K n exp(-L S) segments of
score S or more. L is the root of the mean of exp(L x) = 1 over the clean words' weights, K is fitted
to the best segments of clean learning rows. A document's evidence is the log of the chance of
its best segments, and a logistic curve, fitted on at most about ``CALIBRATION_ROWS`` learning rows,
turns it into a score.

Defined results: words are runs of letters and digits, lower-cased. Null and empty texts, and texts
without a segment, have the curve's lowest score. Without labelled rows of both kinds every score is
0. Repeated rows are scored one by one, and count as often as they come. Only the named columns are
read. Labels other than 0 and 1 teach nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import held_out, read, staged

PRIOR = 10.0
MIN_Z = 3.0
MIN_ODDS = 2.0
MIN_SHARE = 2e-4
DRIFT = -1.0
#: No word weighs more than this, either way.
MAX_WEIGHT = 6.0
#: Bounds of the samples for weights and for the curve.
LEARNING_ROWS = 200_000
CALIBRATION_ROWS = 20_000

WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = 0.0

    def probability(self, evidence: float) -> float:
        if not self.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * evidence))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in one pass.

    Candidates carry the running total before and after them. A new score joins the last candidate
    that begins lower than it and ends lower than it; what lies between becomes part of it.
    """
    out: list[list] = []  # first, end, total before, total after, last candidate that begins lower
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x, -1]
        total += x
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after, _ in out]


def score_text(model: Model, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the segments as places of words."""
    weights = model.weights
    found = WORD.findall(text.lower()) if text else []
    at, scores, last = [], [], -1
    for i, w in enumerate(found):
        x = weights.get(w)
        if x is None:
            continue
        if i > last + 1:  # a run without weights falls by its length
            at.append(last + 1)
            scores.append(DRIFT * (i - last - 1))
        at.append(i)
        scores.append(x)
        last = i
    return len(found), [(at[a], at[b - 1] + 1, s) for a, b, s in segments(scores)]


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """Minus the log of the chance that a clean text of n words has segments like these.

    Each segment's chance is 1 - exp(-E) with E = K n exp(-L S); the significant ones add up.
    """
    total = 0.0
    for _, _, s in found:
        e = model.k * max(n, 1) * math.exp(-min(model.rate * s, 700.0))
        chance = -math.expm1(-e) if e > 1e-12 else e
        if chance < 0.05:
            total -= math.log(max(chance, 1e-300))
    return total


def _vocabulary(rows: DataFrame) -> DataFrame:
    """word, n1, n0: toxic and other documents that hold it; partial counts leave each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "word": pa.array(list(counts), pa.string()),
                    "n1": pa.array([c[1] for c in counts.values()], pa.int64()),
                    "n0": pa.array([c[0] for c in counts.values()], pa.int64()),
                }
            )

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for w in set(WORD.findall(text.as_py().lower())):
                    got = counts.get(w)
                    if got is None:
                        counts[w] = got = [0, 0]
                    got[toxic] += 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    parts = rows.mapInArrow(run, "word string, n1 long, n0 long")
    return parts.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def train(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Model of labelled rows (text, toxic)."""
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("toxic in (0, 1)")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model()
    words = staged(_vocabulary(rows), "toxic-words")
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    a1, a0 = (F.col(c) + PRIOR * share + 0.5 for c in ("n1", "n0"))
    b1, b0 = (n - F.col(c) + PRIOR * (1 - share) + 0.5 for n, c in ((n1, "n1"), (n0, "n0")))
    odds = F.log(a1 / b1) - F.log(a0 / b0)
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    chosen = (
        words.filter("n1 + n0 > 2")
        .withColumns({"odds": odds, "z": z})
        .filter((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS) & ((F.col("n1") >= MIN_SHARE * n1) | (F.col("n0") >= MIN_SHARE * n0)))
        .select(
            "word",
            (F.greatest(F.least("odds", F.lit(MAX_WEIGHT)), F.lit(-MAX_WEIGHT)) + DRIFT).alias("odds"),
            "n0",
        )
    )
    picked = chosen.toArrow().to_pydict()
    weights = dict(zip(picked["word"], picked["odds"], strict=True))
    model = Model(weights)
    # the clean words' weights: each word's share of documents stands for its share of words
    clean = np.array(picked["n0"], float) + 0.5
    x = np.array(picked["odds"], float)
    total = words.agg(F.sum("n0")).first()[0] or 1
    mass = clean / max(float(total), clean.sum() + 1)
    model.rate = _rate(np.append(x, DRIFT), np.append(mass, max(1 - mass.sum(), 1e-6)))
    # calibration on a bounded sample
    every = max(1, (n1 + n0) // calibration_rows)
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_text(sent.value, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": batch.column("toxic"),
                    "n": pa.array([n for n, _ in got], pa.int64()),
                    "s": pa.array([[s for _, _, s in f] for _, f in got], pa.list_(pa.float64())),
                }
            )

    seen = some.mapInArrow(measure, "toxic int, n long, s array<double>").toArrow().to_pylist()
    clean_best = [(r["n"], max(r["s"], default=0.0)) for r in seen if r["toxic"] == 0 and r["n"]]
    # K by moments: the mean of n exp(-L S) over clean texts is 1 / K for extreme-value scores
    mean = np.mean([n * math.exp(-min(model.rate * s, 700.0)) for n, s in clean_best]) if clean_best else 1
    model.k = float(min(1.0, max(1e-6, 1 / mean)))
    y = np.array([r["toxic"] for r in seen], float)
    e = np.array([evidence(model, r["n"], [(0, 0, s) for s in r["s"]]) for r in seen])
    model.slope, model.offset = _logistic(e, y)
    return model


def _rate(x: np.ndarray, mass: np.ndarray) -> float:
    """The positive root of sum(mass * exp(rate * x)) = 1; mass is scaled to one."""
    mass = mass / mass.sum()
    if (mass * x).sum() >= 0 or x.max() <= 0:
        return 1.0
    low, high = 1e-9, 1.0
    while (mass * np.exp(high * x)).sum() < 1 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (mass * np.exp(mid * x)).sum() < 1 else (low, mid)
    return high


def _logistic(e: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the label's log-odds in the evidence, by Newton's method with a ridge."""
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    x = np.stack([np.minimum(e, 60.0), np.ones(len(e))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-3 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


PASSAGES = "array<struct<first:int,end:int,score:double>>"


def passages(model: Model, text: Column, spark: SparkSession) -> Column:
    """Struct of the score and all significant segments, as places of words."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<score:double,passages:{PASSAGES}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        kind = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for part in parts:
            scores, found = [], []
            for text in part:
                n, got = score_text(model, text.as_py())
                scores.append(model.probability(min(evidence(model, n, got), 60.0)))
                worth = [g for g in got if evidence(model, n, [g]) > 0]
                found.append([{"first": a, "end": b, "score": s} for a, b, s in worth])
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(found, pa.list_(kind))],
                names=["score", "passages"],
            )

    return run(text)


def learning_rows(docs: DataFrame, labels: DataFrame, limit: int = LEARNING_ROWS) -> DataFrame:
    """Texts and labels of rows with an id outside the held-out fold; a label per id.

    A hash of the id picks about ``limit`` of them where there are more, so the ids can be broadcast
    and no text is shuffled.
    """
    marks = labels.filter(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic").dropna()
    every = max(1, -(-marks.count() // limit))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(learning_rows(docs, read(spark, sf_dir, "labels")))
    scored = docs.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        passages(model, F.col("text"), spark).alias("r"),
    )
    return scored.select(
        "doc_id",
        "held_out",
        F.col("r.score").alias("score"),
        F.when(F.col("r.score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("r.passages").alias("n_passages"),
    )
