"""Quality score by compression (operator 8).

Method. Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into
blocks of ``BLOCK`` bytes, each compressed with either dictionary, and the sizes are summed over the whole
text: ``difference = (good - bad) / (good + bad)``. A logistic curve, fitted to labelled documents that no
dictionary has seen, turns the difference, with the compression ratio beside it (a text that repeats itself
shrinks alike with both), into a score.

What is learnt. Labels count only where crc32(doc_id as text) mod 3 is not 1: remainder 0 trains the
dictionaries, remainder 2 the curve; remainder 1 is held out. Per class and remainder at most ``LABELLED``
labels are taken, those of smallest hash, and of their texts at most ``SAMPLES`` blocks for a dictionary.
These bounds are parameters; they are what the driver holds. Labels, lang, source and doc_id are no inputs.

Scale. The sampled labels are broadcast (at most 4 * ``LABELLED`` ids), so neither training nor scoring
exchanges a text; scoring is one pass of independent rows, memory is one Arrow batch and two dictionaries.

Cases: an empty or null text has no evidence and gets the rate of good labels in training; without usable
labels of both classes every score is 0.5; labels that are null or neither 0 nor 1 are not used; repeated
labels count as often as they occur; empty tables give empty results; very long texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, smallest

LABELLED = 3_000
SAMPLES = 6_000
BLOCK = 2_048
DICTIONARY = 112_640
LEVEL = 3
FOLDS, HELD_OUT, FIT_DICTIONARY, FIT_CURVE = 3, 1, 0, 2
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fold(row_id: Column) -> Column:
    return F.crc32(row_id.cast("string").cast("binary")) % FOLDS


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    prior: float

    def opened(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor] | None:
        if not self.good or not self.bad:
            return None
        return tuple(
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in (self.good, self.bad)
        )

    def score(self, found: tuple[float, float] | None) -> float:
        if found is None or not self.weights:
            return self.prior
        z = self.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(self.weights[1:], expanded(found), self.means, self.scales, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def expanded(found: tuple[float, float]) -> tuple[float, ...]:
    difference, ratio = found
    return difference, ratio, ratio * ratio


def features(text: bytes, pair) -> tuple[float, float] | None:
    """(normalised size difference, log of compressed over plain size), or None without text."""
    if not text or pair is None:
        return None
    good = bad = 0
    for b in blocks(text):
        good += len(pair[0].compress(b))
        bad += len(pair[1].compress(b))
    return (good - bad) / (good + bad), float(np.log((good + bad) / (2 * len(text))))


def fit_curve(rows: list[tuple[tuple[float, float], int]], steps: int = 60, ridge: float = 1e-2):
    """Weights (bias first), means and scales of a ridge logistic regression by Newton steps."""
    y = np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return (), (), ()
    raw = np.array([expanded(r[0]) for r in rows])
    means, scales = raw.mean(axis=0), raw.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(raw)), (raw - means) / scales))
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge * len(y)] * (x.shape[1] - 1)) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w)), tuple(map(float, means)), tuple(map(float, scales))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of ``size`` bytes at most; where the trainer has too little, the samples' own content."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    size = min(size, max(1_024, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def labelled_sample(labels: DataFrame, per_class: int = LABELLED) -> DataFrame:
    """doc_id, quality, fold: at most ``per_class`` labels of each class and training fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
    ).withColumn("fold", fold(F.col("doc_id")))
    rows = {(r["fold"], r["quality"]): r["count"] for r in usable.groupBy("fold", "quality").count().collect()}  # six at most
    out = None
    for k in (FIT_DICTIONARY, FIT_CURVE):
        for q in (0, 1):
            part = smallest(usable.where((F.col("fold") == k) & (F.col("quality") == q)), F.xxhash64("doc_id"), per_class, rows.get((k, q), 0))
            part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
            out = part if out is None else out.unionByName(part)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED, samples: int = SAMPLES) -> Model:
    """``docs``: doc_id and text; ``labels``: doc_id and quality."""
    # equal rows of a document count once; the digest also orders the rows of an id that has several texts
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen = docs.join(F.broadcast(labelled_sample(labels, per_class)), "doc_id").withColumn("digest", digest).dropDuplicates(["doc_id", "digest", "fold", "quality"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (q, b, zlib.crc32(b, d & 0xFFFFFFFF))
                for d, text, q in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)
                for b in blocks(text or b"")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["quality", "block", "draw"])

    pieces = chosen.where(F.col("fold") == FIT_DICTIONARY).select("doc_id", "text", "quality").mapInArrow(cut, "quality int, block binary, draw long")
    found = [
        [bytes(r["block"]) for r in pieces.where(F.col("quality") == q).orderBy("draw", "block").limit(samples).collect()] for q in (1, 0)
    ]
    model = Model(train_dictionary(found[0]), train_dictionary(found[1]), (), (), (), 0.5)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.opened()
        for batch in batches:
            rows = [features(t or b"", pair) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r and r[0] for r in rows], pa.float64()), pa.array([r and r[1] for r in rows], pa.float64()), *batch.columns[1:]],
                names=["difference", "ratio", "quality", "doc_id", "digest"])

    measured = chosen.where(F.col("fold") == FIT_CURVE).select("text", "quality", "doc_id", "digest").mapInArrow(measure, "difference double, ratio double, quality int, doc_id long, digest long")
    # two classes of at most ``per_class`` rows, as numbers, however many rows or texts the labelled ids have
    known = measured.where("difference IS NOT NULL")
    rows = sorted(((r["difference"], r["ratio"]), q) for q in (1, 0) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(per_class).collect())
    weights, means, scales = fit_curve(rows) if rows else ((), (), ())
    prior = sum(q for _, q in rows) / len(rows) if weights else 0.5
    return Model(model.good, model.bad, weights, means, scales, prior)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.opened()
        for batch in batches:
            scores = [model.score(features(t or b"", pair)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    row_id = F.col(id_column).cast("long")
    held_out = F.coalesce(fold(row_id) == HELD_OUT, F.lit(False))
    return docs.select(row_id, F.col(text_column), held_out).mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(slim, train(slim, labels, **bounds))
