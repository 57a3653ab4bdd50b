"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cartlight.llm.rows import others
from cartlight.llm.scratch import Scratch

# Rows of either kind that the classifier is fitted on at most: those with the smallest hash of doc_id and text.
SAMPLE = 10_000
# Kinds of bytes whose shares, and whose shares of neighbouring pairs, describe a text.
_KINDS = {
    0: b" ", 1: b"\n", 4: b"0123456789", 5: b".,;:", 6: b"!?", 7: b"'\"()-", 9: b"\t\r", 10: b"|",
    11: b"@/\\<>[]{}=_+`~^", 12: b"#$%&*",
}
_N = 14
_BLOCK = 1 << 20


def _kind_table() -> np.ndarray:
    table = np.full(256, 13, np.uint8)
    table[128:] = 8
    table[97:123], table[65:91] = 2, 3
    for kind, chars in _KINDS.items():
        table[list(chars)] = kind
    return table


_TABLE = _kind_table()


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte kinds and of pairs of kinds over the whole text, and its length, word and line measures."""
    data = np.frombuffer(text or b"", np.uint8)
    one, two = np.zeros(_N), np.zeros(_N * _N)
    for at in range(0, len(data), _BLOCK):  # a block at a time, with the next byte for the pair
        kinds = _TABLE[data[at : at + _BLOCK + 1]].astype(np.int64)
        one += np.bincount(kinds[:_BLOCK], minlength=_N)
        two += np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N)
    n = max(len(data), 1)
    pairs = two.reshape(_N, _N)
    space = [0, 1, 9]
    ends = pairs[:, space].sum() - pairs[np.ix_(space, space)].sum()
    words, lines = ends + 1, one[1] + 1
    more = [np.log1p(len(data)), np.log1p(words), np.log1p(lines), words / lines / 50, len(data) / words / 10]
    return np.concatenate([one / n, two / n, more])


@dataclass
class QualityModel:
    """A linear score over standardised features; ``prior`` is the estimated share of good text."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(rows, self.center, self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _design(rows: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and a constant, in the precision of the rows."""
    made = np.empty((len(rows), rows.shape[1] + 1), rows.dtype)
    np.subtract(rows, center.astype(rows.dtype), out=made[:, :-1])
    made[:, :-1] /= scale.astype(rows.dtype)
    np.clip(made, -4, 4, out=made)
    made[:, -1] = 1
    return made


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores that tell the two samples apart.

    Above a threshold that nearly all positives pass, the unlabelled pass at least ``prior`` times as often; the
    smallest such ratio over thresholds that 70 to 99 percent of the positives pass is taken.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 0.3, 30))
    ratio = [(unlabelled >= t).mean() / (positive >= t).mean() for t in cuts]
    return float(np.clip(min(ratio), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 500, ridge: float = 1e-4) -> QualityModel:
    """Minimise prior * E+[loss of +] + max(0, Eu[loss of -] - prior * E+[loss of -]) with the logistic loss.

    Where the second part, an unbiased estimate of a risk, falls below zero, only it is raised again, so that it is not
    fitted further.
    """
    center, scale = unlabelled.mean(axis=0, dtype=float), unlabelled.std(axis=0, dtype=float) + 1e-4
    p, u = _design(positive, center, scale), _design(unlabelled, center, scale)

    def scores(w):
        w = w.astype(p.dtype)
        return (p @ w).astype(float), (u @ w).astype(float)

    def mean(rows, values):
        return (values.astype(rows.dtype) @ rows).astype(float) / len(rows)

    def apart(w):
        zp, zu = scores(w)
        return mean(p, _sigmoid(zp) - 1) + mean(u, _sigmoid(zu)) + ridge * w

    split = _descend(apart, p.shape[1], steps // 2)
    prior = estimate_prior(*scores(split))

    def risk(w):
        zp, zu = scores(w)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        against = mean(u, _sigmoid(zu)) - prior * mean(p, _sigmoid(zp))
        if negative < 0:
            return -against + ridge * w
        return prior * mean(p, _sigmoid(zp) - 1) + against + ridge * w

    return QualityModel(center, scale, _descend(risk, p.shape[1], steps), prior)


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """Fit on trusted positives (quality 1) and unlabelled texts, neither of them held out.

    Unlabelled texts are drawn from all rows, whether they have a label or not. Of either kind, the ``sample`` rows with
    the smallest hash of doc_id and text are used, equal rows once; only their features come to the driver, so
    at most twice ``sample`` rows, however often an id repeats. Without positives there is no model. Conflicting labels of a
    document count as 0; labels without a text are ignored, and rows without doc_id have none.
    """
    scratch = Scratch(documents.sparkSession, "quality-fit")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("quality"))
    marks = scratch.keep(marks.filter("quality = 1").select("doc_id"), "good")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keyed = texts.filter(~held_out()).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")

    def smallest(rows: DataFrame, kind: str) -> DataFrame:
        some = rows.select("key").distinct().orderBy("key").limit(sample)
        return some.select("key", *[F.lit(kind == k).alias(k) for k in ("good", "plain")])

    good = smallest(keyed.join(marks, "doc_id", "left_semi"), "good")
    wanted = good.unionByName(smallest(keyed, "plain")).groupBy("key").agg(
        F.bool_or("good").alias("good"), F.bool_or("plain").alias("plain"))
    wanted = scratch.keep(wanted, "wanted")  # at most twice ``sample`` rows

    def describe(batches):
        for batch in batches:
            made = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "good", "plain")), pa.array(made, pa.binary())], ["key", "good", "plain", "x"])

    chosen = keyed.join(F.broadcast(wanted), "key").groupBy("key", "good", "plain").agg(F.any_value("text").alias("text"))
    found = chosen.mapInArrow(describe, "key bigint, good boolean, plain boolean, x binary").toArrow()
    scratch.drop(marks, wanted)
    order = np.argsort(found["key"].to_numpy())
    kinds = {k: order[found[k].to_numpy()[order]] for k in ("good", "plain")}
    if not len(kinds["good"]):
        return None
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(len(order), -1)
    del found
    return fit(x[kinds["good"]], x[kinds["plain"]])


def score_quality(documents: DataFrame, model: QualityModel | None) -> DataFrame:
    """``row`` (the other columns of ``documents``), ``text`` (bytes) and ``score`` from 0 to 1 of every whole text.

    Only the text enters the score. Null and empty texts are scored as texts without bytes; without a model, every
    score is 0.5.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            fitted, texts = shared.value, batch.column("text").to_pylist()
            made = np.full(len(texts), 0.5)
            if fitted is not None and texts:
                made = fitted.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], ["row", "text", "score"])

    rows = documents.select(others(documents), F.col("text").cast("binary").alias("text"))
    schema = rows.select("row", "text", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(score, schema)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every row of ``documents``."""
    Scratch(documents.sparkSession, "quality")
    two = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score_quality(two, fit_quality(documents, labels, sample)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
