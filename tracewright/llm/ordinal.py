"""Severity of toxic text by cumulative-link ordinal regression on sparse features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_1 <= t_2 ...; the
expected grade is the sum of these probabilities. Features are the distinct words of the
whole text and their beginnings. The model is fitted on a bounded sample of labelled rows, every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import unit_hash, words

GRADES = 3
_STRIP = b".,;:!?\"'()[]"


@dataclass(frozen=True)
class FitRule:
    """``rows`` bounds the labelled documents that are fitted, chosen by a hash of the id.
    Words in fewer than ``min_docs`` of them are no features. ``l1`` drives weights of words without
    influence to zero, ``l2`` keeps those of the others finite. ``lift`` is how much more frequent in toxic than in other documents a word
    must be to count for the severity of a label. A document is flagged from ``flag`` = P(grade >= 1) on."""
    rows: int = 8000
    min_docs: int = 5
    l1: float = 3e-3
    l2: float = 1e-4
    steps: int = 150
    lift: float = 4.0
    seed: int = 11
    flag: float = 0.4


@dataclass(frozen=True)
class Model:
    keys: np.ndarray            # sorted hashes of the words with a weight
    weights: np.ndarray
    thresholds: np.ndarray      # one per grade above 0

    def severity(self, hashes: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of a document given by its distinct word hashes."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        score = self.weights[at][self.keys[at] == hashes].sum() if len(self.keys) else 0.0
        return sigmoid(score - self.thresholds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, float)))


def features(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct words, without punctuation around them, and of their
    distinct beginnings (four bytes, marked), which inflected words share."""
    distinct = {w.strip(_STRIP) for w in set(words(text))} - {b""}
    digest = xxhash.xxh64_digest
    heads = {b"^" + w[:4] for w in distinct if len(w) > 4}
    return np.unique(np.frombuffer(b"".join([digest(w) for w in distinct | heads]), ">u8").astype(np.uint64))


def sample(docs: DataFrame, labels: DataFrame, rule: FitRule = FitRule()) -> DataFrame:
    """features, toxic of at most ``rule.rows`` labelled documents; of several texts of one id the smallest."""
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(unit_hash(F.col("_id"), rule.seed), "_id").limit(rule.rows))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "features": [features(t).view(np.int64) for t in b["text"]],
                                "toxic": b["toxic"]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return joined.mapInPandas(work, "doc_id long, features array<long>, toxic int")


def grade_labels(rows: list[np.ndarray], toxic: np.ndarray, rule: FitRule) -> np.ndarray:
    """Grades 0..2 from the yes/no label: a toxic document is severe (2) if it holds more distinct words that
    are typical of toxic documents than the median toxic document does, else mild (1)."""
    if not toxic.any() or toxic.all():
        return toxic.astype(int)
    total = np.concatenate([r for r, t in zip(rows, toxic) if t])
    typical, n = np.unique(total, return_counts=True)
    other, m = np.unique(np.concatenate([r for r, t in zip(rows, toxic) if not t]), return_counts=True)
    at = np.minimum(np.searchsorted(other, typical), max(len(other) - 1, 0))
    seen = np.where(other[at] == typical, m[at], 0) if len(other) else np.zeros(len(typical))
    rate, base = (n + 0.5) / (toxic.sum() + 1), (seen + 0.5) / ((~toxic).sum() + 1)
    lexicon = typical[(n >= rule.min_docs) & (rate > rule.lift * base)]
    held = np.array([np.isin(r, lexicon, assume_unique=True).sum() for r in rows])
    return np.where(toxic, 1 + (held > np.median(held[toxic])), 0)


def fit(rows: list[np.ndarray], grades: np.ndarray, rule: FitRule = FitRule()) -> Model:
    """Cumulative-link model: a fit with an L1 term chooses the words, a second one without it
    gives them their weights."""
    n = len(rows)
    keys, counts = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_counts=True)
    keys = keys[counts >= rule.min_docs]
    least = 0.5 / (n + 10)                       # so that without labels nothing is flagged
    share = np.clip([float((grades >= k).mean()) if n else 0.0 for k in range(1, GRADES)], least, 1 - least)
    thresholds = np.maximum.accumulate(-np.log(share / (1 - share)))
    if not n or not len(keys) or len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), thresholds)
    columns, row_of = [], []
    for i, r in enumerate(rows):
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        at = at[keys[at] == r]
        columns.append(at)
        row_of.append(np.full(len(at), i))
    col, row = np.concatenate(columns), np.concatenate(row_of)
    target = np.stack([(grades >= k).astype(float) for k in range(1, GRADES)], 1)
    w, _ = _solve(col, row, n, len(keys), target, thresholds, rule.l1, 0.0, rule.steps)
    used = np.flatnonzero(w)
    if not len(used):
        return Model(np.zeros(0, np.uint64), np.zeros(0), thresholds)
    place = np.full(len(keys), -1)
    place[used] = np.arange(len(used))
    on = place[col] >= 0
    w, thresholds = _solve(place[col[on]], row[on], n, len(used), target, thresholds, 0.0, rule.l2, 2 * rule.steps)
    return Model(keys[used], w, thresholds)


def _solve(col: np.ndarray, row: np.ndarray, n: int, width: int, target: np.ndarray, thresholds: np.ndarray,
           l1: float, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient for the weights; the thresholds are solved by damped Newton steps for every score
    before its gradient is taken, so the steps see a function of the weights alone."""
    def solved(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        for _ in range(20):
            p = sigmoid(score[:, None] - thresholds)
            move = np.clip((p - target).sum(0) / np.maximum((p * (1 - p)).sum(0), 1e-9), -1, 1)
            thresholds = thresholds + move
            if np.abs(move).max() < 1e-9:
                break
        return np.maximum.accumulate(thresholds)

    # the squared norm of the data matrix, by power iteration, bounds the curvature
    v = np.ones(width)
    norm = 1.0
    for _ in range(20):
        v = np.bincount(col, np.bincount(row, v[col], n)[row], width)
        norm = max(float(np.linalg.norm(v)), 1e-12)
        v /= norm
    levels = target.shape[1]
    rate = 1.0 / (norm * levels / (4.0 * n) + l2)
    w, y, momentum = np.zeros(width), np.zeros(width), 1.0
    for _ in range(steps):
        score = np.bincount(row, y[col], n)
        thresholds = solved(score, thresholds)
        error = sigmoid(score[:, None] - thresholds) - target
        step = y - rate * (np.bincount(col, error.sum(1)[row], width) / n + l2 * y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0.0)
        after = 0.5 * (1 + np.sqrt(1 + 4 * momentum ** 2))
        y, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w, solved(np.bincount(row, w[col], n), thresholds)


def train(docs: DataFrame, labels: DataFrame, rule: FitRule = FitRule()) -> Model:
    """Fit on the sample, in one task: it holds at most ``rule.rows`` lists of features. Only the
    words with a weight come to the driver."""
    def work(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("doc_id", kind="stable")
        rows = [np.asarray(r, np.int64).view(np.uint64) for r in got["features"]]
        toxic = got["toxic"].to_numpy(int) > 0
        model = fit(rows, grade_labels(rows, toxic, rule), rule)
        return pd.DataFrame({"keys": [model.keys.view(np.int64)], "weights": [model.weights],
                             "thresholds": [model.thresholds]})

    found = sample(docs, labels, rule).groupBy().applyInPandas(
        work, "keys array<long>, weights array<double>, thresholds array<double>").collect()
    if not found:
        return fit([], np.zeros(0, int), rule)
    return Model(np.array(found[0]["keys"], np.int64).view(np.uint64), np.array(found[0]["weights"], float),
                 np.array(found[0]["thresholds"], float))


def score(docs: DataFrame, model: Model, flag: float = FitRule.flag) -> DataFrame:
    """Every row: doc_id, p_mild (P(grade >= 1)), p_severe (P(grade >= 2)), severity (their
    sum), grade (most probable), toxic (p_mild >= flag). Null or empty texts have no features."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.array([model.severity(features(t)) for t in b["text"]]).reshape(-1, GRADES - 1)
            each = np.column_stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "p_mild": p[:, 0], "p_severe": p[:, 1],
                                "severity": p.sum(1), "grade": each.argmax(1).astype(np.int32), "toxic": p[:, 0] >= flag})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        work, "doc_id long, p_mild double, p_severe double, severity double, grade int, toxic boolean")


def severity(docs: DataFrame, labels: DataFrame, rule: FitRule = FitRule()) -> DataFrame:
    """Train on the labelled rows and score every row of ``docs``. Without labels of both kinds all
    documents get the base rate; labels without a document and null labels are ignored; of a label given twice
    the higher one counts; an empty table gives an empty result; other columns are ignored."""
    return score(docs, train(docs, labels, rule), rule.flag)
