"""Severity of toxic language: cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings (4 to 7 letters, so that inflected and compounded forms
count) that occur in toxic training documents clearly more often than elsewhere (likelihood ratio).
The model is P(severity <= j) = sigmoid(threshold_j - w x) with one weight vector for all ordered
thresholds. Given labels only say toxic or not; the grades of toxic training documents follow the
number of selected terms in them (``GRADE_CUTS``). The result is the expected severity.

Training uses at most about ``max_rows`` labelled rows, chosen by a hash of the id. Each evaluation of
the likelihood is a Spark job whose tasks sum their part of the gradient; the vocabulary has at most
``max_terms`` terms, the sizes on the driver. Scoring reads each whole text once, without a shuffle.

Defined results: a null or empty text has the severity of a text without any term. Labels that are
null or not 0 or 1 teach nothing; of several labels of a document the largest counts. Without both
classes to learn from nothing is toxic and severity is 0. Repeated rows give repeated results; extra
columns are ignored (or kept, where the caller names them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.llm.common import map_texts, partition_sums, slices, stored

GRADE_CUTS = (3, 6)  # terms from which a toxic document has grade 2 and 3
GRADES = len(GRADE_CUTS) + 1
STEMS = (4, 5, 6, 7)
COUNTED = 100_000
_SPLIT = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


def words(text: str) -> Counter:
    return Counter(text.lower().encode().translate(_SPLIT).decode().split())


def features(counts: Counter) -> Counter:
    """Counts of words and of word beginnings (written with a star)."""
    out = Counter(counts)
    for word, n in counts.items():
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    heads: frozenset = frozenset()

    def __post_init__(self):
        self.heads = frozenset(t.rstrip("*")[:min(STEMS)] for t in self.terms)

    def row(self, text: str) -> tuple[list[int], list[float], int]:
        """Indices and values of the terms in a text, and the number of words with a term."""
        low, heads = min(STEMS), self.heads
        found = Counter({w: n for w, n in words(text).items() if w[:low] in heads})
        at = {self.terms[t]: n for t, n in features(found).items() if t in self.terms}
        hits = sum(n for w, n in found.items()
                   if w in self.terms or any(w[:s] + "*" in self.terms for s in STEMS if len(w) > s))
        return list(at), [1 + float(np.log(n)) for n in at.values()], hits

    def severity(self, text: str) -> tuple[float, float, int]:
        """Expected severity, probability of any severity, likeliest grade."""
        at, values, _ = self.row(text)
        eta = float(np.dot(self.weights[at], values)) if at else 0.0
        over = 1 / (1 + np.exp(np.clip(self.thresholds - eta, -500, 500)))
        grades = np.r_[1 - over[0], over[:-1] - over[1:], over[-1]]
        return round(float(over.sum()), 6), round(float(over[0]), 6), int(grades.argmax())


def choose_terms(train: DataFrame, least: float, max_terms: int) -> list[str]:
    """Terms by likelihood ratio between toxic and other training documents."""
    def counted(toxic, other):
        keys = list(toxic | other)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())],
            names=["term", "a", "b"])

    def work(batches):
        toxic, other = Counter(), Counter()
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                (toxic if row["label"] else other).update(features(words(row["text"] or "")).keys())
            if len(toxic) + len(other) > COUNTED:  # a task holds a bounded table; the rest is summed after the shuffle
                yield counted(toxic, other)
                toxic, other = Counter(), Counter()
        yield counted(toxic, other)

    totals = train.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = float(totals[0] or 0), float(totals[1] or 0)
    if not n1 or not n0:
        return []
    counts = (train.select("label", "text").mapInArrow(work, "term string, a bigint, b bigint")
              .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (share * n))).otherwise(0.0)
    ratio = 2 * (part("a", n1) + part("b", n0))
    chosen = (counts.filter((F.col("a") >= 3) & (F.col("a") / n1 > 2 * F.col("b") / n0)).withColumn("ratio", ratio)
              .filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(max_terms))
    return [r.term for r in chosen.collect()]


def _loss(rows: DataFrame, terms: int, params: np.ndarray, penalty: float):
    """Penalised negative log-likelihood per row and its gradient."""
    weights, gaps = params[:terms], params[terms:]
    steps = np.r_[gaps[0], np.exp(gaps[1:])]
    thresholds = np.cumsum(steps)
    edges = np.r_[-np.inf, thresholds, np.inf]

    def part(batch):
        at, values = batch.column(0), batch.column(1)
        sizes = np.asarray(at.value_lengths())
        index, value = np.asarray(at.flatten()), np.asarray(values.flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        eta = np.bincount(row, weights[index] * value, len(sizes)) if len(index) else np.zeros(len(sizes))
        grade = np.asarray(batch.column(2))
        upper, lower = (1 / (1 + np.exp(np.clip(eta - edges[grade + k], -500, 500))) for k in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper), lower * (1 - lower)
        slope = (d_up - d_low) / p
        out = np.zeros(2 + terms + GRADES)
        out[0], out[1] = -np.log(p).sum(), len(sizes)
        if len(index):
            out[2:2 + terms] = np.bincount(index, slope[row] * value, terms)
        np.add.at(out, 2 + terms + np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -d_up / p, 0))
        np.add.at(out, 2 + terms + np.maximum(grade - 1, 0), np.where(grade > 0, d_low / p, 0))
        return out

    sums = partition_sums(rows, part, 2 + terms + GRADES)
    n = max(1.0, sums[1])
    by_threshold = sums[2 + terms:] / n
    tail = np.cumsum(by_threshold[::-1])[::-1] * np.r_[1, np.exp(gaps[1:])]
    gradient = np.r_[sums[2:2 + terms] / n + penalty * weights, tail]
    return sums[0] / n + 0.5 * penalty * float(weights @ weights), gradient


def minimise(loss, start: np.ndarray, rounds: int, tolerance: float = 1e-5, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    x, (value, slope), past = start, loss(start), []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        q, trail = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            trail.append((a, s, y))
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0
        for a, s, y in reversed(trail):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0 if past else min(1.0, 1 / np.abs(q).max())
        while True:
            new = loss(x - step * q)
            if new[0] <= value - 1e-4 * step * float(q @ slope) or step < 1e-6:
                break
            step /= 4
        s, y = -step * q, new[1] - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(value - new[0]) < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + s, *new
        if done:
            break
    return x


def train_model(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_rows: int = 20_000,
                least: float = 24.0, max_terms: int = 2048, penalty: float = 3e-5, rounds: int = 50) -> Model | None:
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    known = stored(known.filter(F.col(id_col).isNotNull()), "labels")
    share = max_rows / max(1, known.count())
    sample = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    # at most about max_rows ids: the bound that makes this broadcast safe
    train = stored(docs.select(id_col, F.col(text).cast("string").alias("text")).join(F.broadcast(sample), id_col)
                   .select("label", "text"), "train")
    terms = choose_terms(train, least, max_terms)
    if not terms:
        return None
    model = Model({t: i for i, t in enumerate(terms)}, np.zeros(len(terms)), np.arange(GRADES, dtype=float))

    def rows(batches):
        for batch in slices(batches):
            found = [model.row(t or "") for t in batch.column(1).to_pylist()]
            grades = [y and 1 + sum(hits >= c for c in GRADE_CUTS) for y, (_, _, hits) in zip(batch.column(0).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())),
                 pa.array(grades, pa.int32())], names=["at", "value", "grade"])

    sparse = stored(train.mapInArrow(rows, "at array<int>, value array<double>, grade int"), "sparse")
    start = np.r_[np.zeros(len(terms)), 2.0, np.zeros(GRADES - 1)]
    params = minimise(lambda p: _loss(sparse, len(terms), p, penalty), start, rounds)
    model.weights = params[:len(terms)]
    model.thresholds = np.cumsum(np.r_[params[len(terms)], np.exp(params[len(terms) + 1:])])
    return model


def score(docs: DataFrame, text: str, keep: Sequence[str], model: Model | None, cut: float = 0.5, prefix: str = "") -> DataFrame:
    """``keep`` columns with ``severity, toxic_probability, grade, toxic`` (after ``prefix``) of each text."""
    def per_text():
        def run(text):
            found = model.severity(text) if model else (0.0, 0.0, 0)
            return *found, found[1] >= cut
        return run

    return map_texts(docs, list(keep), text, per_text, f"{prefix}severity double, {prefix}toxic_probability double, "
                     f"{prefix}grade int, {prefix}toxic boolean")
