"""Quality classifier: ridge regression on random Fourier features of document statistics.

Each text becomes a short vector of statistics. Random cosines of the standardised vector
approximate a Gaussian kernel. Every task sums its part of the normal equations of each training
fold; only the summed matrix (its size is fixed by the number of features) reaches the driver. As folds
add up, leaving one out costs a subtraction: out-of-fold scores of all training rows are counted in
bins of fixed width and an isotonic curve through the bins turns raw scores into probabilities.

The texts are read once; statistics are written to the shared folder and used for training and
scoring. Labels are joined by id to the statistics, never to the texts.

Defined results: a null text counts as empty; every row gets a score. Labels that are null or not 0
or 1 teach nothing; of several labels of a document the largest counts. A row without id is held
out. Without two label classes to learn from every score is the mean label (0.5 without any).
Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.llm.common import map_texts, partition_sums, stored

FOLDS = 5  # of the id's checksum; fold 0 is held out
BINS, LOW, HIGH = 3000, -1.0, 2.0
PUNCTUATION = b"!\"'(),-./:;?[]{}"
MARKS = (b"!", b"?", b"|", b".", b",", b"#", b"&", b"$", b"%", b"*", b"<", b">", b"=", b"{", b"}", b"/", b"_", b"-", b":", b";")


def statistics(text: str) -> list[float]:
    """Statistics of a text; shares lie in 0 to 1, counts are logarithms."""
    raw = text.encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    lines = [line for line in (part.strip() for part in raw.split(b"\n")) if line]
    rows = max(1, len(lines))
    pairs = Counter(zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    lengths = np.fromiter(map(len, words), "f8", len(words)) if words else np.zeros(1)
    line_lengths = np.fromiter(map(len, lines), "f8", len(lines)) if lines else np.zeros(1)
    letters = len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    points = len(raw) - len(raw.translate(None, PUNCTUATION))
    squeezed = len(zlib.compress(raw[:], 1)) / size
    return [
        np.log1p(len(words)), np.log1p(len(raw)), np.log1p(len(lines)),
        float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())),
        len(counts) / n, counts.most_common(1)[0][1] / n if counts else 0.0,
        1 - len(pairs) / max(1, len(words) - 1), 1 - triples / max(1, len(words) - 2),
        1 - len(set(lines)) / rows, np.log1p(float(line_lengths.mean())), np.log1p(float(line_lengths.std())),
        sum(line.endswith((b".", b"!", b"?")) for line in lines) / rows,
        sum(not line[:1].isalnum() and line[0] < 128 for line in lines) / rows,
        upper / size, digits / size, points / size, (size - letters) / size, squeezed,
        (len(raw) - len(text)) / size,
        sum(w.isupper() for w in counts.elements()) / n if upper else 0.0,
        *[raw.count(mark) / n for mark in MARKS],
    ]


STATISTICS = len(statistics(""))


@dataclass(frozen=True)
class Kernel:
    """Random cosines of standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, mean, scale, features: int, width: float, seed: int) -> Kernel:
        draw = np.random.default_rng(seed)
        return cls(mean, scale, draw.normal(0, 1 / width, (len(mean), features)), draw.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), x / 8, z])  # level and linear part beside the kernel


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), "f8").reshape(batch.num_rows, -1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing curve through weighted means."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([b, w, a * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b1, w1, a1 = pools.pop()
            b0, w0, a0 = pools[-1]
            pools[-1] = [(b0 * w0 + b1 * w1) / (w0 + w1), w0 + w1, a0 + a1]
    return np.array([a / w for _, w, a in pools]), np.array([b for b, _, _ in pools])


def fit(train: DataFrame, features: int, width: float, ridge: float, seed: int):
    """Kernel, coefficients and calibration curve from rows ``fold, stats, label``."""
    d = STATISTICS

    def sums(batch):
        x = _matrix(batch)
        return np.r_[len(x), np.asarray(batch.column(batch.schema.get_field_index("label")), "f8").sum(), x.sum(0), (x * x).sum(0)]

    first = partition_sums(train, sums, 2 + 2 * d)
    n, ones = first[0], first[1]
    if not 0 < ones < n:
        return None, None, (np.zeros(1), np.array([ones / n if n else 0.5]))
    mean = first[2:2 + d] / n
    kernel = Kernel.drawn(mean, np.sqrt(np.maximum(first[2 + d:] / n - mean ** 2, 1e-8)), features, width, seed)
    size = 1 + d + features

    def equations(batch):
        x, y = kernel(_matrix(batch)), np.asarray(batch.column(batch.schema.get_field_index("label")), "f8")
        fold = np.asarray(batch.column(batch.schema.get_field_index("fold")))
        out = np.zeros((FOLDS, size, size + 1))
        for f in range(1, FOLDS):
            own = x[fold == f]
            out[f, :, :size], out[f, :, size] = own.T @ own, own.T @ y[fold == f]
        return out.ravel()

    parts = partition_sums(train, equations, FOLDS * size * (size + 1)).reshape(FOLDS, size, size + 1)
    whole = parts.sum(0)

    def solve(m):
        return np.linalg.solve(m[:, :size] + ridge * np.eye(size), m[:, size])

    left_out = np.array([solve(whole - parts[f]) for f in range(FOLDS)])

    def bins(batch):
        x, y = kernel(_matrix(batch)), np.asarray(batch.column(batch.schema.get_field_index("label")), "f8")
        fold = np.asarray(batch.column(batch.schema.get_field_index("fold")))
        raw = np.clip((x * left_out[fold]).sum(1), LOW, HIGH - 1e-9)
        at = ((raw - LOW) / (HIGH - LOW) * BINS).astype(int)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]

    found = partition_sums(train, bins, 2 * BINS)
    held = np.flatnonzero(found[:BINS])
    middle = LOW + (held + 0.5) * (HIGH - LOW) / BINS
    return kernel, solve(whole), isotonic(middle, found[BINS + held] / found[held], found[held])


def quality(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, features: int = 256,
            width: float = 6.0, ridge: float = 0.3, seed: int = 17, cut: float = 0.3) -> DataFrame:
    """``id, held_out, score, predicted`` of every document; learns from labels outside fold 0."""
    stats = map_texts(docs, [id_col], text, lambda: lambda t: (statistics(t),), "stats array<double>")
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0)).cast("int")
    stats = stored(stats.withColumn("fold", fold), "statistics")
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("double").alias("label"))
    train = stored(stats.filter("fold <> 0").join(known, id_col).select("fold", "stats", "label"), "train")
    kernel, weights, (x, y) = fit(train, features, width, ridge, seed)

    def work(batches):
        for batch in batches:
            raw = kernel(_matrix(batch)) @ weights if kernel else np.zeros(batch.num_rows)
            score = np.round(np.clip(np.interp(raw, x, y), 0, 1), 6)
            keep = batch.select([id_col, "fold"])
            held = np.asarray(keep.column(1)) == 0
            yield pa.RecordBatch.from_arrays(
                [keep.column(0), pa.array(held), pa.array(score), pa.array((score >= cut).astype("i4"))],
                names=[id_col, "held_out", "score", "predicted"])

    schema = stats.select(id_col).schema
    for name, kind in (("held_out", "boolean"), ("score", "double"), ("predicted", "integer")):
        schema = schema.add(name, kind)
    return stats.mapInArrow(work, schema)
