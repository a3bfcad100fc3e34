"""Language identification and language distributions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.operators import aggregates

# trigrams are counted in tasks, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters and texts that a task counts at a time, and trigrams it remembers before it starts anew; none changes a result.
CHARS, TEXTS, REMEMBERED = 1 << 20, 256, 200_000
#: Trigram codes that a table may hold; beyond that they are sorted.
TABLE = 1 << 22


def _hash(data: bytes) -> int:
    """Murmur3 (32 bits, seed 42) as an unsigned number, as ``HashingTF`` takes it."""
    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF

    h = 42
    whole = len(data) - len(data) % 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i:i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= mixed(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _bucket(trigram: str, features: int) -> int:
    """``HashingTF``'s feature of the three characters joined by blanks."""
    h = _hash(" ".join(trigram).encode())
    return (h - (1 << 32) if h >> 31 else h) % features


def _trigram_counts(texts: list[str], features: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries per text, feature, count), features ascending within a text."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:-2] == owner[2:]
    present = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    place = np.cumsum(present) - 1
    at, k = place[codes], max(len(letters), 1)
    tri = ((at[:-2] * k + at[1:-1]) * k + at[2:])[inside]
    if k ** 3 <= TABLE:
        seen = np.zeros(k ** 3, dtype=bool)
        seen[tri] = True
        distinct = np.flatnonzero(seen)
        number = np.cumsum(seen) - 1
        number = number[tri]
    else:
        distinct, number = np.unique(tri, return_inverse=True)
    if len(known) + len(distinct) > REMEMBERED:
        known.clear()
    buckets = np.empty(len(distinct), dtype=np.int64)
    for i, (a, b, c) in enumerate(zip(letters[distinct // (k * k)].tolist(), letters[distinct // k % k].tolist(), letters[distinct % k].tolist())):
        gram = chr(a) + chr(b) + chr(c)
        if gram not in known:
            known[gram] = _bucket(gram, features)
        buckets[i] = known[gram]
    counts = np.bincount(owner[:-2][inside] * features + buckets[number], minlength=len(texts) * features)
    entries = np.flatnonzero(counts)
    return np.bincount(entries // features, minlength=len(texts)), entries % features, counts[entries]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t) > CHARS or i - start >= TEXTS):
            yield texts[start:i]
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield texts[start:]


def _trigram_vectors(features: int) -> Callable[[Column], Column]:
    """Arrow function: the sparse vector of hashed trigram counts of each text."""
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    @F.arrow_udf(VectorUDT())
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            parts = [_trigram_counts(texts, features, known) for texts in _slices(batch.to_pylist())]
            sizes, indices, values = ([np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 3)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            n = len(batch)
            yield pa.StructArray.from_arrays([
                pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, features), pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(indices, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(values, pa.float64()))], fields=list(kind))
    return vectors


def _trigrams(df: DataFrame, col: str, features: int) -> DataFrame:
    """Hashed counts of character trigrams; a null text counts as one without letters."""
    letters = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}]+", "_")
    return df.withColumn("features", _trigram_vectors(features)(F.concat(F.lit("_"), letters, F.lit("_"))))


def train(df: DataFrame, col: str, label: str, features: int = 1 << 12) -> PipelineModel:
    """Naive Bayes on hashed character trigrams of a labelled table.

    Trigrams are counted a batch of texts at a time, as numbers; a string for each one costs many times more.
    """
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    indexed = index.fit(df)
    model = Pipeline(stages=[indexed, NaiveBayes(labelCol="_label")]).fit(_trigrams(df.select(label, col), col, features))
    decode = IndexToString(inputCol="prediction", outputCol="detected_language", labels=indexed.labels)
    return PipelineModel(stages=model.stages[1:] + [decode])


def detect(model: PipelineModel, df: DataFrame, col: str, out: str = "detected_language") -> DataFrame:
    """Language of each text; null where the text has no letters."""
    tagged = model.transform(_trigrams(df, col, model.stages[0].numFeatures))
    has_letters = F.regexp_like(F.col(col), F.lit(r"\p{L}"))
    return tagged.withColumn(out, F.when(has_letters, F.col("detected_language"))).drop(
        "features", "rawPrediction", "probability", "prediction")


def compare_distributions(df: DataFrame, text_lang: str, spoken_lang: str, k: int = 5) -> DataFrame:
    """Top languages of the text column and of the spoken column next to each other."""
    side = lambda c, n: aggregates.value_shares(df, c).orderBy(F.desc("n"), c).limit(k).select(
        F.col(c).alias("language"), F.col("share").alias(n))
    return side(text_lang, "text_share").join(side(spoken_lang, "spoken_share"), "language", "full_outer").na.fill(0.0)
