"""Lexicon sentiment, model scorers and their confidence handling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidtrend.functions import fixed, text
from vidtrend.functions.scalars import mask_below, three_way
from vidtrend.operators.scale import checked_broadcast
from vidtrend.session import written

NEGATIONS = ("not", "no", "never", "nicht", "kein", "keine")
Scorer = Callable[[pd.Series], pd.DataFrame]
#: Texts that a model gets at a time.
SCORED_ROWS = 64


def lexicon(df: DataFrame, id_col: str, col: str, lexicon: DataFrame, negations: Sequence[str] = NEGATIONS,
            threshold: float = 0.05) -> DataFrame:
    """compound = s / sqrt(s^2 + 15) of summed word valences; label and |compound| as confidence.

    ``lexicon`` has (token, valence). A word after a negation counts with the opposite sign.
    Only words of the lexicon leave the scan side; texts without any score zero.
    """
    marked = text.bind(text.word_tokens(col, 1), lambda words: F.transform(words, lambda w, i: F.struct(
        w.alias("token"), F.when(F.get(words, i - 1).isin(list(negations)), -1.0).otherwise(1.0).alias("sign"))))
    hits = (df.select(id_col, F.explode(marked).alias("m")).select(id_col, "m.token", "m.sign")
            .join(checked_broadcast(lexicon.select("token", "valence")), "token"))
    sums = hits.groupBy(id_col).agg(F.sum(F.col("sign") * F.col("valence")).alias("_s"))
    out = df.join(sums, id_col, "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    out = out.withColumn("compound", F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + fixed.VALENCE_NORM)).drop("_s")
    return out.withColumns({
        "sentiment": three_way("compound", -threshold, threshold, ("negative", "neutral", "positive"), closed=True),
        "confidence": F.abs("compound")})


def lexicon_column(col: str | Column, valences: Mapping[str, float]) -> Column:
    """Compound score for a short literal lexicon, without a join."""
    table = F.create_map(*[F.lit(x) for kv in valences.items() for x in kv])
    known = F.filter(text.word_tokens(col, 1), lambda w: w.isin(list(valences)))
    total = F.aggregate(known, F.lit(0.0), lambda a, w: a + table[w])
    return total / F.sqrt(total * total + fixed.VALENCE_NORM)


def score(df: DataFrame, col: str, scorer: Callable[[], Scorer], min_conf: float = fixed.MIN_CONFIDENCE,
          drop_errors: bool = False) -> DataFrame:
    """Label and confidence from a model, loaded once per Python worker, in slices of Arrow batches.

    A batch holds thousands of whole texts, and what a model makes of a text is many times as large, so it
    gets ``SCORED_ROWS`` of them at a time. ``scorer()`` returns a function from a text series to a frame (sentiment, confidence). A text
    the model cannot score gets the label ``error``. Labels below ``min_conf`` become null.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField("raw_sentiment", T.StringType()), T.StructField("confidence", T.DoubleType())])
    slice_rows = SCORED_ROWS

    def one(model: Scorer, value) -> pd.DataFrame:
        try:
            return model(pd.Series([value]))
        except Exception:  # noqa: BLE001
            return pd.DataFrame({"sentiment": ["error"], "confidence": [0.0]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                texts = batch.column(batch.schema.names.index(col)).to_pandas()
                try:
                    result = model(texts)
                except Exception:  # noqa: BLE001 - one bad text must not lose its batch
                    result = pd.concat([one(model, t) for t in texts], ignore_index=True)
                added = [pa.array(result["sentiment"].to_numpy(), pa.string(), from_pandas=True),
                         pa.array(result["confidence"].to_numpy(dtype="float64"), pa.float64(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "raw_sentiment", "confidence"])

    scored = df.mapInArrow(run, schema)
    if drop_errors:
        scored = scored.filter(F.col("raw_sentiment") != "error")
    return scored.withColumn("sentiment", mask_below("raw_sentiment", "confidence", min_conf))


def lexicon_scorer(valences: Mapping[str, float]) -> Callable[[], Scorer]:
    """A small in-task scorer for the hook (whole texts, compound score as confidence)."""
    words = dict(valences)

    def load() -> Scorer:
        def apply(texts: pd.Series) -> pd.DataFrame:
            total = texts.str.lower().str.findall(r"[^\W]+").map(lambda ws: sum(words.get(w, 0.0) for w in ws))
            compound = total / (total * total + fixed.VALENCE_NORM) ** 0.5
            label = pd.Series("neutral", index=texts.index).mask(compound >= 0.05, "positive").mask(
                compound <= -0.05, "negative")
            return pd.DataFrame({"sentiment": label, "confidence": compound.abs()})
        return apply
    return load


def train_classifier(df: DataFrame, tokens: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """Text classifier for a labelled table; hashed terms need no driver-side vocabulary.

    The hashed terms are written once: the weights of the terms and every step of the fit read them, not the texts.
    """
    hashing = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features)
    hashed = written(hashing.transform(df.select(tokens, label)).select("_tf", label))
    fitted = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(labelCol=label, maxIter=30, regParam=0.01)]).fit(hashed)
    return PipelineModel(stages=[hashing, *fitted.stages])


def classify(model: PipelineModel, df: DataFrame, labels: Sequence[str], min_conf: float = 0.0) -> DataFrame:
    out = model.transform(df).withColumn("confidence", F.array_max(vector_to_array("probability")))
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumn("raw_sentiment", F.get(names, F.col("prediction").cast("int"))).withColumn(
        "sentiment", mask_below("raw_sentiment", "confidence", min_conf))
