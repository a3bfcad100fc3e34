"""Viral score, post features, models of success and their explanations."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, IDF, Normalizer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.functions.scalars import calendar_fields, hours_between, in_zone, period_of_day, ratio
from vidtrend.operators import aggregates, windows
from vidtrend.operators.filters import quantile_keys
from vidtrend.operators.scale import calendar_broadcast, exact_quantiles, with_quantiles
from vidtrend.session import cut_lineage, ensure_checkpoint_dir

# trees travel with the job, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = {"view_engagement": 0.3, "comment_velocity": 0.25, "commenter_diversity": 0.25, "relative_engagement": 0.2}


def viral_score(posts: DataFrame, rollup: DataFrame, post: str = "post_id", ts: str = "createTimeISO") -> DataFrame:
    """Engagement and comment ratios, weighted z-score and a top-20-percent flag per post.

    ``rollup`` has comments, first_comment, last_comment, likes_sum and distinct_users per post.
    """
    # written once: the hourly means, the deviations and the scores all read it
    df = cut_lineage(posts.join(rollup, post, "left").na.fill(0, ["comments", "likes_sum", "distinct_users"]))
    df = df.withColumns({
        "hour_of_day": F.hour(ts),
        "hours_to_first": hours_between("first_comment", ts),
        "comment_span": hours_between("last_comment", "first_comment")})
    hourly = df.groupBy("hour_of_day").agg(F.avg("diggCount").alias("_hour_mean"))  # 24 rows
    df = df.join(calendar_broadcast(hourly), "hour_of_day")
    df = df.withColumns({
        "engagement_velocity": ratio("diggCount", "hours_to_first"),
        "comment_velocity": ratio("comments", "comment_span"),
        "relative_engagement": ratio("diggCount", "_hour_mean"),
        "view_engagement": ratio(F.col("diggCount") + F.col("shareCount") + F.col("comments"), "playCount"),
        "commenter_diversity": ratio("distinct_users", "comments"),
        "like_share": ratio("diggCount", "shareCount"),
        "comment_like": ratio("comments", "diggCount"),
        "author_engagement": ratio("diggCount", "author_fans"),
        "amplification": F.col("shareCount") * F.log1p("author_fans"),
        "comment_engagement": ratio("likes_sum", "comments")}).drop("_hour_mean")
    scaled = windows.z_normalised(df, list(WEIGHTS))
    score = sum(F.col(f"{c}_z") * w for c, w in WEIGHTS.items())
    scored = scaled.withColumn("viral_score", score).drop(*[f"{c}_z" for c in WEIGHTS])
    return scored


def with_trending_flag(scored: DataFrame, col: str = "viral_score", prob: float = 0.8) -> DataFrame:
    """Flags the top share; a row without a score (a post without comments) stays, unflagged."""
    scored = cut_lineage(scored)  # read for the quantile and for the result
    cut = exact_quantiles(scored, col, [prob]).scalar()
    return scored.withColumn("is_trending", F.coalesce(F.col(col) >= cut, F.lit(False)))


NUMERIC = ("author_fans", "video_duration", "word_count", "sentence_count", "avg_word_length", "exclamation_count",
           "question_count", "hour_posting", "day_of_week", "is_weekend", "is_ad", "is_sponsored", "hashtag_count",
           "period_evening", "period_morning", "period_night")


def features(df: DataFrame, col: str = "text", ts: str = "createTimeISO", zone: str = "Europe/Berlin",
             stop: Sequence[str] = ()) -> DataFrame:
    """Numeric, calendar, text and token columns of a post; one narrow projection."""
    local = in_zone(ts, zone)
    fields = calendar_fields(local)
    stats = text.statistics(col)
    return df.withColumns({
        **{k: v.cast("double") for k, v in stats.items()},
        "hour_posting": fields["hour"].cast("double"), "day_of_week": fields["day_of_week"].cast("double"),
        "is_weekend": fields["is_weekend"].cast("double"), "is_ad": F.col("isAd").cast("double"),
        "is_sponsored": F.col("isSponsored").cast("double"), "period_of_day": period_of_day(fields["hour"]),
        # one-hot without the first level (afternoon), so the columns do not sum to one
        **{f"period_{p}": (period_of_day(fields["hour"]) == p).cast("double") for p in ("evening", "morning", "night")},
        "tags": text.hashtags(col), "hashtag_count": F.size(text.hashtags(col)).cast("double"),
        "tokens": text.clean_tokens(col, stop, keep="#?!", max_run=2),
        "viral_target": F.log1p("playCount")})


def popular_tags(df: DataFrame, post: str = "post_id", prob: float = 0.99) -> DataFrame:
    """Posts with their tags reduced to those whose use reaches the quantile."""
    tags = df.select(post, F.explode("tags").alias("tag"))
    kept = tags.join(quantile_keys(tags, "tag", prob).select("tag"), "tag", "left_semi").distinct()
    lists = kept.groupBy(post).agg(F.array_sort(F.collect_list("tag")).alias("popular_tags"))
    return df.join(lists, post, "left").withColumn("popular_tags", F.coalesce("popular_tags", F.array().cast("array<string>")))


class Vocabulary(Estimator):
    """The most frequent terms of an array column as a ``CountVectorizerModel``; ties go to the smaller term.

    ``CountVectorizer`` keeps all terms of a partition in one block; here they are counted by a grouping that combines
    before the shuffle. ``min_df`` and ``max_df`` below 1 are shares of the rows, as there.
    """

    def __init__(self, terms: str, out: str, size: int | None = None, min_df: float = 1.0, max_df: float = 2.0 ** 63, binary: bool = False):
        super().__init__()
        self.terms, self.out, self.size, self.min_df, self.max_df, self.binary = terms, out, size, min_df, max_df, binary

    def _fit(self, df: DataFrame) -> CountVectorizerModel:
        rows = df.count() if min(self.min_df, self.max_df) < 1 else 0
        low, high = (b * rows if b < 1 else b for b in (self.min_df, self.max_df))
        if high < low:
            raise ValueError("max_df must be at least min_df")
        entry = lambda n, of: lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(of).alias("rows"))
        each = text.bind(self.terms, lambda ts: F.concat(F.transform(ts, entry(1, 0)), F.transform(F.array_distinct(ts), entry(0, 1))))
        counts = df.select(F.explode(each).alias("e")).groupBy("e.term").agg(F.sum("e.n").alias("n"), F.sum("e.rows").alias("rows"))
        found = counts.filter(F.col("rows").between(low, high)).orderBy(F.desc("n"), "term").select("term")
        words = [r.term for r in (found.limit(self.size) if self.size else found).collect()]  # the model's vocabulary
        if not words:  # a model without terms comes only from a fit
            return CountVectorizer(inputCol=self.terms, outputCol=self.out, binary=self.binary).fit(df.select(self.terms).limit(0))
        return CountVectorizerModel.from_vocabulary(words, self.terms, outputCol=self.out, binary=self.binary)


def assembler(numeric: Sequence[str] = NUMERIC, text_features: int = 8000, min_df: float = 2.0,
              max_df: float = 0.95, with_tags: bool = False) -> Pipeline:
    """Numbers, period dummies and tags (scaled) and TF-IDF of 1-2-grams.

    ``text_features`` bounds the text vocabulary by frequency, as a model size; tags keep all values.
    """
    stages, plain = [], list(numeric)
    if with_tags:
        stages.append(Vocabulary("popular_tags", "_tags", binary=True))
        plain.append("_tags")
    stages += [
        VectorAssembler(inputCols=plain, outputCol="_plain", handleInvalid="keep"),
        StandardScaler(inputCol="_plain", outputCol="_scaled", withMean=False),
        Vocabulary("grams", "_tf", text_features, min_df, max_df),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_text")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["_text", "_scaled"], outputCol="features")])


def with_grams(df: DataFrame, tokens: str = "tokens", low: int = 1, high: int = 2) -> DataFrame:
    return df.withColumn("grams", text.ngram_range(tokens, low, high))


def time_split(df: DataFrame, ts: str = "createTimeISO", fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Chronological split at an exact time quantile; no global sort."""
    stamped = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    cut = exact_quantiles(stamped, "_t", [fraction]).scalar()
    return stamped.filter(F.col("_t") <= cut).drop("_t"), stamped.filter(F.col("_t") > cut).drop("_t")


def time_folds(df: DataFrame, ts: str = "createTimeISO", folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding-window folds cut at time quantiles (a fixed, small number of folds)."""
    stamped = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    cut = with_quantiles(stamped, stamped, "_t", [i / (folds + 1) for i in range(1, folds + 2)])
    at = lambda i: F.col(f"_q.p{i}")
    return [(cut.filter(F.col("_t") <= at(i)).drop("_t", "_q"),
             cut.filter((F.col("_t") > at(i)) & (F.col("_t") <= at(i + 1))).drop("_t", "_q")) for i in range(folds)]


def regressor(**over) -> GBTRegressor:
    return GBTRegressor(**{"labelCol": "viral_target", "maxIter": 100, "stepSize": 0.05, "maxDepth": 6,
                           "subsamplingRate": 0.8, "seed": 42, **over})


def classifier(**over) -> GBTClassifier:
    return GBTClassifier(**{"labelCol": "is_viral", "weightCol": "weight", "maxIter": 100, "stepSize": 0.05,
                            "maxDepth": 6, "subsamplingRate": 0.8, "seed": 42, **over})


def viral_labels(df: DataFrame, target: str = "viral_target", prob: float = 0.75, positive_weight: float = 3.0) -> DataFrame:
    cut = exact_quantiles(df, target, [prob]).scalar()
    return df.withColumn("is_viral", (F.col(target) > cut).cast("double")).withColumn(
        "weight", F.when(F.col("is_viral") == 1, positive_weight).otherwise(1.0))


def linear_contributions(df: DataFrame, numeric: Sequence[str], target: str = "viral_target") -> tuple[DataFrame, object]:
    """Exact contributions w * (x - mean) of a linear model: columns c_<feature>, plus prediction.

    Their sum is prediction minus mean prediction.
    """
    clean = df.na.drop(subset=[*numeric, target])
    data = VectorAssembler(inputCols=list(numeric), outputCol="_x").transform(clean)
    model = LinearRegression(featuresCol="_x", labelCol=target, regParam=0.01, solver="normal").fit(data)
    means = data.agg(F.struct(*[F.avg(c).alias(c) for c in numeric]).alias("m")).scalar()
    out = model.transform(data).drop("_x").withColumns({
        f"c_{c}": F.lit(float(w)) * (F.col(c) - means.getField(c)) for c, w in zip(numeric, model.coefficients)})
    return out, model


def ablation_contributions(model: PipelineModel, df: DataFrame, cols: Sequence[str],
                           output: str | Column = "prediction") -> DataFrame:
    """Change of the model output when one feature is set to its mean; one transform per feature."""
    key = df.select("*", F.xxhash64(*[F.col(c) for c in cols]).alias("_k")).drop("_k")
    base = model.transform(key)
    keep = [*df.columns, "prediction"]
    out = base.select(*keep)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    for c in cols:
        swapped = out.withColumnRenamed("prediction", "_base").withColumn("_own", F.col(c)).withColumn(
            c, means.getField(c))
        scored = model.transform(swapped)
        kept = [x for x in swapped.columns if x != "_own" and x != c]
        out = scored.select(*kept, F.col("_own").alias(c), (F.col("_base") - F.col("prediction")).alias(f"c_{c}")
                            ).withColumnRenamed("_base", "prediction")
    return out


def contribution_rows(df: DataFrame, cols: Sequence[str], id_col: str = "post_id") -> DataFrame:
    """Long form (id, feature, value, contribution)."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              F.col(f"c_{c}").alias("contribution")) for c in cols])
    return df.select(id_col, F.inline(rows))


def importance(long: DataFrame, k: int = 20) -> DataFrame:
    return aggregates.mean_absolute(long, "feature", "contribution", k)


def response_curve(df: DataFrame, col: str, bins: int = 19) -> DataFrame:
    return aggregates.bin_means(df, col, f"c_{col}", bins).withColumn("feature", F.lit(col))


def best_range(df: DataFrame, col: str) -> DataFrame:
    return aggregates.best_bin(df, col, f"c_{col}").withColumn("feature", F.lit(col))


def effect_by_hour(scored: DataFrame, hour: str = "hour_posting", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(hour).agg(F.avg(prediction).alias("mean_prediction"), F.count("*").alias("n"))


def positive_probability(col: str = "probability") -> Column:
    return F.get(vector_to_array(col), 1)


def median_by(df: DataFrame, key: str, col: str) -> DataFrame:
    return exact_quantiles(df, col, [0.5], [key], ["median"])


def time_series_validation(df: DataFrame, numeric: Sequence[str], target: str, ts: str = "createTimeISO", folds: int = 5) -> DataFrame:
    """Expanding-window cross-validation of a linear model: ``fold, train_rows, test_rows, rmse, mae, r2``.

    Time is cut into ``folds + 1`` slices; fold i is fitted on slices up to i and measured on the next one.
    The normal equations of a slice are sums, those of an expanding window their prefix sums, so one pass
    fits all folds and a second one measures them. The row of fold 0 holds the means of the folds. Rows
    with a null feature, target or time take no part; an empty test slice or one without variance has no r2.
    """
    rows = df.na.drop(subset=[*numeric, target, ts]).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    names = [f"x{i}" for i in range(len(numeric))]
    rows = rows.select("_t", F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(numeric, names)])
    cut = with_quantiles(rows, rows, "_t", [i / (folds + 1) for i in range(1, folds + 1)])
    rows = cut_lineage(cut.withColumn("slice", sum((F.when(F.col("_t") > F.col(f"_q.p{i}"), 1).otherwise(0) for i in range(folds)), F.lit(0))).drop("_q", "_t"))
    spread = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_pop)]).first()
    scaled = [(F.col(n) - F.lit(spread[f"avg_{n}"])) / F.lit(spread[f"stddev_pop_{n}"] or 1.0) for n in names]
    terms = [F.lit(1.0), *scaled]
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(terms[i] * F.col("y")).alias(f"h{i}") for i in range(size)]
    gram, moment = np.zeros((folds + 1, size, size)), np.zeros((folds + 1, size))
    for row in rows.groupBy("slice").agg(*sums).collect():  # one row per slice
        for i, j in pairs:
            gram[row["slice"], i, j] = gram[row["slice"], j, i] = row[f"g{i}_{j}"]
        moment[row["slice"]] = [row[f"h{i}"] for i in range(size)]
    weights = [np.linalg.lstsq(g, h, rcond=None)[0] for g, h in zip(gram.cumsum(0)[:folds], moment.cumsum(0)[:folds])]
    predicted = lambda w: sum((t * F.lit(float(v)) for t, v in zip(terms, w)), F.lit(0.0))
    guess = reduce(lambda rest, f: F.when(F.col("slice") == f + 1, predicted(weights[f])).otherwise(rest), range(folds), F.lit(None).cast("double"))
    gap = F.col("y") - guess
    measured = rows.groupBy("slice").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
        (1 - F.try_divide(F.sum(gap * gap), F.var_pop("y") * F.count("*"))).alias("r2"))
    # one row per slice: a window over all of them is no larger than the number of folds
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = measured.withColumn("train_rows", before).filter("slice > 0").select(
        F.col("slice").cast("bigint").alias("fold"), "train_rows", F.col("n").alias("test_rows"), "rmse", "mae", "r2")
    mean = per.agg(F.lit(0).cast("bigint").alias("fold"), F.sum("train_rows").alias("train_rows"), F.sum("test_rows").alias("test_rows"),
                   F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))
    return per.unionByName(mean)


# --- contributions of tree models ------------------------------------------------------------

class Forest:
    """The trees of a fitted model as flat arrays: a node's split, children and mean prediction.

    As large as the model, which does not grow with the data.
    """

    def __init__(self, nodes: list, weights: Sequence[float]):
        """``nodes``: rows (tree, id, prediction, left, right, feature, threshold); children of leaves are -1."""
        self.used = sorted({n[5] for n in nodes if n[3] >= 0})
        place = {f: i for i, f in enumerate(self.used)}
        self.trees = []
        for tree, weight in enumerate(weights):
            own = sorted(n[1:] for n in nodes if n[0] == tree)
            mean = np.array([n[1] for n in own]) * weight
            left, right = np.array([n[2] for n in own]), np.array([n[3] for n in own])
            feature = np.array([place.get(n[4], 0) for n in own])
            self.trees.append((mean, left, right, feature, np.array([n[5] for n in own])))
        self.base = float(sum(t[0][0] for t in self.trees))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Per row and used feature: the changes of the node mean at the splits on that feature."""
        out = np.zeros((len(x), max(1, len(self.used))))
        every = np.arange(len(x))
        for mean, left, right, feature, threshold in self.trees:
            at = np.zeros(len(x), int)
            while True:
                open_ = every[left[at] >= 0]
                if not len(open_):
                    break
                node = at[open_]
                below = np.where(x[open_, feature[node]] <= threshold[node], left[node], right[node])
                out[open_, feature[node]] += mean[below] - mean[node]  # one split per row and step
                at[open_] = below
        return out


def flattened(spark: SparkSession, model) -> Forest:
    """A fitted boosted model or regression forest as ``Forest``, read from its own saved form."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    model.write().save(folder)
    stored = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    if not stored.filter("leftChild >= 0 AND split.numCategories <> -1").isEmpty():
        raise ValueError("contributions are defined for splits of numbers")
    nodes = [(r.treeID, r.id, r.prediction, r.leftChild, r.rightChild, r.split.featureIndex,
              r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0) for r in stored.collect()]  # as many as the model has
    weights = list(model.treeWeights)
    if "GBT" not in type(model).__name__:  # a forest averages
        weights = [w / len(weights) for w in weights]
    return Forest(nodes, weights)


def tree_contributions(model, df: DataFrame, names: Sequence[str], vector: str = "features", id_col: str = "post_id") -> tuple[DataFrame, float]:
    """``id, feature, value, contribution`` of every feature of every row, and the root mean.

    Each split on a row's path changes the mean of the node it is in; the change is credited to the split's
    feature. The sum over the features is the prediction (of a boosted classifier: the margin) minus the root
    mean. The trees are walked once per Arrow batch, whatever the number of features, and only features
    that some split uses leave the JVM; all others contribute 0 and are not listed.
    """
    forest = flattened(df.sparkSession, model)
    if not forest.used:
        return df.select(id_col, F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit(0.0).alias("contribution")).limit(0), forest.base
    used = [names[f] for f in forest.used]
    sliced = VectorSlicer(inputCol=vector, outputCol="_x", indices=forest.used).transform(df.select(id_col, vector))
    sliced = sliced.select(F.col(id_col).alias("id"), vector_to_array("_x").alias("x"))

    def work(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, len(used))
            ends = pa.array(np.arange(len(x) + 1) * len(used), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (x, forest.contributions(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "value", "contribution"])

    kind = dict(df.dtypes)[id_col]
    walked = sliced.mapInArrow(work, f"id {kind}, value array<double>, contribution array<double>")
    long = walked.select("id", F.posexplode(F.arrays_zip("value", "contribution")).alias("at", "pair"))
    feature = F.get(F.array(*[F.lit(n) for n in used]), F.col("at"))
    return long.select(F.col("id").alias(id_col), feature.alias("feature"), "pair.value", "pair.contribution"), forest.base
