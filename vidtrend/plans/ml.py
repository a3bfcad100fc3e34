"""Hashtag and engagement classifiers, ensembles, metrics and importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions.scalars import LIKES_SHARES_COMMENTS, calendar_fields, engagement, week_start
from vidtrend.operators import windows
from vidtrend.operators.scale import exact_quantiles, scalar
from vidtrend.session import cut_lineage

DAILY = ("post_count", "likes", "shares", "plays", "posts_7")
CONFIDENCE_BANDS = ("⚠️ Unlikely to Perform Well", "🤔 Uncertain Performance", "👍 Likely to Perform OK",
                    "🔥 Highly Likely to Perform Well")


def hash_split(df: DataFrame, key: str, label: str | None = None, fraction: float = 0.8, seed: int = 42
               ) -> tuple[DataFrame, DataFrame]:
    """Repeatable random split per class: independent of partitioning, no shuffle."""
    draw = _drawn(f"{seed}:", [key, *([label] if label else [])], 10_000) / F.lit(10_000.0)
    return df.filter(draw < fraction), df.filter(draw >= fraction)


def fold_column(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold number per row, for CrossValidator(foldCol=...)."""
    return df.withColumn("fold", _drawn(f"{seed}:fold:", [key], folds).cast("int"))


def _drawn(mark: str, cols: Sequence[str], n: int) -> Column:
    """A number below ``n`` that depends on the row's values only."""
    joined = F.concat(F.lit(mark), F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint") % n


def daily_tag_features(df: DataFrame, tag: str = "hashtag_name", post: str = "post_id", ts: str = "createTimeISO",
                       limit: float = 0.5, calendar: bool = False) -> DataFrame:
    """Daily tag series with 7-row sums, their change and the will-trend label."""
    per_post = df.na.drop(subset=[tag]).groupBy(tag, F.to_date(ts).alias("day"), post).agg(
        F.max("diggCount").alias("l"), F.max("shareCount").alias("s"), F.max("playCount").alias("p"))
    daily = per_post.groupBy(tag, "day").agg(
        F.count("*").alias("post_count"), F.sum("l").alias("likes"), F.sum("s").alias("shares"), F.sum("p").alias("plays"))
    rolled = windows.trailing_sum(daily, [tag], "day", "post_count", 7, "posts_7", calendar)
    rolled = windows.pct_change(rolled, [tag], "day", "posts_7", "change_7")
    return rolled.withColumn("label", (F.col("change_7") > limit).cast("double"))


def train_tag_trend(df: DataFrame, with_change: bool = False, iterations: int = 50) -> PipelineModel:
    cols = [*DAILY, "change_7"] if with_change else list(DAILY)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"),
                            GBTClassifier(labelCol="label", maxIter=iterations, maxDepth=5, seed=42)]).fit(df)


def rank_tags(scored: DataFrame, days: int | None = None, tag: str = "hashtag_name", minimum: int | None = 10,
              k: int = 20) -> DataFrame:
    """Best-scored tags of the newest day or the last days; volume floor or its 75 % quantile."""
    newest = scalar(scored, F.max("day"))
    recent = scored.filter(F.col("day") > F.date_sub(newest, days or 1))
    rated = recent.withColumn("trend_probability", F.get(vector_to_array("probability"), 1))
    per_tag = rated.groupBy(tag).agg(F.max("trend_probability").alias("score"), F.sum("post_count").alias("volume"))
    floor = exact_quantiles(per_tag, "volume", [0.75]).scalar() if minimum is None else F.lit(minimum)
    return per_tag.filter(F.col("volume") >= floor).orderBy(F.desc("score"), F.desc("volume"), tag).limit(k)


def weekly_tag_features(df: DataFrame, tag: str = "hashtag_name", ts: str = "createTimeISO",
                        metrics: Sequence[str] = LIKES_SHARES_COMMENTS, limit: float = 0.5) -> DataFrame:
    """Weekly count, engagement, growth, sponsored ratio and label; a tag's first week is dropped."""
    base = df.na.drop(subset=[tag]).withColumns({"week": week_start(ts), "e": engagement(metrics)})
    weekly = base.groupBy(tag, "week").agg(
        F.count("*").alias("post_count"), F.avg("e").alias("avg_engagement"),
        F.avg(F.coalesce(F.col("isSponsored").cast("double"), F.lit(0.0))).alias("sponsored_ratio"))
    prior = windows.previous(weekly, [tag], "week", "post_count", "previous_count")
    prior = prior.filter(F.col("previous_count").isNotNull())
    growth = (F.col("post_count") - F.col("previous_count")) / (F.col("previous_count") + F.lit(1e-6))
    return prior.withColumn("growth", growth).withColumn("label", (F.col("growth") > limit).cast("double"))


def train_weekly_forest(df: DataFrame, tag: str = "hashtag_name", trees: int = 100) -> PipelineModel:
    """Random forest on weekly features; the tag enters as its frequency-ordered index."""
    return Pipeline(stages=[
        StringIndexer(inputCol=tag, outputCol="tag_index", handleInvalid="keep"),
        VectorAssembler(inputCols=["tag_index", "post_count", "avg_engagement", "sponsored_ratio"], outputCol="features"),
        RandomForestClassifier(labelCol="label", numTrees=trees, seed=42, maxBins=512)]).fit(df)


def engagement_labels(df: DataFrame, metrics: Sequence[str] = LIKES_SHARES_COMMENTS, ts: str = "createTimeISO") -> DataFrame:
    """Above-median engagement label and calendar columns."""
    rated = df.withColumn("engagement", engagement(metrics))
    median = exact_quantiles(rated, "engagement", [0.5]).scalar()
    fields = calendar_fields(ts)
    return rated.withColumns({"label": (F.col("engagement") > median).cast("double"),
                              "hour": fields["hour"].cast("double"), "dayofweek": fields["day_of_week"].cast("double")})


def tag_popularity(df: DataFrame, post: str = "post_id", tags: str = "tags") -> DataFrame:
    """Mean total use of a post's tags."""
    rows = df.select(post, F.explode(tags).alias("tag"))
    use = rows.groupBy("tag").agg(F.count("*").alias("use"))
    mean = rows.join(use, "tag").groupBy(post).agg(F.avg("use").alias("avg_tag_popularity"))
    return df.join(mean, post, "left").na.fill(0.0, ["avg_tag_popularity"])


def engagement_pipeline(tags: str = "tags", words: str = "tokens", caption_words: int = 300,
                        numeric: Sequence[str] = ("playCount", "hour", "dayofweek", "avg_tag_popularity"),
                        tag_weight: float = 1.0, caption_weight: float = 1.0) -> Pipeline:
    return Pipeline(stages=[
        CountVectorizer(inputCol=tags, outputCol="_tags", vocabSize=2 ** 31 - 1, minDF=1.0),
        CountVectorizer(inputCol=words, outputCol="_words", vocabSize=caption_words),
        VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_tags", "_words", "_scaled"], outputCol="features"),
        LogisticRegression(labelCol="label", maxIter=100, regParam=0.01)])


def coefficient_table(model: PipelineModel, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(feature, kind, coefficient): one row per model coefficient (bounded by the vocabularies)."""
    tags, words, logistic = model.stages[0].vocabulary, model.stages[1].vocabulary, model.stages[-1]
    names = [(t, "hashtag") for t in tags] + [(w, "caption") for w in words] + [(n, "numeric") for n in numeric]
    rows = [(n, kind, float(c)) for (n, kind), c in zip(names, logistic.coefficients.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, coefficient double")


def importance_by_kind(coefficients: DataFrame) -> DataFrame:
    table = coefficients.groupBy("kind").agg(F.sum(F.abs("coefficient")).alias("importance"), F.count("*").alias("features"))
    return table.withColumn("share", F.col("importance") / scalar(table, F.sum("importance")))


def score_posts(model: PipelineModel, df: DataFrame, tag_weight: float = 1.0, caption_weight: float = 1.0) -> DataFrame:
    """Probability and confidence band of candidate posts, with block weights on tags and caption."""
    n_tags, n_words = len(model.stages[0].vocabulary), len(model.stages[1].vocabulary)
    logistic = model.stages[-1]
    rest = logistic.numFeatures - n_tags - n_words
    out = PipelineModel(stages=model.stages[:-1]).transform(df)
    if tag_weight != 1.0 or caption_weight != 1.0:
        scale = Vectors.dense([tag_weight] * n_tags + [caption_weight] * n_words + [1.0] * rest)
        out = ElementwiseProduct(scalingVec=scale, inputCol="features", outputCol="_weighted").transform(out)
        out = out.drop("features").withColumnRenamed("_weighted", "features")
    return with_band(logistic.transform(out).withColumn("score", F.get(vector_to_array("probability"), 1)))


def with_band(df: DataFrame, score: str = "score") -> DataFrame:
    c = F.col(score)
    return df.withColumn("band", F.when(c >= 0.8, CONFIDENCE_BANDS[3]).when(c >= 0.6, CONFIDENCE_BANDS[2])
                         .when(c >= 0.4, CONFIDENCE_BANDS[1]).otherwise(CONFIDENCE_BANDS[0]))


def tag_impact(coefficients: DataFrame, df: DataFrame, post: str = "post_id", tags: str = "tags") -> DataFrame:
    """Coefficient of each tag of each candidate post, zero for unknown tags."""
    known = coefficients.filter(F.col("kind") == "hashtag").select(F.col("feature").alias("tag"), "coefficient")
    return df.select(post, F.explode(tags).alias("tag")).join(known, "tag", "left").select(
        post, "tag", F.coalesce("coefficient", F.lit(0.0)).alias("estimated_impact"))


def soft_vote(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 50,
              rounds: int = 20) -> DataFrame:
    """Mean positive probability of forest, two boosted models, logistic and linear SVM."""
    prepare = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"),
                               StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(train)
    # five fits read the same rows: written once, not recomputed
    fitted, out = cut_lineage(prepare.transform(train)), prepare.transform(test)
    models = {
        "rf": RandomForestClassifier(labelCol=label, numTrees=trees, seed=42),
        "gbt": GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=5, stepSize=0.1, seed=42),
        "gbt_deep": GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=7, stepSize=0.1, seed=43),
        "lr": LogisticRegression(labelCol=label, maxIter=100), "svm": LinearSVC(labelCol=label, maxIter=50)}
    for name, algorithm in models.items():
        out = algorithm.fit(fitted).transform(out)
        if name == "svm":
            p = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))
            out = out.withColumn(f"p_{name}", p).drop("rawPrediction", "prediction")
        else:
            out = out.withColumn(f"p_{name}", F.get(vector_to_array("probability"), 1)).drop(
                "rawPrediction", "probability", "prediction")
    vote = sum(F.col(f"p_{n}") for n in models) / len(models)
    return out.withColumn("probability_mean", vote).withColumn("prediction", (vote >= 0.5).cast("double"))


# --- metrics --------------------------------------------------------------------------------

def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1, support per class and overall accuracy."""
    counts = confusion(df, label, prediction)
    roles = counts.select(F.explode(F.array(
        F.struct(F.col(label).alias("c"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(prediction).alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").cast("int").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("r")).select("r.*")
    per = roles.groupBy(F.col("c").alias("class")).agg(F.sum("support").alias("support"), F.sum("predicted").alias("_p"),
                                                       F.sum("hit").alias("_h"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide(F.col("_h"), F.col("_p"))), zero(F.try_divide(F.col("_h"), F.col("support")))
    per = per.withColumns({"precision": precision, "recall": recall})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    accuracy = scalar(counts, F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)) / F.sum("n"))
    return per.withColumns({"f1": f1, "accuracy": accuracy}).drop("_p", "_h")


def auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact area under the ROC curve from average ranks of the distinct scores."""
    from vidtrend.operators.scale import running_total
    counts = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum(label).alias("_pos"))
    ranked = running_total(counts, ["_s"], "_n", (), "_before", "_total")
    rank_sum = F.sum(F.col("_pos") * (F.col("_before") + (F.col("_n") + 1) / 2))
    return ranked.agg(rank_sum.alias("r"), F.sum("_pos").alias("p"), F.sum("_n").alias("n")).select(
        ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def regression_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, R2 and the RMSE of always predicting the mean."""
    gap = F.col(label) - F.col(prediction)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
                  F.stddev_pop(label).alias("baseline_rmse"),
                  (1 - F.sum(gap * gap) / (F.var_pop(label) * F.count("*"))).alias("r2"))


def importances(model, names: Sequence[str], spark, k: int | None = None, bottom: bool = False) -> DataFrame:
    """Feature importances of a tree model as a table (bounded by the number of features)."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    if k is None:
        return table
    return table.orderBy(F.col("importance") if bottom else F.desc("importance"), "feature").limit(k)


def decoded(df: DataFrame, labels: Sequence[str], prediction: str = "prediction") -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("predicted_label", F.get(names, F.col(prediction).cast("int")))


def predicted(df: DataFrame, value: float = 1.0, prediction: str = "prediction") -> DataFrame:
    return df.filter(F.col(prediction) == value)


def keyword_label(col: str | Column, words: Sequence[str]) -> Column:
    from vidtrend.functions.text import contains_any
    return contains_any(col, words).cast("double")


