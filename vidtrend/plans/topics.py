"""Topic clusters of short texts, their keywords, coherence, labels and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.operators import aggregates, dedupe, filters, windows
from vidtrend.operators.scale import calendar_broadcast, checked_broadcast, exact_quantiles, scalar, top_n
from vidtrend.operators.similarity import cosine_pairs
from vidtrend.functions.scalars import week_start
from vidtrend.session import cut_lineage, written

NOISE = -1


def prepare(df: DataFrame, col: str = "comment", id_col: str = "comment_id", language: str | None = "textLanguage",
            stop: Sequence[str] = (), low: int = 3, high: int = 29) -> DataFrame:
    """Informative, distinct, cleaned texts; cheap filters run before cleaning and clustering."""
    base = df.filter(F.col(language) == "en") if language else df
    base = filters.drop_off_topic(base.filter(F.col(col).isNotNull()), col)
    base = base.withColumn("cleaned_text", text.clean(col, stop))
    base = filters.token_count(base, "cleaned_text", low, high)
    base = filters.drop_non_informative(filters.drop_thrice_repeated(base, col), col)
    return dedupe.keep_first(base, ["cleaned_text"], [id_col])


def embed(df: DataFrame, tokens: str, out: str = "vector", size: int = 512) -> DataFrame:
    """Unit-length hashed TF-IDF vector per text (no vocabulary on the driver).

    The rows are written once with their hashed terms, so neither the weights nor a later fit cleans and hashes the texts again.
    """
    hashed = written(HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=size).transform(df))
    model = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol=out)]).fit(hashed)
    return model.transform(hashed).drop("_tf", "_idf")


def fit(df: DataFrame, vector: str = "vector", k: int = 20, min_size: int = 20, far: float = 0.95, seed: int = 7,
        hierarchical: bool = False) -> DataFrame:
    """Adds topic, distance and probability; small clusters and far points get topic -1.

    ``vector`` is an ML vector or an array column. Probability is 1 at the centre and 0 at the
    greatest distance of the topic.
    """
    if dict(df.dtypes)[vector].startswith("array"):
        df = df.withColumn("_vec", array_to_vector(F.col(vector).cast("array<double>")))
    else:
        df = df.withColumn("_vec", F.col(vector))
    kind = BisectingKMeans if hierarchical else KMeans
    model = kind(k=k, seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(df)
    centres = df.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_cluster int, _centre array<double>")
    placed = model.transform(df).join(F.broadcast(centres), "_cluster")  # k rows
    gap = F.aggregate(F.zip_with(vector_to_array("_vec"), "_centre", lambda x, y: (x - y) * (x - y)),
                      F.lit(0.0), lambda a, x: a + x)
    # read again for the cut, the sizes and by every later report: written once, not recomputed
    placed = cut_lineage(placed.withColumn("distance", F.sqrt(gap)).drop("_centre", "_vec"))
    cut = exact_quantiles(placed, "distance", [far], names=["cut"]).scalar()
    sizes = placed.groupBy("_cluster").agg(F.count("*").alias("_size"), F.max("distance").alias("_far"))
    out = placed.join(F.broadcast(sizes), "_cluster")  # at most k rows
    noise = (F.col("_size") < min_size) | (F.col("distance") > cut)
    return out.withColumns({
        "topic": F.when(noise, F.lit(NOISE)).otherwise(F.col("_cluster")),
        "probability": 1 - F.coalesce(F.try_divide("distance", "_far"), F.lit(0.0))}).drop("_cluster", "_size", "_far")


def keywords(df: DataFrame, tokens: str, topic: str = "topic", k: int = 5, common: Sequence[str] = ()) -> DataFrame:
    """(topic, word, score, rank): class-based TF-IDF."""
    words = df.filter(F.col(topic) != NOISE).select(topic, F.explode(tokens).alias("word"))
    tf = words.groupBy(topic, "word").agg(F.count("*").alias("n"))
    if common:
        tf = tf.filter(~F.col("word").isin(list(common)))
    size = words.groupBy(topic).agg(F.count("*").alias("_size"))
    mean_size = scalar(size, F.avg("_size"))
    overall = tf.groupBy("word").agg(F.sum("n").alias("_all"))
    scored = tf.join(size, topic).join(overall, "word").withColumn(
        "score", F.col("n") / F.col("_size") * F.log(1 + mean_size / F.col("_all")))
    return top_n(scored.select(topic, "word", "score"), [topic], [F.desc("score"), F.col("word")], k)


def coherence(df: DataFrame, id_col: str, tokens: str, words: DataFrame, topic: str = "topic") -> DataFrame:
    """Mean normalised pointwise mutual information of the topic's keyword pairs.

    A text is first reduced to its keywords; pairs are formed within the (about ten) keywords of
    one topic in one text.
    """
    total = scalar(df, F.count("*"))
    tokens_of = df.select(F.col(id_col).alias("_doc"), F.explode(F.array_distinct(tokens)).alias("word"))
    hits = tokens_of.join(checked_broadcast(words.select(topic, "word")), "word")
    single = tokens_of.join(checked_broadcast(words.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    grouped = hits.groupBy(topic, "_doc").agg(F.array_sort(F.collect_list("word")).alias("ws"))
    pairs = grouped.select(topic, F.explode(F.flatten(F.transform("ws", lambda w, i: F.transform(
        F.slice("ws", i + 2, F.size("ws")), lambda v: F.struct(w.alias("a"), v.alias("b")))))).alias("p"))
    both = pairs.groupBy(topic, "p.a", "p.b").agg(F.count("*").alias("n_ab"))
    p = both.join(single.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(
        single.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    p_ab = F.col("n_ab") / total
    npmi = F.when(p_ab >= 1, 1.0).otherwise(F.log(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))) / -F.log(p_ab))
    seen = p.groupBy(topic).agg(F.sum(npmi).alias("_s"), F.count("*").alias("_pairs"))
    sizes = words.groupBy(topic).agg(F.count("*").alias("_k"))
    possible = F.col("_k") * (F.col("_k") - 1) / 2
    # a pair that never occurs together has npmi -1
    return sizes.join(seen, topic, "left").select(topic, F.coalesce(F.try_divide(
        F.coalesce("_s", F.lit(0.0)) - (possible - F.coalesce("_pairs", F.lit(0))), possible), F.lit(0.0)).alias("coherence"))


def drop_incoherent(df: DataFrame, scores: DataFrame, minimum: float = 0.35, topic: str = "topic") -> DataFrame:
    kept = scores.filter(F.col("coherence") >= minimum).select(topic, F.lit(True).alias("_keep"))
    return df.join(kept, topic, "left").withColumn(
        topic, F.when(F.col("_keep"), F.col(topic)).otherwise(NOISE)).drop("_keep")


def representatives(df: DataFrame, id_col: str, topic: str = "topic", distance: str = "distance", k: int = 3) -> DataFrame:
    return top_n(df.filter(F.col(topic) != NOISE), [topic], [F.col(distance), F.col(id_col)], k)


def labels(words: DataFrame, topic: str = "topic", k: int = 3) -> DataFrame:
    """First keywords of a topic as its name, and the keyword list (k words per topic)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return words.groupBy(topic).agg(ordered.alias("_w")).select(
        topic, F.array_join(F.slice(F.col("_w.word"), 1, k), " ").alias("name"),
        F.array_join(F.col("_w.word"), " ").alias("keywords"))


def normalise_label(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def similar_pairs(df: DataFrame, id_col: str, vector: str, minimum: float = 0.9) -> DataFrame:
    """Pairs (a < b) of a topic table of any length with a cosine above ``minimum``."""
    return cosine_pairs(df, id_col, vector, minimum)


def merge_labels(names: DataFrame, pairs: DataFrame, topic: str = "topic", name: str = "name",
                 policy: str = "last") -> DataFrame:
    """A topic takes the name of its last (or lowest) similar earlier topic; not transitive."""
    pick = F.max("a") if policy == "last" else F.min("a")
    source = pairs.groupBy("b").agg(pick.alias("_from"))
    renamed = names.select(F.col(topic).alias("_from"), F.col(name).alias("_name"))
    return (names.join(source, names[topic] == source["b"], "left").join(renamed, "_from", "left")
            .withColumn(name, F.coalesce("_name", name)).drop("b", "_from", "_name"))


def summary(df: DataFrame, names: DataFrame, examples: DataFrame, id_col: str, col: str, topic: str = "topic",
            sentiment: str | None = "sentiment") -> DataFrame:
    """Count, name, keywords, example texts and sentiment shares per topic."""
    base = df.filter(F.col(topic) != NOISE)
    table = base.groupBy(topic).agg(F.count("*").alias("count"))
    few = examples.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(col).alias("t")))).alias("_e"))
    table = table.join(names, topic, "left").join(few.select(topic, F.col("_e.t").alias("examples")), topic, "left")
    if sentiment:
        table = table.join(sentiment_shares(base, topic, sentiment), topic, "left")
    return table


def sentiment_shares(df: DataFrame, topic: str = "topic", sentiment: str = "sentiment") -> DataFrame:
    kinds = ["negative", "neutral", "positive"]
    table = aggregates.crosstab(df.filter(F.col(topic) != NOISE), topic, sentiment, kinds)
    return aggregates.row_shares(table, kinds).select(topic, *[f"{k}_share" for k in kinds])


def metadata(df: DataFrame, words: DataFrame, id_col: str, col: str, ts: str | None = None, topic: str = "topic",
             k: int = 4) -> DataFrame:
    """Label, keywords, first examples and time range copied to every row of the topic."""
    table = labels(words, topic)
    first = top_n(df.filter(F.col(topic) != NOISE).select(topic, id_col, col), [topic], [F.col(id_col)], k)
    table = table.join(first.groupBy(topic).agg(
        F.array_sort(F.collect_list(F.struct("rank", col))).alias("_e")), topic, "left").withColumn(
        "examples", F.col(f"_e.{col}")).drop("_e")
    if ts:
        table = table.join(aggregates.time_range_text(df, [topic], ts), topic, "left")
    return df.join(table, topic, "left")


def two_level(df: DataFrame, id_col: str, vector: str, k: int = 5, sub_k: int = 4, min_size: int = 70,
              min_sub: int = 15, seed: int = 7) -> DataFrame:
    """Broad topics and sub-topics inside each, for every row; the refit loop runs over at most k topics."""
    broad = fit(df, vector, k, min_size, 1.0, seed).withColumnRenamed("topic", "super_topic").drop("distance", "probability")
    broad = cut_lineage(broad)
    sizes = {r["super_topic"]: r["n"] for r in broad.groupBy("super_topic").agg(F.count("*").alias("n")).collect()}  # k rows
    large = [i for i in range(k) if sizes.get(i, 0) >= min_sub]
    # rows outside a broad topic, or in one too small to split, have no sub-topic
    out = broad.filter(~F.col("super_topic").isin(large)).withColumn("sub_topic", F.lit(NOISE))
    for i in large:
        sub = fit(broad.filter(F.col("super_topic") == i), vector, sub_k, min_sub, 1.0, seed).withColumnRenamed("topic", "sub_topic")
        out = out.unionByName(sub.select(*broad.columns, "sub_topic"))
    return out


def weekly_rate(df: DataFrame, topic: str, ts: str, comment: str, post: str, min_posts: int = 5,
                smooth: int = 3) -> DataFrame:
    """Comments per commented post of a topic and week, weeks with enough posts, smoothed."""
    dated = df.filter(F.col(topic) != NOISE).withColumn("week", week_start(ts))
    per_post = dated.groupBy(topic, "week", post).agg(F.count(comment).alias("c"))
    table = per_post.groupBy(topic, "week").agg(F.sum("c").alias("comments"))
    posts = df.select(week_start(ts).alias("week"), post).distinct().groupBy("week").agg(F.count("*").alias("posts"))
    table = table.join(calendar_broadcast(posts.filter(F.col("posts") >= min_posts)), "week")
    table = table.withColumn("rate", F.col("comments") / F.col("posts"))
    return windows.trailing_mean(table, [topic], "week", "rate", smooth, "rate_smoothed")


def word_vectors(df: DataFrame, tokens: str, size: int = 100, window: int = 5, min_count: int = 2,
                 iterations: int = 10, seed: int = 7, out: str = "vector", partitions: int | None = None):
    """Fitted Word2Vec; its transform gives the mean word vector of a text.

    The texts are dealt over ``partitions`` tasks, by default one per core (one alone would train on the
    whole table); after each iteration a word's vector is the mean over the tasks that met it.
    """
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed,
                    numPartitions=partitions or df.sparkSession.sparkContext.defaultParallelism,
                    inputCol=tokens, outputCol=out).fit(df)


def by_sentiment(df: DataFrame, tokens: str, sentiment: str = "sentiment", kinds: Sequence[str] = ("positive", "negative"),
                 k: int = 5, min_size: int = 5) -> DataFrame:
    """Separate topic fits on the comments of each sentiment, with probabilities."""
    df = written(df.filter(F.col(sentiment).isin(list(kinds))))  # read for each kind, so the texts are cleaned once
    out = None
    for kind in kinds:
        part = df.filter((F.col(sentiment) == kind) & (F.size(tokens) > 3))
        fitted = fit(embed(part, tokens), k=k, min_size=min_size).withColumn("fit_on", F.lit(kind))
        out = fitted if out is None else out.unionByName(fitted)
    return out

