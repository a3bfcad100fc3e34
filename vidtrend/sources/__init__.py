"""Logical tables, readers, cache and sinks. Raw schemas are DDL text for ``spark.read.schema``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtrend.operators.joins import left_join_hot_right

_AUTHOR = "authorMeta STRUCT<nickName: STRING, signature: STRING, fans: BIGINT>"
_COMMON = (
    "id BIGINT, text STRING, textLanguage STRING, createTimeISO STRING, isAd BOOLEAN, "
    f"{_AUTHOR}, webVideoUrl STRING, diggCount BIGINT, shareCount BIGINT, playCount BIGINT, "
    "collectCount BIGINT, commentCount BIGINT, isSponsored BOOLEAN, "
    "locationMeta STRUCT<address: STRING>"
)
RAW_POSTS = (
    _COMMON + ", videoMeta STRUCT<duration: BIGINT>, searchHashtag STRUCT<name: STRING, views: BIGINT>, "
    "hashtags ARRAY<STRUCT<name: STRING, title: STRING>>, musicMeta STRUCT<musicID: STRING, "
    "musicName: STRING, musicAuthor: STRING, musicOriginal: BOOLEAN, playUrl: STRING>")
RAW_PROFILES = (
    _COMMON + ", videoMeta ARRAY<STRUCT<duration: BIGINT>>, musicMeta STRUCT<musicID: STRING, "
    "musicName: STRING, musicAuthor: STRING, musicOriginal: BOOLEAN, playUrl: STRING>")
RAW_COMMENTS = (
    "id BIGINT, cid BIGINT, createTimeISO STRING, text STRING, diggCount BIGINT, "
    "replyCommentTotal BIGINT, uniqueId STRING")
TRANSCRIPTS = (
    "id BIGINT, detected_language STRING, transcribed_text STRING, video_description STRING, "
    "bucketUrl STRING")

_POST_FIELDS = {
    "post_id": "id", "text": "text", "textLanguage": "textLanguage",
    "isAd": "isAd", "author_nickName": "authorMeta.nickName",
    "author_signature": "authorMeta.signature", "author_fans": "authorMeta.fans",
    "webVideoUrl": "webVideoUrl", "diggCount": "diggCount", "shareCount": "shareCount",
    "playCount": "playCount", "collectCount": "collectCount", "commentCount": "commentCount",
    "isSponsored": "isSponsored", "location_address": "locationMeta.address",
}
_SEARCH_FIELDS = {"searchHashtag_name": "searchHashtag.name", "searchHashtag_views": "searchHashtag.views"}
_MUSIC_FIELDS = ("musicID", "musicName", "musicAuthor", "musicOriginal", "playUrl")


def _columns(fields: Mapping[str, str]):
    return [F.col(path).alias(name) for name, path in fields.items()]


def _typed_time(raw: DataFrame, col: str = "createTimeISO") -> F.Column:
    """Typed once at ingest so that later time filters reach the file scan."""
    kind = dict(raw.dtypes)[col]
    return F.try_to_timestamp(F.col(col)) if kind == "string" else F.col(col)


def posts(raw: DataFrame) -> DataFrame:
    return raw.select(*_columns(_POST_FIELDS), *_columns(_SEARCH_FIELDS),
                      F.col("videoMeta.duration").alias("video_duration"),
                      _typed_time(raw).alias("createTimeISO"))


def hashtag_posts(raw: DataFrame) -> DataFrame:
    """One row per post and tag; a post without tags keeps one row with a null tag."""
    rows = raw.withColumn("_tag", F.explode_outer("hashtags"))
    return rows.select(*_columns(_POST_FIELDS), *_columns(_SEARCH_FIELDS),
                       F.col("videoMeta.duration").alias("video_duration"),
                       F.col("_tag.name").alias("hashtag_name"),
                       F.col("_tag.title").alias("hashtag_title"),
                       _typed_time(raw).alias("createTimeISO"))


def profiles(raw: DataFrame) -> DataFrame:
    """Profile posts; the duration is that of the first video record, null when there is none."""
    return raw.select(*_columns(_POST_FIELDS),
                      F.try_element_at("videoMeta", F.lit(1)).getField("duration").alias("video_duration"),
                      _typed_time(raw).alias("createTimeISO"))


def comments(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("post_id"), F.col("cid").alias("comment_id"),
        _typed_time(raw).alias("comment_createTimeISO_comment"), F.col("text").alias("comment"),
        F.col("diggCount").alias("diggCount_comment"),
        F.col("replyCommentTotal").alias("replyCommentTotal_comment"),
        F.col("uniqueId").alias("uniqueId_comment"))


def transcripts(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("post_id"), "detected_language", "transcribed_text",
                      "video_description", "bucketUrl")


def music(tag_posts: DataFrame, profile_posts: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Sounds used in the last ``days`` days of both post tables, whole rows made distinct."""
    def side(raw: DataFrame) -> DataFrame:
        rows = raw.select(F.col("id").alias("post_id"), _typed_time(raw).alias("createTimeISO"),
                          *[F.col(f"musicMeta.{f}").alias(f) for f in _MUSIC_FIELDS])
        anchor = as_of if isinstance(as_of, Column) else F.lit(as_of)
        cutoff = anchor.cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
        return rows.filter(F.col("createTimeISO") >= cutoff)
    return side(tag_posts).unionByName(side(profile_posts)).distinct()


def comment_grain(posts: DataFrame, comments: DataFrame, transcripts: DataFrame,
                  key: str = "post_id") -> DataFrame:
    """posts with their comments and transcripts: one row per comment (or per bare post)."""
    return posts_with_transcripts(left_join_hot_right(posts, comments, key), transcripts, key)


def posts_with_transcripts(posts: DataFrame, transcripts: DataFrame, key: str = "post_id") -> DataFrame:
    return posts.join(transcripts, key, "left")


def run_sql_file(spark: SparkSession, path: str, views: Mapping[str, DataFrame] | None = None,
                 **params) -> DataFrame:
    """Run the SQL text of a file (any Spark path) over named views and named parameters."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.sql(text.strip().rstrip(";"), args=params)


def run_named_sql(spark: SparkSession, name: str, views: Mapping[str, DataFrame] | None = None, **params) -> DataFrame:
    """Run a SQL file of the package by its name; the driver reads it and only its text is used."""
    for view, df in (views or {}).items():
        df.createOrReplaceTempView(view)
    text = resources.files("vidtrend.sources").joinpath("sql", f"{name}.sql").read_text()
    return spark.sql(text.strip().rstrip(";"), args=params)


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Repartition a text table whose files give fewer tasks than there are cores.

    A large table has far more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame],
           partition_by: Sequence[str] = ()) -> DataFrame:
    """Read a finished table at ``path``; otherwise build it, write it, and read it back.

    Only a folder with Spark's _SUCCESS marker counts, so a write that was cut short is redone.
    """
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        save(build(), path, partition_by=partition_by)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
         mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_by_feature(df: DataFrame, path: str, feature: str = "feature") -> None:
    """One result folder per analysed feature, in one write."""
    save(df, path, partition_by=[feature])


def load_bundle(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def dictionary(spark: SparkSession, path: str, canonical: str = "Ingredient", term: str = "searchTerm",
               sep: str = ";") -> DataFrame:
    """Dictionary file to distinct (canonical, term) pairs, trimmed and lower-cased."""
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    return dictionary_rows(raw, canonical, term)


def dictionary_rows(raw: DataFrame, canonical: str, term: str) -> DataFrame:
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return (raw.select(norm(canonical).alias("canonical"), norm(term).alias("term"))
            .filter((F.col("term") != "") & F.col("canonical").isNotNull()).distinct())


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct values. One scan of the table.

    Distinct counts group (column, value) pairs, so no task sees a whole column.
    """
    flat = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    long = flat.unpivot([], flat.columns, "column_name", "value")
    seen = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    kinds = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    return seen.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"), F.sum("n").alias("row_count"),
    ).withColumn("data_type", kinds[F.col("column_name")])
