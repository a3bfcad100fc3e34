"""Logical tables read from the given parquet tables, in Spark and in the oracle's SQL.

Each adapter maps a given table to one of the engine's logical tables (see FIXTURES.md); the same
mapping is written once as DataFrame code and once as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtrend.sources import spread_small_scan


_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small_scan(df, _TEXT_KEYS[name]) if name in _TEXT_KEYS else df


def tag_posts(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("createTimeISO"),
        F.concat(F.lit("tag"), k).alias("hashtag_name"), F.concat(F.lit("u"), "user_id").alias("author_nickName"),
        F.floor(F.col("value") * 100).alias("playCount"), F.floor(F.col("value") * 10).alias("diggCount"),
        F.floor("value").alias("shareCount"), F.expr("event_id % 7").alias("commentCount"),
        F.expr("event_id % 11").alias("collectCount"), (F.col("event_type") == "purchase").alias("isSponsored"),
        (F.col("event_type") == "signup").alias("isAd"), F.concat(F.lit("v/"), "event_id").alias("webVideoUrl"),
        F.col("event_type").alias("text"), F.col("event_type").alias("searchHashtag_name"))


def music(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("createTimeISO"), k.alias("musicID"),
        F.concat(F.lit("song"), k).alias("musicName"),
        F.concat(F.lit("a"), (k.cast("int") % 10)).alias("musicAuthor"),
        (F.col("event_type") == "error").alias("musicOriginal"), F.concat(F.lit("p/"), k).alias("playUrl"))


def song_history(spark, folder) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("createTimeISO"),
                    F.concat(F.lit("song"), F.expr("o_custkey % 50")).alias("musicName"),
                    F.concat(F.lit("a"), F.expr("o_custkey % 100")).alias("musicAuthor"))


def baskets(spark, folder) -> DataFrame:
    li, p = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("post_id"), F.col("p_brand").alias("hashtag_name"),
        F.floor("l_extendedprice").alias("playCount"), F.col("l_shipdate").alias("createTimeISO"))


def posts(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("post_id"), "text", F.col("lang").alias("textLanguage"),
        F.col("source").alias("author_nickName"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(doc_id % 90), int(doc_id % 24))").alias("createTimeISO"),
        F.expr("n_chars % 120").alias("video_duration"), F.expr("n_chars + 100 * (doc_id % 17)").alias("playCount"),
        F.expr("n_chars % 1009").alias("diggCount"), F.expr("n_chars % 211").alias("shareCount"),
        F.expr("doc_id % 23").alias("commentCount"), F.expr("doc_id % 11").alias("collectCount"),
        F.expr("(doc_id * 37) % 5000").alias("author_fans"), F.expr("doc_id % 5 = 0").alias("isAd"),
        F.expr("doc_id % 4 = 0").alias("isSponsored"))


def scored_posts(spark, folder) -> DataFrame:
    """Posts with the sentiment of the labels table and a made confidence."""
    lab = table(spark, folder, "labels")
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    lab = lab.select(F.col("doc_id").alias("post_id"), kind.alias("sentiment"),
                     (F.expr("(doc_id * 37) % 100") / 100.0).alias("confidence"))
    return posts(spark, folder).join(lab, "post_id")


def comments(spark, folder) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("post_id"), F.expr("conv_id * 100 + turn").alias("comment_id"),
        F.col("text").alias("comment"), F.col("role").alias("user"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(conv_id % 90), int(turn) + 30)").alias("comment_time"),
        F.expr("length(text) % 97").alias("likes"), F.expr("length(text) % 4").cast("string").alias("language"))


def transcripts(spark, folder) -> DataFrame:
    p = table(spark, folder, "pages")
    return p.select(F.col("page_id").alias("post_id"), F.col("html").alias("transcribed_text"),
                    F.col("url").alias("bucketUrl"))


COUNTRY_OF_REGION = {"AFRICA": "Kenya", "AMERICA": "USA", "ASIA": "Japan", "EUROPE": "Deutschland",
                     "MIDDLE EAST": "Saudi Arabia"}


def located_posts(spark, folder) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    country = F.create_map(*[F.lit(x) for kv in COUNTRY_OF_REGION.items() for x in kv])
    places = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .select("c_custkey", F.concat("c_name", F.lit(", "), country[F.col("r_name")]).alias("location_address")))
    return o.join(places, o.o_custkey == places.c_custkey).select(
        F.col("o_orderkey").alias("post_id"), "location_address", F.floor("o_totalprice").alias("playCount"),
        F.expr("o_orderdate + make_dt_interval(0, int(o_orderkey % 24))").alias("createTimeISO"))


def topic_posts(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("post_id"), F.col("ts").alias("createTimeISO"),
                    (F.get_json_object("props", "$.k").cast("int") % 12 - 1).alias("topic"), F.col("value"),
                    F.col("user_id"))


_SQL = {
    "tag_posts": """SELECT event_id AS post_id, ts AS "createTimeISO", 'tag' || json_extract_string(props, '$.k') AS hashtag_name,
        'u' || user_id AS "author_nickName", CAST(floor(value * 100) AS BIGINT) AS "playCount", CAST(floor(value * 10) AS BIGINT) AS "diggCount",
        CAST(floor(value) AS BIGINT) AS "shareCount", event_id % 7 AS "commentCount", event_id % 11 AS "collectCount",
        event_type = 'purchase' AS "isSponsored", event_type = 'signup' AS "isAd", 'v/' || event_id AS "webVideoUrl",
        event_type AS text, event_type AS "searchHashtag_name" FROM events""",
    "music": """SELECT event_id AS post_id, ts AS "createTimeISO", json_extract_string(props, '$.k') AS "musicID",
        'song' || json_extract_string(props, '$.k') AS "musicName",
        'a' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS "musicAuthor", event_type = 'error' AS "musicOriginal",
        'p/' || json_extract_string(props, '$.k') AS "playUrl" FROM events""",
    "song_history": """SELECT o_orderkey AS post_id, o_orderdate AS "createTimeISO", 'song' || (o_custkey % 50) AS "musicName",
        'a' || (o_custkey % 100) AS "musicAuthor" FROM orders""",
    "baskets": """SELECT l_orderkey AS post_id, p_brand AS hashtag_name, CAST(floor(l_extendedprice) AS BIGINT) AS "playCount",
        l_shipdate AS "createTimeISO" FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "posts": """SELECT doc_id AS post_id, text, lang AS "textLanguage", source AS "author_nickName",
        TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INT)) + to_hours(doc_id % 24) AS "createTimeISO",
        n_chars % 120 AS video_duration, n_chars + 100 * (doc_id % 17) AS "playCount", n_chars % 1009 AS "diggCount",
        n_chars % 211 AS "shareCount", doc_id % 23 AS "commentCount", doc_id % 11 AS "collectCount",
        (doc_id * 37) % 5000 AS author_fans, doc_id % 5 = 0 AS "isAd", doc_id % 4 = 0 AS "isSponsored" FROM documents""",
    "scored_posts": """SELECT p.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
        ((p.post_id * 37) % 100) / 100.0::DOUBLE AS confidence FROM posts p JOIN labels l ON p.post_id = l.doc_id""",
    "comments": """SELECT conv_id AS post_id, conv_id * 100 + turn AS comment_id, text AS comment, role AS "user",
        TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 90 AS INT)) + to_hours(turn + 30) AS comment_time,
        length(text) % 97 AS likes, CAST(length(text) % 4 AS VARCHAR) AS language FROM conversations""",
    "transcripts": """SELECT page_id AS post_id, html AS transcribed_text, url AS "bucketUrl" FROM pages""",
    "located_posts": """SELECT o_orderkey AS post_id, c_name || ', ' || CASE r_name """
        + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in COUNTRY_OF_REGION.items())
        + """ END AS location_address, CAST(floor(o_totalprice) AS BIGINT) AS "playCount",
        o_orderdate + to_hours(o_orderkey % 24) AS "createTimeISO"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "topic_posts": """SELECT event_id AS post_id, ts AS "createTimeISO", CAST(json_extract_string(props, '$.k') AS INT) % 12 - 1 AS topic,
        value, user_id FROM events""",
}
_NEEDS = {"scored_posts": ["posts"]}


def with_tables(body: str) -> str:
    """Prefix a query with the common table expressions of the adapters it names."""
    import re
    names: list[str] = []
    for name in _SQL:
        if re.search(rf"\b{name}\b", body):
            names += [n for n in [*_NEEDS.get(name, []), name] if n not in names]
    heads = [f"{n} AS ({_SQL[n]})" for n in names]
    body = body.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    recursive = "RECURSIVE " if match and match.group(1) else ""
    if match:
        heads.append(body[match.end():])
        return f"WITH {recursive}" + ",\n".join(heads)
    return (f"WITH {', '.join(heads)}\n" if heads else "") + body
