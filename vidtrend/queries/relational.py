"""Sources, filters, duplicates, joins, aggregates, windows and scalar functions."""


from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidtrend import sources
from vidtrend.functions import fixed, scalars, text
from vidtrend.operators import aggregates, dedupe, filters, joins, windows
from vidtrend.operators.scale import best, exact_quantiles, group_total, preceding_rows, scalar, top_n
from vidtrend.plans import hashtags
from vidtrend.queries import adapters as t
from vidtrend.queries import sqltext as q
from vidtrend.queries.registry import query

# --- sources and sinks ----------------------------------------------------------------------


def _raw_posts(spark, d):
    """The given tables shaped as nested raw records, to read back through the scan operators."""
    p = t.posts(spark, d)
    return p.select(
        F.col("post_id").alias("id"), "text", "textLanguage",
        F.date_format("createTimeISO", "yyyy-MM-dd'T'HH:mm:ss").alias("createTimeISO"), "isAd",
        F.struct(F.col("author_nickName").alias("nickName"), F.lit("").alias("signature"), F.col("author_fans").alias("fans")).alias("authorMeta"),
        F.concat(F.lit("v/"), "post_id").alias("webVideoUrl"), "diggCount", "shareCount", "playCount", "collectCount", "commentCount",
        "isSponsored", F.struct(F.lit("x, Germany").alias("address")).alias("locationMeta"),
        F.struct(F.col("video_duration").alias("duration")).alias("videoMeta"),
        F.struct(F.col("textLanguage").alias("name"), F.col("playCount").alias("views")).alias("searchHashtag"),
        F.transform(text.hashtags("text"), lambda h: F.struct(h.alias("name"), h.alias("title"))).alias("hashtags"))


@query("s1_posts_scan", """SELECT post_id, "textLanguage", "isAd", "author_nickName", author_fans, video_duration, "playCount", "textLanguage" AS "searchHashtag_name",
 TS("createTimeISO") AS "createTimeISO" FROM posts""")
def _(spark, d):
    return sources.posts(_raw_posts(spark, d)).select(
        "post_id", "textLanguage", "isAd", "author_nickName", "author_fans", "video_duration", "playCount", "searchHashtag_name", "createTimeISO")


@query("s2_hashtag_scan", r"""WITH x AS (SELECT post_id, regexp_extract_all(lower(text), '#([\p{L}\p{N}_]+)', 1) AS tags FROM posts)
SELECT post_id, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS hashtag_name FROM x""")
def _(spark, d):
    return sources.hashtag_posts(_raw_posts(spark, d)).select("post_id", "hashtag_name")


@query("s3_comments_scan", """SELECT conv_id AS post_id, conv_id * 100 + turn AS comment_id, length(text) AS comment_length, role AS "uniqueId_comment" FROM conversations""")
def _(spark, d):
    c = t.table(spark, d, "conversations")
    raw = c.select(F.col("conv_id").alias("id"), F.expr("conv_id * 100 + turn").alias("cid"), F.lit(None).cast("string").alias("createTimeISO"),
                   "text", F.lit(0).alias("diggCount"), F.lit(0).alias("replyCommentTotal"), F.col("role").alias("uniqueId"))
    return sources.comments(raw).select("post_id", "comment_id", F.length("comment").alias("comment_length"), "uniqueId_comment")


@query("s4_transcripts_scan", """SELECT page_id AS post_id, length(html) AS chars, url AS "bucketUrl" FROM pages""")
def _(spark, d):
    p = t.table(spark, d, "pages")
    raw = p.select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("detected_language"), F.col("html").alias("transcribed_text"),
                   F.lit(None).cast("string").alias("video_description"), F.col("url").alias("bucketUrl"))
    return sources.transcripts(raw).select("post_id", F.length("transcribed_text").alias("chars"), "bucketUrl")


@query("s5_profiles_scan", """SELECT post_id, CASE WHEN post_id % 3 > 0 THEN video_duration END AS video_duration FROM posts""")
def _(spark, d):
    raw = _raw_posts(spark, d).withColumn("videoMeta", F.when(F.col("id") % 3 > 0, F.array("videoMeta")).otherwise(
        F.array().cast("array<struct<duration:bigint>>")))
    return sources.profiles(raw).select("post_id", "video_duration")


@query("s6_music_scan", """WITH mx AS (SELECT max(ts) AS m FROM events),
 a AS (SELECT event_id AS post_id, json_extract_string(props, '$.k') AS "musicID", ts FROM events)
SELECT DISTINCT post_id, "musicID", TS(ts) AS "createTimeISO" FROM (SELECT * FROM a UNION ALL SELECT * FROM a), mx WHERE ts >= CAST(CAST(m AS DATE) AS TIMESTAMP) - INTERVAL 10 DAY""")
def _(spark, d):
    m = t.music(spark, d)
    raw = m.select(F.col("post_id").alias("id"), F.col("createTimeISO").cast("timestamp").alias("createTimeISO"),
                   F.struct("musicID", "musicName", "musicAuthor", "musicOriginal", "playUrl").alias("musicMeta"))
    as_of = scalar(m, F.to_date(F.max("createTimeISO")))
    return sources.music(raw, raw, as_of, days=10).select("post_id", "musicID", "createTimeISO")


@query("s7_named_sql_file", """SELECT "textLanguage", count(*) AS posts FROM posts WHERE "playCount" > 500 GROUP BY 1""")
def _(spark, d):
    return sources.run_named_sql(spark, "language_counts", {"s7_posts": t.posts(spark, d)}, plays=500)


def _scratch(spark) -> str:
    """A fresh folder beside the session's checkpoints (shared on a cluster)."""
    from vidtrend.session import ensure_checkpoint_dir
    import uuid
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("s8_read_through_cache", """SELECT post_id, "playCount", CAST(CAST("createTimeISO" AS DATE) AS VARCHAR) AS post_date FROM posts""")
def _(spark, d):
    build = lambda: t.posts(spark, d).select("post_id", "playCount", F.to_date("createTimeISO").alias("post_date"))
    path = _scratch(spark)
    sources.cached(spark, path, build)
    return sources.cached(spark, path, build)


@query("s9_csv_and_parquet_sinks", """SELECT post_id, "playCount" FROM posts""")
def _(spark, d):
    base = t.posts(spark, d).select("post_id", "playCount")
    path = _scratch(spark)
    sources.save(base, path, fmt="csv")
    return spark.read.option("header", "true").schema("post_id bigint, playCount bigint").csv(path)


@query("s10_bundle", """SELECT 'posts' AS name, count(*) AS n FROM posts UNION ALL SELECT 'events', count(*) FROM events""")
def _(spark, d):
    bundle = sources.load_bundle(spark, {"posts": f"{d}/documents.parquet", "events": f"{d}/events.parquet"})
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in bundle.items()]
    return parts[0].unionByName(parts[1])


@query("s11_dictionary_rows", """SELECT DISTINCT lower(trim(p_type)) AS canonical, lower(trim(p_name)) AS term FROM part WHERE trim(p_name) <> ''""")
def _(spark, d):
    p = t.table(spark, d, "part").select(F.concat(F.lit(" "), "p_type").alias("Ingredient"), F.upper("p_name").alias("searchTerm"))
    return sources.dictionary_rows(p, "Ingredient", "searchTerm")


@query("s12_table_per_feature", """SELECT 'playCount' AS feature, R6(avg("playCount")) AS mean FROM posts UNION ALL SELECT 'diggCount', R6(avg("diggCount")) FROM posts""")
def _(spark, d):
    long = t.posts(spark, d).select("playCount", "diggCount").unpivot([], ["playCount", "diggCount"], "feature", "value")
    path = _scratch(spark)
    sources.save_by_feature(long.groupBy("feature").agg(F.avg("value").alias("mean")), path)
    return spark.read.schema("mean double, feature string").parquet(path)


@query("s13_table_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(spark, d):
    return sources.profile_table(t.table(spark, d, "orders")).drop("data_type")


# --- filters --------------------------------------------------------------------------------

@query("f1_since_date", """SELECT post_id, DAYTEXT("createTimeISO") AS date FROM posts WHERE "createTimeISO" >= TIMESTAMP '2024-02-17'""")
def _(spark, d):
    return filters.since(t.posts(spark, d), start="2024-02-17").select("post_id", "date")


@query("f2_recent_days", """SELECT post_id, DAYTEXT("createTimeISO") AS date FROM tag_posts WHERE "createTimeISO" >= (SELECT max("createTimeISO") FROM tag_posts) - INTERVAL 7 DAY""")
def _(spark, d):
    return filters.recent_days(t.tag_posts(spark, d), days=7).select("post_id", "date")


@query("f3_recent_as_of", """SELECT post_id FROM posts WHERE "createTimeISO" >= TIMESTAMP '2024-03-31' - INTERVAL 1 MONTH""")
def _(spark, d):
    return filters.recent_months(t.posts(spark, d), "createTimeISO", 1, "2024-03-31").select("post_id")


@query("f4_languages", """SELECT post_id, "textLanguage" FROM posts WHERE "textLanguage" IN ('en', 'de')""")
def _(spark, d):
    return filters.languages(t.posts(spark, d)).select("post_id", "textLanguage")


@query("f5_equality", """SELECT post_id FROM posts WHERE "textLanguage" = 'en' AND "isAd" """)
def _(spark, d):
    return filters.equals(t.posts(spark, d), textLanguage="en", isAd=True).select("post_id")


@query("f6_played_text", """SELECT post_id FROM posts WHERE text IS NOT NULL AND "playCount" > 500""")
def _(spark, d):
    return filters.played_text(t.posts(spark, d), more_than=500).select("post_id")


@query("f7_complete_rows", """SELECT p.post_id, quality FROM posts p LEFT JOIN labels l ON p.post_id = l.doc_id WHERE quality IS NOT NULL""")
def _(spark, d):
    both = t.posts(spark, d).join(t.table(spark, d, "labels").withColumnRenamed("doc_id", "post_id"), "post_id", "left")
    return filters.complete(both, "quality").select("post_id", "quality")


@query("f8_date_range", """SELECT post_id FROM posts WHERE CAST("createTimeISO" AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-02-15'""")
def _(spark, d):
    return filters.date_range(t.posts(spark, d), "createTimeISO", "2024-01-15", "2024-02-15").select("post_id")


@query("f9_group_size", "SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1 HAVING count(*) >= 100")
def _(spark, d):
    return filters.group_size(t.tag_posts(spark, d), ["hashtag_name"], 100)


@query("f10_quantile_trim", """SELECT post_id, "playCount" FROM posts WHERE "playCount" BETWEEN (SELECT quantile_cont("playCount", 0.05) FROM posts) AND (SELECT quantile_cont("playCount", 0.95) FROM posts)""")
def _(spark, d):
    return filters.trim_quantiles(t.posts(spark, d), ["playCount"]).select("post_id", "playCount")


@query("f10_below_p99_positive", """SELECT post_id FROM tag_posts WHERE "playCount" < (SELECT quantile_cont("playCount", 0.99) FROM tag_posts) AND "playCount" > 0""")
def _(spark, d):
    return filters.below_quantile(t.tag_posts(spark, d), "playCount", positive=True).select("post_id")


@query("f10_iqr_fence", """WITH q AS (SELECT quantile_cont("playCount", 0.25) AS a, quantile_cont("playCount", 0.75) AS b FROM tag_posts)
SELECT post_id FROM tag_posts, q WHERE "playCount" BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def _(spark, d):
    return filters.iqr_fence(t.tag_posts(spark, d), "playCount").select("post_id")


@query("f11_trim_all_numeric", """WITH x AS (SELECT p.*, quality FROM posts p LEFT JOIN labels l ON p.post_id = l.doc_id)
SELECT post_id FROM x WHERE quality BETWEEN (SELECT min(quality) FROM x) AND (SELECT max(quality) FROM x) AND "playCount" BETWEEN (SELECT min("playCount") FROM x) AND (SELECT max("playCount") FROM x)""")
def _(spark, d):
    both = t.posts(spark, d).join(t.table(spark, d, "labels").withColumnRenamed("doc_id", "post_id"), "post_id", "left")
    return filters.trim_quantiles(both, ["quality", "playCount"], 0.0, 1.0).select("post_id")


@query("f12_flag_mismatch", """SELECT post_id FROM posts WHERE "isAd" <> "isSponsored" """)
def _(spark, d):
    return filters.columns_differ(t.posts(spark, d), "isAd", "isSponsored").select("post_id")


@query("f13_mask_low_volume", """SELECT DAYTEXT("createTimeISO") AS day, count(*) AS posts, CASE WHEN count(*) >= 330 THEN R6(avg("playCount")) END AS plays FROM tag_posts GROUP BY 1""")
def _(spark, d):
    daily = t.tag_posts(spark, d).groupBy(F.to_date("createTimeISO").alias("day")).agg(F.count("*").alias("posts"), F.avg("playCount").alias("plays"))
    return filters.mask_low_volume(daily, "plays", "posts", 330)


@query("f14_spam", r"""SELECT comment_id FROM comments WHERE NOT (contains(lower(trim(comment)), 'xyzzy') OR contains(lower(trim(comment)), 'la de'))
 AND len(regexp_extract_all(lower(trim(comment)), '\bthe\b')) <= 1""")
def _(spark, d):
    return filters.drop_spam(t.comments(spark, d), "comment", ["xyzzy", "la de"], "the", 1).select("comment_id")


@query("f15_repetitive", r"""WITH w AS (SELECT post_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM posts),
 c AS (SELECT post_id, max(n) AS m FROM (SELECT post_id, w, count(*) AS n FROM (SELECT post_id, unnest(ws) AS w FROM w) GROUP BY 1, 2) GROUP BY 1)
SELECT post_id FROM w LEFT JOIN c USING (post_id) WHERE len(ws) < 100 AND coalesce(m, 0) < 5""")
def _(spark, d):
    return filters.drop_repetitive(t.posts(spark, d), "text").select("post_id")


@query("f16_token_count", r"""SELECT post_id FROM posts WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) BETWEEN 3 AND 29""")
def _(spark, d):
    return filters.token_count(t.posts(spark, d), "text", 3, 29).select("post_id")


@query("f17_thrice_repeated", rf"""WITH w AS (SELECT post_id, regexp_extract_all(lower(text), '{q.WORD}+|[^\p{{L}}\p{{N}}_\s]') AS w FROM posts)
SELECT post_id FROM w WHERE len([i FOR i IN range(1, len(w) - 1) IF w[i] = w[i + 1] AND w[i] = w[i + 2] AND regexp_matches(w[i], '^{q.WORD}')]) = 0""")
def _(spark, d):
    return filters.drop_thrice_repeated(t.posts(spark, d), "text").select("post_id")


@query("f18_non_informative", r"""SELECT post_id FROM posts WHERE NOT regexp_matches(text, '(?i)\bthe (and|of|to)\b|\bof the\b|\bla de\b')""")
def _(spark, d):
    return filters.drop_non_informative(t.posts(spark, d), "text", [r"\bthe (and|of|to)\b", r"\bof the\b", r"\bla de\b"]).select("post_id")


@query("f19_off_topic", """SELECT post_id FROM posts WHERE NOT (contains(lower(text), 'rewh') OR contains(lower(text), 'thanedble'))""")
def _(spark, d):
    return filters.drop_off_topic(t.posts(spark, d), "text", ["rewh", "thanedble"]).select("post_id")


@query("f20_mask_low_confidence", "SELECT post_id, CASE WHEN confidence >= 0.65 THEN sentiment END AS sentiment FROM scored_posts")
def _(spark, d):
    return t.scored_posts(spark, d).select("post_id", scalars.mask_below("sentiment", "confidence", fixed.MIN_CONFIDENCE).alias("sentiment"))


@query("f21_confident_topics", "SELECT post_id, topic FROM topic_posts WHERE topic <> -1 AND value / 100.0 > 0.7")
def _(spark, d):
    return filters.confident_topics(t.topic_posts(spark, d).withColumn("probability", F.col("value") / 100.0)).select("post_id", "topic")


@query("f22_exclude_tags", "SELECT post_id FROM tag_posts WHERE lower(hashtag_name) NOT IN ('tag1', 'tag2')")
def _(spark, d):
    return filters.exclude(t.tag_posts(spark, d), "hashtag_name", ["Tag1", "TAG2"]).select("post_id")


@query("f23_varied_phrases", """SELECT p_name, count(*) AS n FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2) AND NOT contains(lower(p_name), 'bolt') GROUP BY 1""")
def _(spark, d):
    return filters.varied_phrases(t.table(spark, d, "part"), "p_name", ["bolt"]).groupBy("p_name").agg(F.count("*").alias("n"))


@query("f24_drop_and_rename", """SELECT post_id AS id, hashtag_name AS tag FROM tag_posts""")
def _(spark, d):
    return t.tag_posts(spark, d).select("post_id", "hashtag_name", "text").drop("text").withColumnsRenamed({"post_id": "id", "hashtag_name": "tag"})


@query("f25_drop_blank", "SELECT post_id FROM tag_posts WHERE trim(hashtag_name) <> ''")
def _(spark, d):
    return filters.drop_blank(t.tag_posts(spark, d), "hashtag_name").select("post_id")


@query("f26_zero_shares", " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, count(*) FILTER ("{m}" = 0) AS zero_rows, count(*) AS row_count, R6(count(*) FILTER ("{m}" = 0) / count(*)) AS zero_share FROM tag_posts"""
    for m in scalars.METRICS))
def _(spark, d):
    return filters.zero_shares(t.tag_posts(spark, d), scalars.METRICS)


# --- duplicates -----------------------------------------------------------------------------

@query("d1_distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def _(spark, d):
    return t.table(spark, d, "events").select("event_type", "user_id").distinct()


@query("d2_distinct_pairs", "SELECT DISTINCT post_id, hashtag_name FROM baskets")
def _(spark, d):
    return dedupe.distinct_pairs(t.baskets(spark, d), "post_id", "hashtag_name")


@query("d3_keep_first", """SELECT "author_nickName", arg_max(post_id, row("playCount", -post_id)) AS post_id, max("playCount") AS "playCount" FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return dedupe.keep_first(t.tag_posts(spark, d), ["author_nickName"], [F.desc("playCount"), F.col("post_id")]).select(
        "author_nickName", "post_id", "playCount")


@query("d4_distinct_songs", """SELECT DISTINCT "musicName", "musicAuthor" FROM song_history""")
def _(spark, d):
    return dedupe.distinct_pairs(t.song_history(spark, d), "musicName", "musicAuthor")


@query("d5_duplicate_rate", "SELECT R6(1 - count(DISTINCT text) / count(text)) AS duplicate_rate FROM posts")
def _(spark, d):
    return dedupe.duplicate_rate(t.posts(spark, d), "text")


# --- joins ----------------------------------------------------------------------------------

@query("j1_comment_grain", """SELECT p.post_id, comment_id, length(comment) AS comment_length, "bucketUrl" FROM posts p LEFT JOIN comments c ON p.post_id = c.post_id
 LEFT JOIN transcripts s ON p.post_id = s.post_id""")
def _(spark, d):
    c = t.comments(spark, d).select("post_id", "comment_id", F.length("comment").alias("comment_length"))
    return sources.comment_grain(t.posts(spark, d).select("post_id"), c, t.transcripts(spark, d).select("post_id", "bucketUrl"))


@query("j2_posts_with_transcripts", """SELECT p.post_id, "textLanguage", "bucketUrl" FROM posts p LEFT JOIN transcripts s ON p.post_id = s.post_id""")
def _(spark, d):
    return sources.posts_with_transcripts(t.posts(spark, d).select("post_id", "textLanguage"), t.transcripts(spark, d).select("post_id", "bucketUrl"))


@query("j3_share_tables_outer", """WITH a AS (SELECT hashtag_name, count(*) / (SELECT count(*) FROM tag_posts WHERE "isAd") AS x FROM tag_posts WHERE "isAd" GROUP BY 1),
 b AS (SELECT hashtag_name, count(*) / (SELECT count(*) FROM tag_posts WHERE "isSponsored") AS y FROM tag_posts WHERE "isSponsored" GROUP BY 1)
SELECT coalesce(a.hashtag_name, b.hashtag_name) AS hashtag_name, R6(coalesce(x, 0)) AS ad_share, R6(coalesce(y, 0)) AS sponsored_share FROM a FULL JOIN b ON a.hashtag_name = b.hashtag_name""")
def _(spark, d):
    p = t.tag_posts(spark, d)
    side = lambda cond, n: aggregates.mention_shares(p.filter(cond), "hashtag_name", n).drop("n")
    return joins.share_tables_outer([side("isAd", "ad_share"), side("isSponsored", "sponsored_share")], "hashtag_name")


@query("j4_group_totals", """SELECT post_id, count(*) OVER (PARTITION BY date_trunc('week', "createTimeISO")) AS week_posts FROM tag_posts""")
def _(spark, d):
    p = t.tag_posts(spark, d).select("post_id", scalars.week_start("createTimeISO").alias("week"))
    return group_total(p, ["week"], F.count("*"), "week_posts", calendar=True).select("post_id", "week_posts")


@query("j5_attach_labels", """SELECT p.post_id, coalesce(quality, -1) AS quality FROM posts p LEFT JOIN labels l ON p.post_id = l.doc_id""")
def _(spark, d):
    lab = t.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), "quality")
    return t.posts(spark, d).join(lab, "post_id", "left").select("post_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j6_song_authors", """WITH s AS (SELECT "musicName", count(*) AS n FROM song_history GROUP BY 1), a AS (SELECT DISTINCT "musicName", "musicAuthor" FROM song_history)
SELECT s."musicName", n, "musicAuthor" AS music_author FROM s LEFT JOIN a ON s."musicName" = a."musicName" """)
def _(spark, d):
    from vidtrend.plans import music
    h = t.song_history(spark, d)
    return music.with_authors(aggregates.counts(h, "musicName"), h)


@query("j7_rows_of_top_keys", "SELECT post_id, hashtag_name FROM tag_posts WHERE hashtag_name IN (SELECT hashtag_name FROM tag_posts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def _(spark, d):
    p = t.tag_posts(spark, d)
    return joins.in_keys(p, aggregates.top_values(p, "hashtag_name", 5), "hashtag_name").select("post_id", "hashtag_name")


@query("j8_rows_of_other_keys", "SELECT post_id FROM tag_posts WHERE hashtag_name NOT IN (SELECT hashtag_name FROM tag_posts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def _(spark, d):
    p = t.tag_posts(spark, d)
    return joins.not_in_keys(p, aggregates.top_values(p, "hashtag_name", 5), "hashtag_name").select("post_id")


@query("j10_period_means_outer", """WITH a AS (SELECT hashtag_name, avg("playCount") AS x FROM tag_posts WHERE "createTimeISO" >= TIMESTAMP '2024-01-23' GROUP BY 1),
 b AS (SELECT hashtag_name, avg("playCount") AS y FROM tag_posts GROUP BY 1)
SELECT b.hashtag_name, R6(coalesce(x, 0)) AS mean_recent, R6(y) AS mean_all FROM b LEFT JOIN a ON a.hashtag_name = b.hashtag_name""")
def _(spark, d):
    p = t.tag_posts(spark, d)
    mean = lambda df, n: df.groupBy("hashtag_name").agg(F.avg("playCount").alias(n))
    recent = filters.since(p, start="2024-01-23")
    return joins.share_tables_outer([mean(recent, "mean_recent"), mean(p, "mean_all")], "hashtag_name")


@query("j12_side_by_side_tops", """WITH a AS (SELECT hashtag_name AS tag, count(*) AS n FROM tag_posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
 b AS (SELECT "author_nickName" AS author, count(*) AS m FROM tag_posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT rank, tag, n, author, m FROM (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM a) JOIN (SELECT *, row_number() OVER (ORDER BY m DESC, author) AS rank FROM b) USING (rank)""")
def _(spark, d):
    p = t.tag_posts(spark, d)
    a = p.groupBy(F.col("hashtag_name").alias("tag")).agg(F.count("*").alias("n"))
    b = p.groupBy(F.col("author_nickName").alias("author")).agg(F.count("*").alias("m"))
    return joins.side_by_side(a, b, [F.desc("n"), F.col("tag")], [F.desc("m"), F.col("author")], 10)


@query("j12_align_by_position", """SELECT position, doc_id, vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
 JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) USING (position)""")
def _(spark, d):
    return joins.align_by_position(t.table(spark, d, "documents").select("doc_id"), t.table(spark, d, "embeddings").select("vec_id"), "doc_id", "vec_id")


@query("j14_value_map", """SELECT DISTINCT CASE trim(regexp_extract(location_address, '([^,]+)$', 1)) WHEN 'USA' THEN 'United States' WHEN 'Deutschland' THEN 'Germany'
 ELSE trim(regexp_extract(location_address, '([^,]+)$', 1)) END AS country, count(*) AS n FROM located_posts GROUP BY 1""")
def _(spark, d):
    from vidtrend.plans import geo
    return geo.with_country(t.located_posts(spark, d)).groupBy("country").agg(F.count("*").alias("n"))


@query("j15_trend_with_examples", """SELECT hashtag_name, count(*) AS n, arg_max("webVideoUrl", row("diggCount", post_id)) AS example FROM tag_posts GROUP BY 1""")
def _(spark, d):
    p = t.tag_posts(spark, d)
    ex = hashtags.example_rows(p, "hashtag_name", ("diggCount", "post_id"), {"example": "webVideoUrl"})
    return aggregates.counts(p, "hashtag_name").join(ex, "hashtag_name", "left")


# --- aggregates -----------------------------------------------------------------------------

@query("a1_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return aggregates.counts(t.table(spark, d, "events"), "event_type", "user_id")


@query("a2_distinct_counts", "SELECT hashtag_name, count(DISTINCT post_id) AS posts FROM baskets GROUP BY 1")
def _(spark, d):
    return aggregates.distinct_counts(t.baskets(spark, d), ["hashtag_name"], "post_id", "posts")


@query("a3_metric_statistics", """SELECT hashtag_name, CAST(sum("playCount") AS BIGINT) AS "playCount_sum", R6(avg("playCount")) AS "playCount_mean", max("playCount") AS "playCount_max",
 R6(stddev_samp("playCount")) AS "playCount_std", count(*) AS row_count FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return aggregates.describe_metrics(t.tag_posts(spark, d), ["hashtag_name"], ["playCount"])


@query("a4_first_non_null", """SELECT "author_nickName", arg_max("textLanguage", row("playCount", post_id)) AS first_language, arg_max(nullif("textLanguage", 'en'), row("playCount", post_id))
 FILTER ("textLanguage" <> 'en') AS first_other FROM posts GROUP BY 1""")
def _(spark, d):
    p = t.posts(spark, d)
    return p.groupBy("author_nickName").agg(best("textLanguage", "playCount", "post_id").alias("first_language"),
                                            best(F.nullif("textLanguage", F.lit("en")), "playCount", "post_id").alias("first_other"))


@query("a5_medians", """SELECT hashtag_name, R6(quantile_cont("playCount", 0.5)) AS median FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return aggregates.medians(t.tag_posts(spark, d), ["hashtag_name"], "playCount")


@query("a6_quantiles_by_group", """SELECT "textLanguage", R6(quantile_cont("playCount", 0.25)) AS q0250, R6(quantile_cont("playCount", 0.5)) AS q0500, R6(quantile_cont("playCount", 0.975)) AS q0975 FROM posts GROUP BY 1""")
def _(spark, d):
    return exact_quantiles(t.posts(spark, d), "playCount", [0.25, 0.5, 0.975], ["textLanguage"])


@query("a7_value_shares", """SELECT event_type, count(*) AS n, R6(count(*) / (SELECT count(*) FROM events)) AS share FROM events GROUP BY 1""")
def _(spark, d):
    return aggregates.value_shares(t.table(spark, d, "events"), "event_type")


@query("a8_crosstab", "SELECT \"author_nickName\", " + ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in ("negative", "neutral", "positive"))
       + " FROM scored_posts GROUP BY 1")
def _(spark, d):
    return aggregates.crosstab(t.scored_posts(spark, d), "author_nickName", "sentiment", ["negative", "neutral", "positive"])


@query("a9_two_period_pivot", """SELECT hashtag_name, count(*) FILTER ("createTimeISO" < TIMESTAMP '2024-01-16') AS first_half, count(*) FILTER ("createTimeISO" >= TIMESTAMP '2024-01-16') AS second_half FROM tag_posts GROUP BY 1""")
def _(spark, d):
    half = F.when(F.to_date("createTimeISO") < F.lit("2024-01-16").cast("date"), "first_half").otherwise("second_half")
    return aggregates.crosstab(t.tag_posts(spark, d).withColumn("half", half), "hashtag_name", "half", ["first_half", "second_half"])


@query("a10_row_shares", "WITH c AS (SELECT \"author_nickName\", " + ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in ("negative", "neutral", "positive"))
       + " FROM scored_posts GROUP BY 1) SELECT *, " + ", ".join(f"R6({s} * 100.0 / (negative + neutral + positive)) AS {s}_pct" for s in ("negative", "neutral", "positive")) + " FROM c")
def _(spark, d):
    kinds = ["negative", "neutral", "positive"]
    return aggregates.row_shares(aggregates.crosstab(t.scored_posts(spark, d), "author_nickName", "sentiment", kinds), kinds, 100.0, "_pct")


@query("a11_post_shares", "SELECT hashtag_name, count(DISTINCT post_id) AS n, R6(count(DISTINCT post_id) / (SELECT count(DISTINCT post_id) FROM baskets)) AS share FROM baskets GROUP BY 1")
def _(spark, d):
    return aggregates.post_shares(t.baskets(spark, d), "hashtag_name", "post_id")


@query("a12_mention_shares", "SELECT hashtag_name, count(*) AS n, R6(count(*) / (SELECT count(*) FROM tag_posts)) AS share FROM tag_posts GROUP BY 1")
def _(spark, d):
    return aggregates.mention_shares(t.tag_posts(spark, d), "hashtag_name")


@query("a13_peak_normalised", """WITH c AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd, count(*) AS n FROM tag_posts GROUP BY 1, 2)
SELECT hashtag_name, CAST(dd AS VARCHAR) AS day, R6(n * 100.0 / max(n) OVER (PARTITION BY hashtag_name)) AS interest FROM c""")
def _(spark, d):
    daily = windows.daily_counts(t.tag_posts(spark, d).withColumn("day", F.to_date("createTimeISO")), "hashtag_name", "day")
    return aggregates.peak_normalised(daily, ["hashtag_name"], "n", "interest", 100.0).select("hashtag_name", "day", "interest")


@query("a14_fair_shares", """WITH x AS (SELECT hashtag_name, "playCount" / count(*) OVER (PARTITION BY post_id) AS f FROM baskets)
SELECT hashtag_name, round(sum(f), 2) AS fair_total, R6(avg(f)) AS fair_mean, count(*) AS posts FROM x GROUP BY 1""")
def _(spark, d):
    return aggregates.fair_shares(t.baskets(spark, d), "post_id", "hashtag_name", "playCount").withColumn("fair_total", F.round("fair_total", 2))


@query("a15_comment_rollup", """SELECT post_id, count(*) AS comments, TS(min(comment_time)) AS first_comment, TS(max(comment_time)) AS last_comment, CAST(sum(likes) AS BIGINT) AS likes_sum,
 R6(avg(likes)) AS likes_mean, max(likes) AS likes_max, R6(coalesce(stddev_samp(likes), -1)) AS likes_std, count(DISTINCT "user") AS distinct_users, count(DISTINCT language) AS distinct_languages FROM comments GROUP BY 1""")
def _(spark, d):
    return aggregates.comment_rollup(t.comments(spark, d), time="comment_time").withColumn("likes_std", F.coalesce("likes_std", F.lit(-1.0)))


@query("a16_distinct_lists", """SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY 1""")
def _(spark, d):
    return t.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("a17_sorted_distinct_text", """SELECT hashtag_name, string_agg(DISTINCT text, ', ' ORDER BY text) AS sources FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return aggregates.tag_union(t.tag_posts(spark, d), "hashtag_name", "text")


@query("a18_time_range_text", """SELECT hashtag_name, DAYTEXT(min("createTimeISO")) || ' - ' || DAYTEXT(max("createTimeISO")) AS time_range FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return aggregates.time_range_text(t.tag_posts(spark, d), ["hashtag_name"], "createTimeISO")


@query("a19_histogram", """WITH m AS (SELECT min("playCount") AS lo, max("playCount") AS hi FROM posts)
SELECT CAST(least(floor(("playCount" - lo) / ((hi - lo) / 30.0)), 29) AS BIGINT) AS bin, count(*) AS n, R6(count(*) / (SELECT count(*) FROM posts)) AS share FROM posts, m GROUP BY 1""")
def _(spark, d):
    return aggregates.histogram(t.posts(spark, d), "playCount", 30)


@query("a20_bin_means", """WITH q AS (SELECT quantile_cont(video_duration, 0.05) AS lo, quantile_cont(video_duration, 0.95) AS hi FROM posts),
 b AS (SELECT *, CAST(least(greatest(ceil((video_duration - lo) / ((hi - lo) / 19.0)), 1), 19) AS BIGINT) AS bin FROM posts, q WHERE video_duration BETWEEN lo AND hi)
SELECT bin, R6(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 19.0)) AS bin_low, R6(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 19.0)) AS bin_high,
 R6(avg(video_duration)) AS mean_x, R6(avg("playCount")) AS mean_y, count(*) AS n FROM b GROUP BY bin""")
def _(spark, d):
    return aggregates.bin_means(t.posts(spark, d), "video_duration", "playCount")


@query("a21_labelled_bands", """SELECT CASE WHEN "playCount" <= 1000 THEN '<1k' WHEN "playCount" <= 10000 THEN '1k-10k' WHEN "playCount" <= 100000 THEN '10k-100k' ELSE '100k+' END AS band, count(*) AS n FROM posts GROUP BY 1""")
def _(spark, d):
    return t.posts(spark, d).groupBy(scalars.banded("playCount", [1000, 10_000, 100_000], ["<1k", "1k-10k", "10k-100k", "100k+"]).alias("band")).agg(F.count("*").alias("n"))


@query("a22_best_bin", """WITH q AS (SELECT quantile_cont(video_duration, 0.01) AS lo, quantile_cont(video_duration, 0.99) AS hi FROM posts),
 b AS (SELECT *, CAST(least(greatest(ceil((video_duration - lo) / ((hi - lo) / 100.0)), 1), 100) AS BIGINT) AS bin FROM posts, q WHERE video_duration BETWEEN lo AND hi),
 m AS (SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, avg("playCount") AS y FROM b GROUP BY bin), top AS (SELECT * FROM m ORDER BY y DESC, bin LIMIT 1)
SELECT printf('%.1f - %.1f', lo + (bin - 1) * ((hi - lo) / 100.0), lo + bin * ((hi - lo) / 100.0)) AS best_range, R6(y) AS best_mean FROM top""")
def _(spark, d):
    return aggregates.best_bin(t.posts(spark, d), "video_duration", "playCount")


@query("a23_mean_absolute", """SELECT hashtag_name, R6(avg(abs("playCount" - 5000))) AS mean_abs FROM tag_posts GROUP BY 1 ORDER BY avg(abs("playCount" - 5000)) DESC, 1 LIMIT 20""")
def _(spark, d):
    return aggregates.mean_absolute(t.tag_posts(spark, d).withColumn("v", F.col("playCount") - 5000), "hashtag_name", "v")


_CORR = ["playCount", "diggCount", "shareCount", "commentCount", "collectCount"]


@query("a24_correlated_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, R6(corr("{a}", "{b}")) AS corr FROM tag_posts""" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]) + ") WHERE abs(corr) > 0.7")
def _(spark, d):
    return aggregates.correlation_pairs(t.tag_posts(spark, d), _CORR)


@query("a25_retention", "SELECT count(*) AS total, count(*) FILTER (confidence >= 0.65) AS kept, count(*) FILTER (confidence < 0.65) AS lost, R6(count(*) FILTER (confidence >= 0.65) * 100.0 / count(*)) AS kept_pct FROM scored_posts")
def _(spark, d):
    return aggregates.retention(t.scored_posts(spark, d), "confidence", 0.65)


@query("a27_posts_per_hour", """SELECT CAST(hour("createTimeISO") AS BIGINT) AS hour, (CAST(dayofweek("createTimeISO") AS BIGINT) + 6) % 7 AS day_of_week, count(*) AS n FROM tag_posts GROUP BY 1, 2""")
def _(spark, d):
    f = scalars.calendar_fields("createTimeISO")
    return t.tag_posts(spark, d).groupBy(f["hour"].alias("hour"), f["day_of_week"].alias("day_of_week")).agg(F.count("*").alias("n"))


# --- windows --------------------------------------------------------------------------------

_DAILY = """WITH c AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd, count(DISTINCT post_id) AS n FROM tag_posts GROUP BY 1, 2) SELECT hashtag_name, CAST(dd AS VARCHAR) AS day, """


def _daily(spark, d):
    return windows.daily_counts(t.tag_posts(spark, d).withColumn("day", F.to_date("createTimeISO")), "hashtag_name", "day", "post_id")


_W = "OVER (PARTITION BY hashtag_name ORDER BY dd ROWS BETWEEN {} PRECEDING AND {})"


@query("w1_trailing_sum_rows", _DAILY + f"CAST(sum(n) {_W.format(6, 'CURRENT ROW')} AS BIGINT) AS s FROM c")
def _(spark, d):
    return windows.trailing_sum(_daily(spark, d), ["hashtag_name"], "day", "n", 7, "s").drop("n")


@query("w1_trailing_sum_calendar", _DAILY + "CAST(sum(n) OVER (PARTITION BY hashtag_name ORDER BY dd RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM c")
def _(spark, d):
    return windows.trailing_sum(_daily(spark, d), ["hashtag_name"], "day", "n", 7, "s", calendar=True).drop("n")


@query("w2_trailing_mean", _DAILY + f"R6(avg(n) {_W.format(2, 'CURRENT ROW')}) AS m FROM c")
def _(spark, d):
    return windows.trailing_mean(_daily(spark, d), ["hashtag_name"], "day", "n", 3, "m").drop("n")


@query("w3_centred_mean", _DAILY + f"R6(avg(n) {_W.format(1, '1 FOLLOWING')}) AS m FROM c")
def _(spark, d):
    return windows.centred_mean(_daily(spark, d), ["hashtag_name"], "day", "n", "m").drop("n")


@query("w4_previous_observed", _DAILY + "coalesce(lag(n) OVER (PARTITION BY hashtag_name ORDER BY dd), -1) AS p FROM c")
def _(spark, d):
    return windows.previous(_daily(spark, d), ["hashtag_name"], "day", "n", "p").select("hashtag_name", "day", F.coalesce("p", F.lit(-1)).alias("p"))


@query("w5_pct_change", _DAILY + "R6(coalesce((n - lag(n) OVER w) / lag(n) OVER w, 0)) AS ch FROM c WINDOW w AS (PARTITION BY hashtag_name ORDER BY dd)")
def _(spark, d):
    return windows.pct_change(_daily(spark, d), ["hashtag_name"], "day", "n", "ch").drop("n")


@query("w6_difference", _DAILY + "coalesce(n - lag(n) OVER w, 0) AS df FROM c WINDOW w AS (PARTITION BY hashtag_name ORDER BY dd)")
def _(spark, d):
    return windows.difference(_daily(spark, d), ["hashtag_name"], "day", "n", "df").drop("n")


@query("w7_group_mean_on_rows", """SELECT post_id, R6("diggCount" / (avg("diggCount") OVER (PARTITION BY hour("createTimeISO")) + 1)) AS relative FROM tag_posts""")
def _(spark, d):
    p = t.tag_posts(spark, d).withColumn("h", F.hour("createTimeISO"))
    out = group_total(p, ["h"], F.avg("diggCount"), "m", calendar=True)
    return out.select("post_id", scalars.ratio("diggCount", "m").alias("relative"))


@query("w8_top_per_week", """WITH c AS (SELECT date_trunc('week', "createTimeISO") AS w, hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, hashtag_name) AS rank FROM c)
SELECT DAYTEXT(w) AS week, hashtag_name, n, rank FROM r WHERE rank <= 5""")
def _(spark, d):
    c = t.tag_posts(spark, d).groupBy(scalars.week_start("createTimeISO").alias("week"), "hashtag_name").agg(F.count("*").alias("n"))
    return top_n(c, ["week"], [F.desc("n"), F.col("hashtag_name")], 5)


@query("w12_top_row_per_pair", """SELECT "author_nickName", sentiment, max(confidence) AS confidence, arg_max(post_id, row(confidence, post_id)) AS post_id FROM scored_posts GROUP BY 1, 2""")
def _(spark, d):
    return t.scored_posts(spark, d).groupBy("author_nickName", "sentiment").agg(
        F.max("confidence").alias("confidence"), best("post_id", "confidence", "post_id").alias("post_id"))


@query("w14_robust_z", """WITH c AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd, count(DISTINCT post_id) AS n FROM tag_posts GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY hashtag_name ORDER BY dd DESC) AS rn, count(*) OVER (PARTITION BY hashtag_name) AS k FROM c),
 s AS (SELECT hashtag_name, max(n) FILTER (rn = 1) AS last_value, median(n) FILTER (rn > 1) AS med, mad(n) FILTER (rn > 1) AS md FROM r WHERE k >= 2 GROUP BY 1)
SELECT hashtag_name, last_value, R6(med) AS hist_median, R6(md) AS hist_mad, R6((last_value - med) / CASE WHEN md = 0 THEN 1 ELSE md * 1.482602218505602 END) AS z FROM s""")
def _(spark, d):
    return windows.robust_z_last(_daily(spark, d), ["hashtag_name"], "day", "n").drop("periods")


@query("w16_z_normalised", """SELECT post_id, R6(("playCount" - (SELECT avg("playCount") FROM tag_posts)) / ((SELECT stddev_samp("playCount") FROM tag_posts) + 1e-8)) AS "playCount_z" FROM tag_posts""")
def _(spark, d):
    return windows.z_normalised(t.tag_posts(spark, d).select("post_id", "playCount"), ["playCount"]).drop("playCount")


@query("w17_min_max", """WITH c AS (SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1)
SELECT hashtag_name, R6((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())) AS scaled FROM c""")
def _(spark, d):
    return windows.min_max(aggregates.counts(t.tag_posts(spark, d), "hashtag_name").withColumn("n", F.col("n").cast("double")), "n", "scaled").drop("n")


@query("w18_preceding_rows", """SELECT post_id, coalesce(list_sum(list("diggCount") OVER w), 0)::BIGINT AS digg_before, len(coalesce(list(post_id) OVER w, [])) AS size
 FROM tag_posts WINDOW w AS (PARTITION BY "author_nickName" ORDER BY "createTimeISO", post_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    p = preceding_rows(t.tag_posts(spark, d), "createTimeISO", "post_id", ["author_nickName"], ["diggCount", "post_id"], 24, block=50)
    return p.select("post_id", F.aggregate("history", F.lit(0).cast("bigint"), lambda a, x: a + x["diggCount"]).alias("digg_before"), F.size("history").alias("size"))


@query("w19_without_repeats", rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '({q.WORD}{{2,}})', 1) AS w FROM conversations)
SELECT conv_id, turn, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF i = 1 OR w[i] <> w[i - 1]], ', ') AS words FROM w""")
def _(spark, d):
    c = t.table(spark, d, "conversations").withColumn("w", text.word_tokens("text"))
    return c.select("conv_id", "turn", windows.without_repeats("w").alias("words"))


@query("x29_top_probability", """SELECT vec_id, R6(list_max([CAST(x AS DOUBLE) FOR x IN embedding])) AS top FROM embeddings""")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = t.table(spark, d, "embeddings").withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    return e.select("vec_id", scalars.top_probability("v").alias("top"))


# --- top-k, samples, sets -------------------------------------------------------------------

@query("l1_top_k", """SELECT post_id, "playCount" FROM tag_posts ORDER BY "playCount" DESC, post_id LIMIT 20""")
def _(spark, d):
    return t.tag_posts(spark, d).select("post_id", "playCount").orderBy(F.desc("playCount"), "post_id").limit(20)


@query("l2_multi_key_sort", """SELECT hashtag_name, "author_nickName", count(*) AS n FROM tag_posts GROUP BY 1, 2 ORDER BY hashtag_name, n DESC, 2""")
def _(spark, d):
    return aggregates.counts(t.tag_posts(spark, d), "hashtag_name", "author_nickName").orderBy("hashtag_name", F.desc("n"), "author_nickName")


@query("l3_most_common", """SELECT "author_nickName", count(*) AS n FROM tag_posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, d):
    return aggregates.top_values(t.tag_posts(spark, d), "author_nickName", 15)


@query("l4_examples_by_id", """SELECT hashtag_name, post_id, rank FROM (SELECT hashtag_name, post_id, row_number() OVER (PARTITION BY hashtag_name ORDER BY post_id) AS rank FROM tag_posts) WHERE rank <= 3""")
def _(spark, d):
    return top_n(t.tag_posts(spark, d).select("hashtag_name", "post_id"), ["hashtag_name"], [F.col("post_id")], 3)


@query("l5_repeatable_sample", "SELECT post_id FROM posts ORDER BY md5('42:' || post_id), post_id LIMIT 200")
def _(spark, d):
    return dedupe.sample_by_hash(t.posts(spark, d), "post_id", 200).select("post_id")


@query("u1_union_all", "SELECT doc_id AS id, lang AS kind FROM documents UNION ALL SELECT conv_id, role FROM conversations")
def _(spark, d):
    a = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    return a.unionByName(t.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("kind")))


@query("u2_union_distinct_keys", """SELECT hashtag_name FROM tag_posts WHERE "isAd" UNION SELECT hashtag_name FROM tag_posts WHERE "isSponsored" """)
def _(spark, d):
    p = t.tag_posts(spark, d)
    return p.filter("isAd").select("hashtag_name").union(p.filter("isSponsored").select("hashtag_name")).distinct()


# --- scalar functions -----------------------------------------------------------------------

@query("x12_country_of_address", "SELECT post_id, trim(regexp_extract(location_address, '([^,]+)$', 1)) AS country FROM located_posts")
def _(spark, d):
    return t.located_posts(spark, d).select("post_id", text.country_of("location_address").alias("country"))


@query("x13_coerced_timestamp", """SELECT post_id, CASE WHEN post_id % 2 = 0 THEN DAYTEXT("createTimeISO") END AS day FROM posts""")
def _(spark, d):
    raw = F.when(F.col("post_id") % 2 == 0, F.date_format("createTimeISO", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a date")
    return t.posts(spark, d).select("post_id", F.to_date(scalars.to_timestamp(raw)).alias("day"))


@query("x14_zone_per_row", """SELECT post_id, TS("createTimeISO" AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN "isAd" THEN 'Asia/Tokyo' ELSE 'Europe/Berlin' END) AS local_time FROM posts""")
def _(spark, d):
    zone = F.when(F.col("isAd"), "Asia/Tokyo").otherwise("Europe/Berlin")
    return t.posts(spark, d).select("post_id", scalars.in_zone("createTimeISO", zone).alias("local_time"))


@query("x15_calendar_fields", """SELECT post_id, CAST(hour("createTimeISO") AS BIGINT) AS hour, CAST(isodow("createTimeISO") - 1 AS BIGINT) AS day_of_week, isodow("createTimeISO") >= 6 AS is_weekend,
 dayname("createTimeISO") AS day_name, strftime("createTimeISO", '%b') AS month_name, CAST(year("createTimeISO") AS BIGINT) AS year, CAST(week("createTimeISO") AS BIGINT) AS iso_week,
 CAST(isoyear("createTimeISO") AS BIGINT) AS iso_year FROM posts""")
def _(spark, d):
    f = scalars.calendar_fields("createTimeISO")
    return t.posts(spark, d).select("post_id", *[c.alias(n) for n, c in f.items()])


@query("x16_period_of_day", """SELECT CASE WHEN hour("createTimeISO") BETWEEN 5 AND 11 THEN 'morning' WHEN hour("createTimeISO") BETWEEN 12 AND 16 THEN 'afternoon'
 WHEN hour("createTimeISO") BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS period, count(*) AS n FROM posts GROUP BY 1""")
def _(spark, d):
    return t.posts(spark, d).groupBy(scalars.period_of_day(F.hour("createTimeISO")).alias("period")).agg(F.count("*").alias("n"))


@query("x17_week_and_month_starts", """SELECT post_id, WEEKTEXT("createTimeISO") AS week, DAYTEXT(date_trunc('month', "createTimeISO")) AS month, DAYTEXT(CAST("createTimeISO" AS DATE) - INTERVAL 1 MONTH) AS month_back FROM posts""")
def _(spark, d):
    return t.posts(spark, d).select("post_id", scalars.week_start("createTimeISO").alias("week"), scalars.month_start("createTimeISO").alias("month"),
                                    F.add_months(F.to_date("createTimeISO"), -1).alias("month_back"))


@query("x19_math", """SELECT post_id, R6(ln(1 + "playCount")) AS log_plays, R6(abs("diggCount" - 500)) AS gap, R6("diggCount" / ("shareCount" + 1)) AS ratio, least(greatest("diggCount", 10), 900) AS clipped FROM posts""")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.log1p("playCount").alias("log_plays"), F.abs(F.col("diggCount") - 500).cast("double").alias("gap"),
                                    scalars.ratio("diggCount", "shareCount").alias("ratio"), F.least(F.greatest("diggCount", F.lit(10)), F.lit(900)).alias("clipped"))


@query("x21_formatted", """SELECT hashtag_name, printf('%.1f - %.1f', min("playCount") / 1.0, max("playCount") / 1.0) AS play_range FROM tag_posts GROUP BY 1""")
def _(spark, d):
    return t.tag_posts(spark, d).groupBy("hashtag_name").agg(scalars.range_text(F.min("playCount").cast("double"), F.max("playCount").cast("double")).alias("play_range"))


@query("x22_list_from_text", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, d):
    schema = T.StructType([T.StructField("k", T.LongType())])
    return t.table(spark, d, "events").select("event_id", F.from_json("props", schema)["k"].alias("k"))


@query("x23_hours_between", """SELECT c.post_id, R6(min(epoch_us(comment_time) - epoch_us("createTimeISO")) / 3.6e9) AS hours FROM comments c JOIN posts p ON c.post_id = p.post_id GROUP BY 1""")
def _(spark, d):
    both = t.comments(spark, d).join(t.posts(spark, d).select("post_id", "createTimeISO"), "post_id")
    return both.groupBy("post_id").agg(F.min(scalars.hours_between("comment_time", "createTimeISO")).alias("hours"))


@query("x24_array_functions", r"""WITH w AS (SELECT post_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM posts)
SELECT post_id, len(ws) AS words, len(list_distinct(ws)) AS different, list_has_any(ws, ['the', 'der']) AS has_article, array_to_string(list_slice(list_sort(list_distinct(ws)), 1, 3), ', ') AS first_words FROM w""")
def _(spark, d):
    ws = text.word_tokens("text")
    return t.posts(spark, d).withColumn("ws", ws).select(
        "post_id", F.size("ws").alias("words"), F.size(F.array_distinct("ws")).alias("different"),
        F.arrays_overlap("ws", F.array(F.lit("the"), F.lit("der"))).alias("has_article"), F.slice(F.array_sort(F.array_distinct("ws")), 1, 3).alias("first_words"))


@query("x27_engagement_rates", """SELECT post_id, "diggCount" + "shareCount" + "commentCount" AS lsc, "diggCount" + "commentCount" + "shareCount" + "collectCount" AS social,
 "diggCount" + "shareCount" + "playCount" + "collectCount" + "commentCount" AS everything, CASE WHEN "playCount" = 0 THEN -1 ELSE R6(("diggCount" + "commentCount" + "shareCount" + "collectCount") / "playCount") END AS rate FROM posts""")
def _(spark, d):
    return t.posts(spark, d).select(
        "post_id", scalars.engagement(scalars.LIKES_SHARES_COMMENTS).alias("lsc"), scalars.engagement(scalars.SOCIAL).alias("social"),
        scalars.engagement().alias("everything"), F.coalesce(scalars.engagement_rate(), F.lit(-1.0)).alias("rate"))
