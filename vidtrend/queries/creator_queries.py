"""Videos, creators, countries, comments, viral score and result-table reports."""

from pyspark.sql import functions as F

from vidtrend.operators import aggregates, filters
from vidtrend.operators.scale import top_n
from vidtrend.plans import creators, entities, geo, hashtags, topics, virality
from vidtrend.queries import adapters as t
from vidtrend.queries import sqltext as q
from vidtrend.queries.entity_queries import TERMS
from vidtrend.queries.entity_queries import _whole as whole
from vidtrend.queries.registry import query
from vidtrend.queries.text_queries import STOP


@query("q12_viral_videos", """SELECT "webVideoUrl", max("playCount") AS "playCount", arg_max(post_id, row("playCount", -post_id)) AS post_id FROM tag_posts
 WHERE "createTimeISO" >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, d):
    return creators.top_viral(t.tag_posts(spark, d), as_of="2024-01-31").select("webVideoUrl", "playCount", "post_id")


@query("q15_influencers", """WITH p AS (SELECT "author_nickName", post_id, max("diggCount" + "shareCount" + "commentCount") AS e, max("playCount") AS pl FROM tag_posts
 WHERE CAST("createTimeISO" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1, 2)
SELECT "author_nickName", CAST(sum(e) AS BIGINT) AS engagement, CAST(sum(pl) AS BIGINT) AS plays, count(*) AS posts, R6(sum(e) / count(*)) AS avg_engagement FROM p GROUP BY 1 HAVING count(*) >= 40 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    return creators.influencers(t.tag_posts(spark, d), "2024-01-05", "2024-01-25", 40)


@query("q16_comment_phrases", f"""WITH c AS (SELECT lower(trim(comment)) AS c, min(comment_id) FROM comments GROUP BY 1),
 k AS (SELECT {q.letter_tokens('c', STOP)} AS ws FROM c WHERE NOT contains(c, 'speed')), g AS (SELECT unnest({q.ngrams('ws', 2)}) AS gram FROM k)
SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return creators.comment_phrases(t.comments(spark, d), stop=STOP)


@query("q16_creator_phrases", f"""WITH c AS (SELECT lower(trim(comment)) AS c, min(comment_id) FROM comments JOIN posts USING (post_id)
  WHERE "author_nickName" = 'src0' AND "createTimeISO" >= TIMESTAMP '2024-01-10' AND "createTimeISO" <= TIMESTAMP '2024-03-10' GROUP BY 1),
 k AS (SELECT {q.letter_tokens('c', STOP)} AS ws FROM c WHERE NOT contains(c, 'speed')),
 g AS (SELECT 2 AS words, unnest({q.ngrams('ws', 2)}) AS gram FROM k UNION ALL SELECT 3, unnest({q.ngrams('ws', 3)}) FROM k),
 n AS (SELECT words, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT words, gram, n FROM n QUALIFY row_number() OVER (PARTITION BY words ORDER BY n DESC, gram) <= 20""")
def _(spark, d):
    rows = t.comments(spark, d).join(t.posts(spark, d).select("post_id", "author_nickName", "createTimeISO"), "post_id")
    of = lambda n: creators.comment_phrases(rows, n=n, stop=STOP, creator="src0", start="2024-01-10", end="2024-03-10")
    return of(2).select(F.lit(2).alias("words"), "gram", "n").unionByName(of(3).select(F.lit(3).alias("words"), "gram", "n"))


_C = "trim(regexp_extract(location_address, '([^,]+)$', 1))"
_COUNTRY = f"CASE {_C} WHEN 'USA' THEN 'United States' WHEN 'Deutschland' THEN 'Germany' ELSE {_C} END"


@query("q17_country_metrics", f"""SELECT {_COUNTRY} AS country, count(*) AS posts, R6(avg("playCount")) AS mean_plays, R6(quantile_cont("playCount", 0.5)) AS median_plays FROM located_posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    return geo.country_metrics(geo.with_country(t.located_posts(spark, d)))


_ZONE = {"Kenya": "Africa/Nairobi", "United States": "America/New_York", "Japan": "Asia/Tokyo", "Germany": "Europe/Berlin", "Saudi Arabia": "Asia/Riyadh"}


@query("q17_local_hours", f"WITH x AS (SELECT {_COUNTRY} AS country, \"createTimeISO\" AS ts FROM located_posts) SELECT country, CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE country "
       + " ".join(f"WHEN '{c}' THEN '{z}'" for c, z in _ZONE.items()) + " END) AS BIGINT) AS hour, count(*) AS posts FROM x GROUP BY 1, 2")
def _(spark, d):
    return geo.local_hours(geo.with_country(t.located_posts(spark, d)))


_RATE = '("diggCount" + "commentCount" + "shareCount" + "collectCount") / nullif("playCount", 0)'


@query("q18_ad_split", f"""SELECT "isAd", count(r) AS posts, R6(avg(r)) AS mean_rate, R6(quantile_cont(r, 0.25)) AS q25, R6(quantile_cont(r, 0.5)) AS median, R6(quantile_cont(r, 0.75)) AS q75 FROM (SELECT "isAd", {_RATE} AS r FROM tag_posts) GROUP BY 1""")
def _(spark, d):
    return creators.ad_split(t.tag_posts(spark, d))


@query("q18_flag_mismatch", """SELECT count(*) FILTER ("isAd" <> "isSponsored") AS mismatches, count(*) AS row_count, R6(count(*) FILTER ("isAd" <> "isSponsored") / count(*)) AS share FROM posts""")
def _(spark, d):
    return creators.flag_mismatch(t.posts(spark, d))


@query("q27_comment_lengths", """SELECT DAYTEXT(comment_time) AS date, count(*) AS comments, R6(avg(length(comment))) AS mean_length, R6(quantile_cont(length(comment), 0.5)) AS median_length FROM comments GROUP BY 1""")
def _(spark, d):
    return creators.comment_lengths(t.comments(spark, d), ts="comment_time")


@query("q27_lengths_by_sentiment", """WITH x AS (SELECT *, length(text) AS l FROM scored_posts) SELECT sentiment, count(*) AS n, R6(avg(l)) AS mean_length FROM x WHERE l <= (SELECT quantile_cont(l, 0.95) FROM x) GROUP BY 1""")
def _(spark, d):
    return creators.lengths_by_label(t.scored_posts(spark, d), "text", "sentiment")


@query("q29_author_means", """SELECT "author_nickName", R6(avg("playCount")) AS "mean_playCount", R6(avg("diggCount")) AS "mean_diggCount", R6(avg("shareCount")) AS "mean_shareCount", R6(avg("commentCount")) AS "mean_commentCount" FROM tag_posts GROUP BY 1 ORDER BY avg("playCount") DESC, 1 LIMIT 20""")
def _(spark, d):
    return creators.author_means(t.tag_posts(spark, d))


_VIRAL = """WITH r AS (SELECT post_id, count(*) AS c, min(comment_time) AS f, max(comment_time) AS l, sum(likes) AS cl, count(DISTINCT "user") AS u FROM comments GROUP BY 1),
 b AS (SELECT p.*, coalesce(c, 0) AS c, f, l, coalesce(cl, 0) AS cl, coalesce(u, 0) AS u, avg("diggCount") OVER (PARTITION BY hour("createTimeISO")) AS hm FROM posts p LEFT JOIN r USING (post_id)),
 x AS (SELECT *, ("diggCount" + "shareCount" + c) / ("playCount" + 1) AS ve, c / ((epoch_us(l) - epoch_us(f)) / 3.6e9 + 1) AS cv, u / (c + 1) AS cd, "diggCount" / (hm + 1) AS re FROM b),
 s AS (SELECT post_id, ve, cv, cd, re, 0.3 * (ve - avg(ve) OVER ()) / (stddev_samp(ve) OVER () + 1e-8) + 0.25 * (cv - avg(cv) OVER ()) / (stddev_samp(cv) OVER () + 1e-8)
   + 0.25 * (cd - avg(cd) OVER ()) / (stddev_samp(cd) OVER () + 1e-8) + 0.2 * (re - avg(re) OVER ()) / (stddev_samp(re) OVER () + 1e-8) AS vs FROM x)"""


@query("q30_viral_score", _VIRAL + """ SELECT post_id, R6(ve) AS view_engagement, R6(cv) AS comment_velocity, R6(cd) AS commenter_diversity, R6(re) AS relative_engagement, R6(vs) AS viral_score,
 coalesce(vs >= (SELECT quantile_cont(vs, 0.8) FROM s), false) AS is_trending FROM s""")
def _(spark, d):
    rollup = aggregates.comment_rollup(t.comments(spark, d), time="comment_time")
    scored = virality.viral_score(t.posts(spark, d), rollup)
    return virality.with_trending_flag(scored).select(
        "post_id", "view_engagement", "comment_velocity", "commenter_diversity", "relative_engagement", "viral_score", "is_trending")


@query("q32_hashtag_board", """WITH c AS (SELECT hashtag_name, count(*) AS n FROM tag_posts WHERE lower(hashtag_name) NOT IN ('tag0', 'tag1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT hashtag_name, n, R6(n * 100.0 / (SELECT count(*) FROM tag_posts)) AS pct FROM c""")
def _(spark, d):
    p = t.tag_posts(spark, d)
    board = aggregates.top_values(filters.exclude(p, "hashtag_name", ["tag0", "tag1"]), "hashtag_name", 10)
    return board.withColumn("pct", F.col("n") * 100.0 / p.agg(F.count("*")).scalar())


@query("q32_entity_board", whole("scored_posts") + " SELECT entity, count(*) AS total_mentions FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, d):
    table = entities.sentiment_summary(entities.matched(t.scored_posts(spark, d), "text", TERMS), order=False)
    return table.select("entity", "total_mentions").orderBy(F.desc("total_mentions"), "entity").limit(3)


@query("w11_examples_per_sentiment", whole("scored_posts") + """, r AS (SELECT entity, sentiment, post_id, row_number() OVER (PARTITION BY entity, sentiment ORDER BY confidence DESC, post_id) AS rank FROM m)
SELECT * FROM r WHERE rank <= 2""")
def _(spark, d):
    m = entities.matched(t.scored_posts(spark, d), "text", TERMS)
    return top_n(m, ["entity", "sentiment"], [F.desc("confidence"), F.col("post_id")], 2).select("entity", "sentiment", "post_id", "rank")


@query("q32_topic_mention_shares", """SELECT topic, count(*) AS n, R6(count(*) / (SELECT count(*) FROM topic_posts WHERE topic <> -1)) AS share FROM topic_posts WHERE topic <> -1 GROUP BY 1""")
def _(spark, d):
    return aggregates.mention_shares(t.topic_posts(spark, d).filter(F.col("topic") != topics.NOISE), "topic")


@query("q32_latest_interest", """WITH b AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd FROM tag_posts), c AS (SELECT hashtag_name, dd, count(*) AS n FROM b WHERE dd > (SELECT max(dd) FROM b) - 7 GROUP BY 1, 2),
 i AS (SELECT hashtag_name, dd, n / max(n) OVER (PARTITION BY hashtag_name) AS x FROM c)
SELECT hashtag_name, R6(x * 100) AS interest FROM i WHERE dd = (SELECT max(dd) FROM b)""")
def _(spark, d):
    table = hashtags.daily_interest(t.tag_posts(spark, d))
    last = table.filter(F.col("post_date") == table.agg(F.max("post_date")).scalar())
    peak = table.groupBy("hashtag_name").agg(F.max("n").alias("_m"))
    return last.join(peak, "hashtag_name").select("hashtag_name", (F.col("n") * 100.0 / F.col("_m")).alias("interest"))


