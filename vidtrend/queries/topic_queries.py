"""Topic trends, bursts, clusters and summaries."""

from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.plans import density, topics, trends
from vidtrend.queries import adapters as t
from vidtrend.queries.registry import query
from vidtrend.queries.text_queries import STOP
from vidtrend.session import cut_lineage

_SERIES = """ser AS (SELECT topic, CAST("createTimeISO" AS DATE) AS dd, count(*) AS n FROM topic_posts GROUP BY 1, 2)"""
_Z = _SERIES + """, tot AS (SELECT dd, sum(n) AS tt FROM ser GROUP BY 1),
 ra AS (SELECT topic, dd, n / tt AS r FROM ser JOIN tot USING (dd) WHERE topic <> -1),
 sm AS (SELECT *, avg(r) OVER (PARTITION BY topic ORDER BY dd ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, row_number() OVER (PARTITION BY topic ORDER BY dd DESC) AS rn FROM ra),
 zz AS (SELECT topic, max(s) FILTER (rn = 1) AS lv, median(s) FILTER (rn > 1) AS med, mad(s) FILTER (rn > 1) AS md, count(*) AS periods FROM sm GROUP BY 1 HAVING count(*) >= {h}),
 z AS (SELECT *, (lv - med) / CASE WHEN md = 0 THEN 1 ELSE md * 1.482602218505602 END AS z FROM zz)"""
_BURST = """tot2 AS (SELECT dd, count(*) AS d FROM (SELECT CAST("createTimeISO" AS DATE) AS dd FROM topic_posts) GROUP BY 1),
 rd AS (SELECT topic, dd, n AS r, d, row_number() OVER (PARTITION BY topic ORDER BY dd) AS i, count(*) OVER (PARTITION BY topic) AS k, sum(n) OVER (PARTITION BY topic) / sum(d) OVER (PARTITION BY topic) AS p0 FROM ser JOIN tot2 USING (dd) WHERE topic <> -1),
 co AS (SELECT *, least(2.0 * p0, 0.9999) AS p1 FROM rd),
 cs AS (SELECT topic, i, k, -(r * ln(p0) + (d - r) * ln(1 - p0)) AS s0, -(r * ln(p1) + (d - r) * ln(1 - p1)) AS s1 FROM co WHERE k >= {h}),
 v(topic, i, k, c0, c1) AS (SELECT topic, i, k, s0, ln(k) + s1 FROM cs WHERE i = 1 UNION ALL
   SELECT cs.topic, cs.i, cs.k, least(v.c0, v.c1) + s0, least(v.c0 + ln(cs.k), v.c1) + s1 FROM v JOIN cs ON cs.topic = v.topic AND cs.i = v.i + 1)"""
_CHANGE = """wk AS (SELECT topic, CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, count(*) AS n FROM topic_posts GROUP BY 1, 2),
 sh AS (SELECT topic, w, n / sum(n) OVER (PARTITION BY w) AS share FROM wk), pv AS (SELECT *, lag(share) OVER (PARTITION BY topic ORDER BY w) AS prev FROM sh),
 ch AS (SELECT topic, share, prev, CASE WHEN prev > 0 THEN (share - prev) / prev ELSE 0 END AS rel, coalesce(share - prev, 0) AS ab FROM pv WHERE w = (SELECT max(w) FROM wk))"""


@query("t32_topics_over_time", f"WITH {_SERIES} SELECT topic, CAST(dd AS VARCHAR) AS day, n AS frequency FROM ser")
def _(spark, d):
    return trends.topic_series(t.topic_posts(spark, d))


@query("q22_robust_z", f"WITH {_Z.format(h=4)} SELECT topic, R6(lv) AS last_value, R6(med) AS hist_median, R6(md) AS hist_mad, R6(z) AS z FROM z WHERE z > -100")
def _(spark, d):
    return trends.robust_z(trends.topic_series(t.topic_posts(spark, d)), z=-100.0).drop("periods")


@query("q23_burst_levels", f"WITH RECURSIVE {_SERIES}, {_BURST.format(h=4)} SELECT topic, k AS n, CASE WHEN c1 < c0 THEN 1 ELSE 0 END AS level FROM v WHERE i = k")
def _(spark, d):
    p = t.topic_posts(spark, d)
    totals = p.groupBy(F.to_date("createTimeISO").alias("day")).agg(F.count("*").alias("d"))
    return trends.kleinberg(trends.topic_series(p), totals)


@query("q24_share_change", f"WITH {_CHANGE} SELECT topic, R6(share) AS share, R6(prev) AS previous_share, R6(rel) AS share_change FROM ch")
def _(spark, d):
    return trends.share_change(t.topic_posts(spark, d))


@query("q24_share_change_absolute", f"WITH {_CHANGE} SELECT topic, R6(share) AS share, R6(prev) AS previous_share, R6(ab) AS share_change FROM ch")
def _(spark, d):
    return trends.share_change(t.topic_posts(spark, d), mode="absolute")


@query("q22_topic_trends", f"""WITH RECURSIVE {_Z.format(h=2)}, {_BURST.format(h=2)}, {_CHANGE}, bl AS (SELECT topic, 1 AS level FROM v WHERE i = k AND c1 < c0),
 vol AS (SELECT topic, sum(n) AS volume FROM ser GROUP BY 1 HAVING sum(n) >= 4), b AS (SELECT coalesce(z.topic, bl.topic) AS topic, z.z, level FROM (SELECT topic, z FROM z WHERE z > 0.5) z FULL JOIN bl ON z.topic = bl.topic)
SELECT b.topic, R6(z) AS z, level, R6(coalesce(level, z)) AS score, CAST(volume AS BIGINT) AS volume, R6(coalesce(rel, 0)) AS share_change FROM b JOIN vol ON vol.topic = b.topic LEFT JOIN ch ON ch.topic = b.topic
ORDER BY coalesce(level, z) DESC, b.topic LIMIT 10""")
def _(spark, d):
    return trends.topic_trends(t.topic_posts(spark, d), z=0.5)


@query("t33_weekly_topic_rate", """WITH p AS (SELECT topic, CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, post_id, user_id FROM topic_posts),
 c AS (SELECT topic, w, count(post_id) AS comments FROM p WHERE topic <> -1 GROUP BY 1, 2), po AS (SELECT w, count(DISTINCT user_id) AS posts FROM p GROUP BY 1 HAVING count(DISTINCT user_id) >= 5)
SELECT topic, CAST(w AS VARCHAR) AS week, comments, posts, R6(comments / posts) AS rate, R6(avg(comments / posts) OVER (PARTITION BY topic ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS rate_smoothed FROM c JOIN po USING (w)""")
def _(spark, d):
    return topics.weekly_rate(t.topic_posts(spark, d), "topic", "createTimeISO", "post_id", "user_id")


@query("j16_similar_topics", """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
 n AS (SELECT label, sqrt(sum(m * m)) AS nn FROM c GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2)
SELECT a, b, R6(dot / (x.nn * y.nn)) AS cosine FROM p JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE dot / (x.nn * y.nn) > -0.2""")
def _(spark, d):
    e = t.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("label", F.col("v.m").alias("v"))
    return topics.similar_pairs(centres, "label", "v", -0.2)


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("j16_similar_vectors", f"""SELECT a.vec_id AS a, b.vec_id AS b, R6({_COS}) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.5""")
def _(spark, d):
    return topics.similar_pairs(t.table(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


def _prepared(spark, d):
    p = t.posts(spark, d).filter(F.col("textLanguage") == "en")
    return cut_lineage(p.select("post_id", "createTimeISO", "text", text.clean_tokens("text", STOP).alias("tokens")))


def _fitted(spark, d):
    data = topics.embed(_prepared(spark, d), "tokens")
    return topics.fit(data, k=8, min_size=5).drop("vector")


@query("t24_topic_assignment_quality")
def _(spark, d):
    fitted = topics.fit(t.table(spark, d, "embeddings"), "embedding", k=10, min_size=5, far=1.0)
    return fitted.groupBy("label", "topic").agg(F.count("*").alias("n"))


#: Distance of unit vectors with a cosine of 0.28; the given vectors have few pairs above 0.5.
REACH = 1.2


@query("t24_core_distances", f"""WITH p AS (SELECT a.vec_id, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 k AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS rn FROM p WHERE c > 0.28) SELECT vec_id, R6(sqrt(greatest(2 - 2 * c, 0))) AS core FROM k WHERE rn = 4""")
def _(spark, d):
    return density.core_distances(t.table(spark, d, "embeddings"), "vec_id", "embedding", 5, REACH)


def _dense(spark, d):
    return density.density_clusters(t.table(spark, d, "embeddings"), "vec_id", "embedding", 5, 10, REACH)


@query("t24_density_clusters")
def _(spark, d):
    return _dense(spark, d)


@query("t24_density_clusters_hold", "SELECT vec_id, true AS valid FROM embeddings")
def _(spark, d):
    got = cut_lineage(_dense(spark, d))
    sizes = got.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.max("strength").alias("most"))
    core = density.core_distances(t.table(spark, d, "embeddings"), "vec_id", "embedding", 5, REACH)
    known = got.join(sizes, "cluster", "left").join(core, "vec_id", "left")
    member = (F.col("n") >= 10) & (F.col("low") == F.col("cluster")) & (F.col("most") == 1) & F.col("strength").between(0, 1) & F.col("core").isNotNull()
    return known.select("vec_id", F.when(F.col("cluster").isNull(), F.col("strength") == 0).otherwise(member).alias("valid"))


@query("t24_text_topics")
def _(spark, d):
    return _fitted(spark, d).select("post_id", "topic", "probability")


@query("t24_text_topics_are_complete", """SELECT post_id, true AS valid FROM posts WHERE "textLanguage" = 'en'""")
def _(spark, d):
    valid = F.col("probability").between(0, 1) & F.col("topic").between(topics.NOISE, 7)
    return _fitted(spark, d).select("post_id", valid.alias("valid"))


@query("t25_t26_keywords_and_coherence")
def _(spark, d):
    fitted = _fitted(spark, d)
    words = topics.keywords(fitted, "tokens", k=10)
    return topics.labels(words).join(topics.coherence(fitted, "post_id", "tokens", words), "topic")


@query("t27_t28_t30_topic_summary")
def _(spark, d):
    fitted = _fitted(spark, d).join(t.scored_posts(spark, d).select("post_id", "sentiment"), "post_id", "left")
    names = topics.labels(topics.keywords(fitted, "tokens"))
    shown = topics.representatives(fitted, "post_id")
    return topics.summary(fitted, names, shown, "post_id", "text")


@query("t29_merged_labels", """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
 n AS (SELECT label, sqrt(sum(m * m)) AS nn FROM c GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2),
 s AS (SELECT b, max(a) AS a FROM p JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE dot / (x.nn * y.nn) > 0.1 GROUP BY 1)
SELECT n.label AS topic, 'topic ' || coalesce(s.a, n.label) AS name FROM n LEFT JOIN s ON s.b = n.label""")
def _(spark, d):
    e = t.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("label", F.col("v.m").alias("v"))
    names = centres.select(F.col("label").alias("topic"), F.concat(F.lit("Topic "), "label").alias("name"))
    return topics.merge_labels(names.withColumn("name", topics.normalise_label("name")), topics.similar_pairs(centres, "label", "v", 0.1))


@query("t30_topic_sentiment_shares", """WITH x AS (SELECT CAST(substr("author_nickName", 4) AS INT) - 1 AS topic, sentiment FROM scored_posts)
SELECT topic, """ + ", ".join(f"R6(count(*) FILTER (sentiment = '{s}') / count(*)) AS {s}_share" for s in ("negative", "neutral", "positive")) + " FROM x WHERE topic <> -1 GROUP BY 1")
def _(spark, d):
    p = t.scored_posts(spark, d).withColumn("topic", F.expr("int(substring(author_nickName, 4)) - 1"))
    return topics.sentiment_shares(p)


def _two_levels(spark, d):
    return topics.two_level(t.table(spark, d, "embeddings"), "vec_id", "embedding", k=3, sub_k=2, min_size=10, min_sub=5)


@query("t31_two_level_topics")
def _(spark, d):
    return _two_levels(spark, d).groupBy("super_topic", "sub_topic").agg(F.count("*").alias("frequency"))


@query("t31_two_levels_keep_all_rows", "SELECT vec_id, true AS placed FROM embeddings")
def _(spark, d):
    placed = (F.col("super_topic") >= topics.NOISE) & (F.col("sub_topic") >= topics.NOISE)
    return _two_levels(spark, d).select("vec_id", placed.alias("placed"))


@query("t38_topic_metadata")
def _(spark, d):
    fitted = _fitted(spark, d)
    rows = topics.metadata(fitted, topics.keywords(fitted, "tokens"), "post_id", "text", "createTimeISO")
    return rows.select("post_id", "topic", "name", "keywords", "time_range", F.size("examples").alias("examples"))


@query("t39_topics_by_sentiment")
def _(spark, d):
    p = t.scored_posts(spark, d).select("post_id", "sentiment", text.clean_tokens("text", STOP).alias("tokens"))
    out = topics.by_sentiment(p, "tokens", k=4)
    return out.select("post_id", "fit_on", "topic", "probability")


@query("t24_prepared_texts")
def _(spark, d):
    p = t.comments(spark, d).withColumn("textLanguage", F.lit("en"))
    return topics.prepare(p, stop=STOP).select("comment_id", "cleaned_text")
