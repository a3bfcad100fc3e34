"""Hashtag and music queries."""

from pyspark.sql import functions as F

from vidtrend.operators import aggregates
from vidtrend.operators.filters import quantile_keys
from vidtrend.plans import hashtags, music
from vidtrend.queries import adapters as t
from vidtrend.queries.registry import query
from vidtrend.session import cut_lineage

_WEEKS = """recent AS (SELECT *, CAST("createTimeISO" AS DATE) AS post_date,
    CAST(floor(((SELECT max(CAST("createTimeISO" AS DATE)) FROM {t}) - CAST("createTimeISO" AS DATE)) / 7) AS INT) AS week_no FROM {t})"""
_LABEL = """CASE WHEN {c} > q3 + 1.5 * (q3 - q1) THEN '📈 Rising' WHEN {c} < q1 - 1.5 * (q3 - q1) THEN '📉 Dropping' ELSE '⏸️ Stable' END"""
_FIX = """CASE WHEN {c} > {l} THEN '📈 Rising' WHEN {c} < -{l} THEN '📉 Dropping' ELSE '⏸️ Stable' END"""
_CHANGE = "({a} - {b}) / CASE WHEN {b} = 0 THEN 1 ELSE {b} END"
_SHARE3 = _WEEKS.format(t="tag_posts") + """,
 totals AS (SELECT count(DISTINCT post_id) FILTER (week_no = 0) d0, count(DISTINCT post_id) FILTER (week_no = 1) d1,
    count(DISTINCT post_id) FILTER (week_no = 2) d2 FROM recent),
 shares AS (SELECT hashtag_name, count(DISTINCT post_id) FILTER (week_no = 0) / any_value(d0) AS s0,
    count(DISTINCT post_id) FILTER (week_no = 1) / any_value(d1) AS s1, count(DISTINCT post_id) FILTER (week_no = 2) / any_value(d2) AS s2
    FROM recent, totals WHERE week_no < 3 AND hashtag_name IS NOT NULL GROUP BY 1),
 changed AS (SELECT *, REVEN(""" + _CHANGE.format(a="s0", b="s1") + ") AS c0, REVEN(" + _CHANGE.format(a="s1", b="s2") + """) AS c1 FROM shares),
 iqr AS (SELECT quantile_cont(c0, 0.25) q1, quantile_cont(c0, 0.75) q3 FROM changed)"""


@query("q1_hashtag_share_trends", "WITH " + _SHARE3 + """,
 top AS (SELECT * FROM changed, iqr WHERE s0 > 0 ORDER BY s0 DESC, hashtag_name LIMIT 20),
 ex AS (SELECT hashtag_name, arg_max(text, row("diggCount", post_id)) AS text, arg_max("webVideoUrl", row("diggCount", post_id)) AS "webVideoUrl",
    max("diggCount") AS "diggCount", arg_max(post_date, row("diggCount", post_id)) AS post_date FROM recent WHERE week_no = 0 GROUP BY 1)
SELECT hashtag_name, DAYTEXT(post_date) AS post_date, "diggCount", R6(s0) AS this_week_share, R6(s1) AS last_week_share, R6(s2) AS week_before_last_share,
 R6(c0) AS trend_change_pct, """ + _LABEL.format(c="c0") + " AS trend_label, R6(c1) AS last_week_trend_pct, " + _LABEL.format(c="c1") + """ AS last_week_trend_label,
 text, "webVideoUrl" FROM top JOIN ex USING (hashtag_name)""")
def _(spark, d):
    return hashtags.share_trends(hashtags.normalised(t.tag_posts(spark, d)))


@query("x20_iqr_labels_all_tags", "WITH " + _SHARE3 + " SELECT hashtag_name, R6(c0) AS trend_change_pct, " + _LABEL.format(c="c0")
       + " AS trend_label FROM changed, iqr WHERE s0 > 0")
def _(spark, d):
    return hashtags.share_trends(t.tag_posts(spark, d), top=None).select("hashtag_name", "trend_change_pct", "trend_label")


_ENG = '"diggCount" + "shareCount" + "playCount" + "collectCount" + "commentCount"'
_SOC = '"diggCount" + "commentCount" + "shareCount" + "collectCount"'


@query("q2_weekly_engagement", f"""WITH b AS (SELECT *, CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, {_ENG} AS e FROM tag_posts),
 s AS (SELECT hashtag_name, w, sum(e) AS weekly, count(DISTINCT post_id) AS n FROM b WHERE hashtag_name IS NOT NULL GROUP BY 1, 2),
 tot AS (SELECT w, count(DISTINCT post_id) AS total FROM b GROUP BY 1), f AS (SELECT * FROM s WHERE n >= 10)
SELECT hashtag_name, CAST(w AS VARCHAR) AS date, CAST(isoyear(w) AS BIGINT) AS year, CAST(week(w) AS BIGINT) AS week, CAST(weekly AS BIGINT) AS weekly_engagement,
 n AS post_count, total AS total_weekly_posts, R6(avg(n) OVER (PARTITION BY hashtag_name ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS smoothed_post_count,
 R6(weekly / max(weekly) OVER (PARTITION BY w)) AS normalized_weekly_engagement, R6(n / total) AS post_share_of_week FROM f JOIN tot USING (w)""")
def _(spark, d):
    return hashtags.weekly_engagement(t.tag_posts(spark, d), min_posts=10)


@query("q3_mention_trends", "WITH " + _WEEKS.format(t="tag_posts") + """,
 m AS (SELECT hashtag_name, count(DISTINCT post_id) FILTER (week_no = 0) AS n0, count(DISTINCT post_id) FILTER (week_no = 1) AS n1,
   count(DISTINCT post_id) FILTER (week_no = 2) AS n2 FROM recent WHERE week_no < 3 GROUP BY 1),
 c AS (SELECT *, REVEN(""" + _CHANGE.format(a="n0", b="n1") + ") AS c0, REVEN(" + _CHANGE.format(a="n1", b="n2") + """) AS c1 FROM m
   WHERE n0 > 0 ORDER BY n0 DESC, hashtag_name LIMIT 20),
 ex AS (SELECT hashtag_name, arg_max(text, row("diggCount", post_id)) AS text, arg_max("webVideoUrl", row("diggCount", post_id)) AS "webVideoUrl",
   max("diggCount") AS "diggCount", arg_max(post_date, row("diggCount", post_id)) AS post_date FROM recent WHERE week_no = 0 GROUP BY 1)
SELECT hashtag_name, n0 AS this_week_mentions, n1 AS last_week_mentions, n2 AS week_before_last_mentions, R6(c0) AS trend_change_pct, R6(c1) AS last_week_trend_pct,
 """ + _FIX.format(c="c0", l="0.5") + " AS trend_label, " + _FIX.format(c="c1", l="0.5") + """ AS last_week_trend_label, text, "webVideoUrl", "diggCount",
 DAYTEXT(post_date) AS post_date FROM c JOIN ex USING (hashtag_name)""")
def _(spark, d):
    return hashtags.mention_trends(t.tag_posts(spark, d))


@query("q3_daily_interest", """WITH b AS (SELECT *, CAST("createTimeISO" AS DATE) AS dd FROM tag_posts),
 c AS (SELECT hashtag_name, dd, count(DISTINCT post_id) AS n FROM b WHERE dd > (SELECT max(dd) FROM b) - 7 GROUP BY 1, 2)
SELECT hashtag_name, CAST(dd AS VARCHAR) AS post_date, n, R6(round_even(n / max(n) OVER (PARTITION BY hashtag_name) * 100 * 10, 0) / 10) AS interest FROM c""")
def _(spark, d):
    return hashtags.daily_interest(t.tag_posts(spark, d))


@query("q4_monthly_growth", """WITH m AS (SELECT "author_nickName" AS a, date_trunc('month', "createTimeISO") AS mo FROM posts),
 mx AS (SELECT date_trunc('month', max(mo)) AS last_mo FROM m),
 c AS (SELECT a, count(*) FILTER (mo < last_mo) AS prev_month, count(*) FILTER (mo = last_mo) AS last_month FROM m, mx
   WHERE mo >= last_mo - INTERVAL 1 MONTH GROUP BY 1)
SELECT a AS "author_nickName", prev_month, last_month, R6((last_month - prev_month) / prev_month) AS growth_rate FROM c
WHERE prev_month >= 5 AND last_month >= 5 AND last_month > prev_month ORDER BY (last_month - prev_month) / prev_month DESC, a LIMIT 10""")
def _(spark, d):
    return hashtags.monthly_growth(t.posts(spark, d), "author_nickName")


@query("q5_daily_zscore", """WITH b AS (SELECT hashtag_name, post_id, CAST("createTimeISO" AS DATE) AS dd FROM tag_posts),
 mx AS (SELECT max(dd) AS last FROM b), c AS (SELECT hashtag_name, dd, count(DISTINCT post_id) AS n FROM b, mx WHERE dd > last - 28 GROUP BY 1, 2),
 s AS (SELECT hashtag_name, max(n) FILTER (dd = last) AS last_value, avg(n) AS mean, stddev_samp(n) AS std FROM c, mx GROUP BY 1)
SELECT hashtag_name, last_value, R6(mean) AS mean, R6(std) AS std, R6((last_value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END) AS z FROM s WHERE last_value IS NOT NULL""")
def _(spark, d):
    return hashtags.daily_zscore(t.tag_posts(spark, d))


@query("q5_share_of_voice", "WITH " + _WEEKS.format(t="tag_posts") + """,
 c AS (SELECT hashtag_name, count(DISTINCT post_id) FILTER (week_no = 0) AS n0, count(DISTINCT post_id) FILTER (week_no = 1) AS n1 FROM recent WHERE week_no < 2 GROUP BY 1),
 s AS (SELECT hashtag_name, n0 / (sum(n0) OVER ()) AS s0, n1 / (sum(n1) OVER ()) AS s1 FROM c),
 x AS (SELECT *, """ + _CHANGE.format(a="s0", b="s1") + """ AS ch FROM s)
SELECT hashtag_name, R6(s0) AS this_week_share, R6(s1) AS last_week_share, R6(ch) AS share_change, """ + _FIX.format(c="ch", l="0.1") + " AS trend_label FROM x")
def _(spark, d):
    return hashtags.share_of_voice(t.tag_posts(spark, d))


@query("q6_leaderboard", """WITH b AS (SELECT lower(trim(hashtag_name)) AS tag, post_id, "author_nickName" AS a, date_trunc('week', "createTimeISO") AS w,
   "diggCount" + "shareCount" + "commentCount" AS e FROM tag_posts),
 wk AS (SELECT max(w) AS w1, (SELECT max(w) FROM b WHERE w < (SELECT max(w) FROM b)) AS w0 FROM b),
 s AS (SELECT tag, count(post_id) AS n, avg(e) FILTER (w = w1) AS al, avg(e) FILTER (w = w0) AS ap FROM b, wk GROUP BY 1),
 au AS (SELECT tag, a, sum(e) AS te FROM b GROUP BY 1, 2), cr AS (SELECT tag, arg_max(a, row(te, a)) AS top_creator FROM au GROUP BY 1)
SELECT tag AS hashtag_name, n AS post_count, R6(al) AS avg_last, R6(ap) AS avg_prev, top_creator, R6((al - ap) / ap * 100) AS engagement_change,
 CASE WHEN (al - ap) / ap * 100 > 0 THEN '📈' ELSE '📉' END AS trendline FROM s JOIN cr USING (tag) WHERE n >= 50 AND al IS NOT NULL AND ap IS NOT NULL""")
def _(spark, d):
    return hashtags.leaderboard(t.tag_posts(spark, d)).drop("avg_engagement")


@query("w9_leaderboard_rank", """WITH s AS (SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1 HAVING count(*) >= 50)
SELECT row_number() OVER (ORDER BY n DESC, hashtag_name) AS rank, hashtag_name, n AS post_count FROM s ORDER BY 1 LIMIT 10""")
def _(spark, d):
    board = hashtags.leaderboard(t.tag_posts(spark, d))
    return hashtags.ranked_leaderboard(board).select("rank", "hashtag_name", "post_count")


@query("q7_consistency", f"""WITH w AS (SELECT hashtag_name, date_trunc('week', "createTimeISO") AS w, sum({_SOC}) AS e FROM tag_posts GROUP BY 1, 2),
 x AS (SELECT *, e / max(e) OVER (PARTITION BY w) AS rel FROM w),
 g AS (SELECT hashtag_name, avg(e) AS m, stddev_samp(e) AS s, avg(rel) AS mr, count(*) AS wa FROM x GROUP BY 1),
 p AS (SELECT hashtag_name, count(DISTINCT post_id) AS n FROM tag_posts GROUP BY 1 HAVING count(DISTINCT post_id) >= 20),
 z AS (SELECT *, m * ln(1 + n) / (1 + coalesce(s, 0)) AS sc FROM g JOIN p USING (hashtag_name))
SELECT hashtag_name, R6(m) AS mean_weekly_engagement, R6(s) AS std_weekly_engagement, R6(mr) AS mean_normalized_weekly_engagement, wa AS weeks_active, n AS total_posts,
 R6(sc) AS score, R6((sc - min(sc) OVER ()) / (max(sc) OVER () - min(sc) OVER ())) AS normalized_score FROM z""")
def _(spark, d):
    return hashtags.consistency(t.tag_posts(spark, d))


def _rel(unit):
    return f"""{unit}s AS (SELECT hashtag_name, avg(m / mx) AS r FROM (SELECT *, max(m) OVER (PARTITION BY p) AS mx FROM
      (SELECT hashtag_name, date_trunc('{unit}', "createTimeISO") AS p, avg(e) AS m FROM b GROUP BY 1, 2)) GROUP BY 1)"""


@query("q8_relative_engagement", f"WITH b AS (SELECT *, {_SOC} AS e FROM tag_posts), {_rel('week')}, {_rel('month')}, {_rel('year')}," + """
 g AS (SELECT hashtag_name, count(DISTINCT post_id) AS n, avg(e) AS ae FROM b GROUP BY 1)
SELECT hashtag_name, n AS total_posts, R6(ae) AS average_engagement, R6(weeks.r) AS relative_engagement_week, R6(months.r) AS relative_engagement_month,
 R6(years.r) AS relative_engagement_year FROM g JOIN weeks USING (hashtag_name) JOIN months USING (hashtag_name) JOIN years USING (hashtag_name)""")
def _(spark, d):
    return hashtags.relative_engagement(t.tag_posts(spark, d))


_PAIRS = """WITH p AS (SELECT DISTINCT post_id, hashtag_name AS h FROM baskets),
 c AS (SELECT x.h AS a, y.h AS b, count(*) AS n FROM p x JOIN p y ON x.post_id = y.post_id AND x.h < y.h GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("q9_cooccurrence", _PAIRS + " SELECT a, b, n FROM c")
def _(spark, d):
    return hashtags.cooccurrence(t.baskets(spark, d))


@query("a26_weighted_degree", _PAIRS + """ SELECT item, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT a AS item, n FROM c UNION ALL SELECT b, n FROM c)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return aggregates.pair_degrees(hashtags.cooccurrence(t.baskets(spark, d)))


@query("q10_components", """WITH RECURSIVE k AS (SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS kk, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5),
 e AS (SELECT 'u' || u AS x, 'k' || kk AS y FROM k), s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
 r(v, m) AS (SELECT x, least(x, y) FROM s UNION SELECT s.x, r.m FROM s JOIN r ON s.y = r.v)
SELECT v, min(m) AS label FROM r GROUP BY 1""")
def _(spark, d):
    e = t.table(spark, d, "events")
    pairs = e.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")).filter("n >= 5")
    pairs = pairs.select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("k"), "k").alias("b"), "n")
    return hashtags.components(pairs)


@query("q10_communities")
def _(spark, d):
    pairs = hashtags.cooccurrence(t.baskets(spark, d))
    return hashtags.communities(hashtags.connected(pairs))


@query("q10_communities_settled", _PAIRS + """, e AS (SELECT a AS v, b AS o FROM c UNION ALL SELECT b, a FROM c), g AS (SELECT v FROM e GROUP BY 1 HAVING count(*) > 3),
 k AS (SELECT a, b FROM c WHERE a IN (SELECT v FROM g) AND b IN (SELECT v FROM g))
SELECT count(DISTINCT v) AS vertices, 0 AS unsettled, 0 AS foreign_labels FROM (SELECT a AS v FROM k UNION ALL SELECT b FROM k)""")
def _(spark, d):
    pairs = cut_lineage(hashtags.connected(hashtags.cooccurrence(t.baskets(spark, d))))
    labels = cut_lineage(hashtags.communities(pairs))
    loose = hashtags.unsettled(pairs, labels).select(F.lit(1).alias("loose"))
    foreign = labels.join(labels.select(F.col("v").alias("label")), "label", "left_anti").select(F.lit(2).alias("loose"))
    return labels.select(F.lit(0).alias("loose")).unionByName(loose).unionByName(foreign).agg(
        F.count_if(F.col("loose") == 0).alias("vertices"), F.count_if(F.col("loose") == 1).alias("unsettled"),
        F.count_if(F.col("loose") == 2).alias("foreign_labels"))


@query("q10_modularity_communities")
def _(spark, d):
    return hashtags.modularity_communities(hashtags.connected(hashtags.cooccurrence(t.baskets(spark, d))))


@query("q10_modularity_is_settled", _PAIRS + """, e AS (SELECT a AS v, b AS o FROM c UNION ALL SELECT b, a FROM c), g AS (SELECT v FROM e GROUP BY 1 HAVING count(*) > 3),
 k AS (SELECT a, b FROM c WHERE a IN (SELECT v FROM g) AND b IN (SELECT v FROM g))
SELECT count(DISTINCT v) AS vertices, true AS as_measured, 0 AS merges_that_gain FROM (SELECT a AS v FROM k UNION ALL SELECT b FROM k)""")
def _(spark, d):
    pairs = cut_lineage(hashtags.connected(hashtags.cooccurrence(t.baskets(spark, d))))
    found = cut_lineage(hashtags.modularity_communities(pairs))
    edges = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    label = lambda end: found.select(F.col("v").alias(end), F.col("label").alias(f"l{end}"))
    # weight between communities against its expectation: a merge gains 2 (w / m - x y / m^2)
    links = cut_lineage(edges.join(label("a"), "a").join(label("b"), "b").groupBy("la", "lb").agg(F.sum("n").cast("double").alias("w")))
    size = links.groupBy("la").agg(F.sum("w").alias("x"))
    m = links.agg(F.sum("w")).scalar()
    met = links.filter("la <> lb").join(size, "la").join(size.select(F.col("la").alias("lb"), F.col("x").alias("y")), "lb")
    gains = met.filter(F.col("w") / m - F.col("x") * F.col("y") / (m * m) > 1e-9).agg(F.count("*")).scalar()
    inside = links.filter("la = lb").agg(F.sum("w")).scalar() / m - size.agg(F.sum(F.col("x") * F.col("x"))).scalar() / (m * m)
    return found.agg(F.count("*").alias("vertices"), (F.max(F.abs(F.col("modularity") - inside)) < 1e-9).alias("as_measured"),
                     F.max(gains).alias("merges_that_gain"))


@query("q11_popularity_quantiles", """WITH c AS (SELECT hashtag_name, count(DISTINCT post_id) AS n FROM tag_posts GROUP BY 1)
SELECT """ + ", ".join(f"R6(quantile_cont(n, {p})) AS q{round(p * 1000):04d}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99)) + " FROM c")
def _(spark, d):
    return hashtags.popularity(t.tag_posts(spark, d))


@query("q11_top_tags", "SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(spark, d):
    return aggregates.top_values(t.tag_posts(spark, d), "hashtag_name", 30)


@query("q11_search_tag_equality", """SELECT count(*) FILTER (lower("searchHashtag_name") = lower(hashtag_name)) AS equal_rows, count(*) AS row_count FROM tag_posts""")
def _(spark, d):
    return t.tag_posts(spark, d).agg(F.count_if(F.lower("searchHashtag_name") == F.lower("hashtag_name")).alias("equal_rows"),
                                     F.count("*").alias("row_count"))


@query("q31_popular_tags", """WITH c AS (SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1)
SELECT hashtag_name, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.8) FROM c)""")
def _(spark, d):
    return quantile_keys(t.tag_posts(spark, d), "hashtag_name", 0.8)


@query("q31_popular_tag_flags", """WITH c AS (SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1), k AS (SELECT hashtag_name FROM c WHERE n >= (SELECT quantile_cont(n, 0.8) FROM c))
SELECT post_id, max(CASE WHEN k.hashtag_name IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_popular_tag FROM tag_posts p LEFT JOIN k USING (hashtag_name) GROUP BY 1""")
def _(spark, d):
    return hashtags.popular_tag_flags(t.tag_posts(spark, d))


@query("u3_weekly_and_monthly_top", """WITH b AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd FROM tag_posts), mx AS (SELECT max(dd) AS last FROM b),
 w AS (SELECT hashtag_name, count(*) AS n, 'weekly' AS s FROM b, mx WHERE dd > last - 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
 m AS (SELECT hashtag_name, count(*) AS n, 'monthly' AS s FROM b, mx WHERE dd > last - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT hashtag_name, string_agg(s, ', ' ORDER BY s) AS sources FROM (SELECT * FROM w UNION ALL SELECT * FROM m) GROUP BY 1""")
def _(spark, d):
    return hashtags.top_by_period(t.tag_posts(spark, d))


@query("q13_music_trends", """WITH lic AS (SELECT * FROM music WHERE "musicOriginal" IS NOT TRUE), """ + _WEEKS.format(t="lic") + """,
 tot AS (SELECT count(DISTINCT post_id) FILTER (week_no = 0) AS d0, count(DISTINCT post_id) FILTER (week_no = 1) AS d1 FROM recent),
 s AS (SELECT "musicID", count(DISTINCT post_id) FILTER (week_no = 0) / any_value(d0) AS s0, count(DISTINCT post_id) FILTER (week_no = 1) / any_value(d1) AS s1
   FROM recent, tot WHERE week_no < 2 GROUP BY 1),
 top AS (SELECT * FROM s WHERE s0 > 0 ORDER BY s0 DESC, "musicID" LIMIT 15),
 ex AS (SELECT "musicID", any_value("musicName") AS "musicName", any_value("musicAuthor") AS "musicAuthor", any_value("playUrl") AS "playUrl", max(post_date) AS post_date
   FROM recent WHERE week_no = 0 GROUP BY 1)
SELECT "musicID", "musicName", "musicAuthor", "playUrl", DAYTEXT(post_date) AS post_date, R6(s0) AS this_week_share, R6(s1) AS last_week_share,
 R6(REVEN(""" + _CHANGE.format(a="s0", b="s1") + """)) AS trend_change_pct FROM top JOIN ex USING ("musicID")""")
def _(spark, d):
    return music.weekly_trends(t.music(spark, d))


_SURGE = """WITH b AS (SELECT "musicName" AS s, CAST("createTimeISO" AS DATE) AS dd FROM song_history),
 days AS (SELECT dd, row_number() OVER (ORDER BY dd DESC) AS rn FROM (SELECT DISTINCT dd FROM b)),
 f AS (SELECT s, count(*) FILTER (rn <= 7) AS recent_sum, count(*) FILTER (rn > 7 AND rn <= 67) / 60.0 AS hist_mean FROM b JOIN days USING (dd) GROUP BY 1),
 r AS (SELECT *, recent_sum / (hist_mean + 1e-6) AS ratio FROM f),
 p AS (SELECT *, (rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0) / (count(*) OVER ()) AS pct FROM r)"""


@query("q14_trending_songs", _SURGE + """ SELECT s AS "musicName", recent_sum, R6(hist_mean) AS hist_mean, R6(ratio) AS trend_ratio, R6(pct) AS percentile,
 music_author FROM (SELECT * FROM p WHERE pct >= 0.9 ORDER BY ratio DESC, s LIMIT 30) q
 JOIN (SELECT DISTINCT "musicName", "musicAuthor" AS music_author FROM song_history) a ON q.s = a."musicName" """)
def _(spark, d):
    songs = t.song_history(spark, d)
    return music.with_authors(music.surges(songs, pct=0.9), songs)


@query("w10_average_rank_pct", _SURGE + """ SELECT s AS "musicName", R6(pct) AS percentile FROM p""")
def _(spark, d):
    return music.surges(t.song_history(spark, d), pct=0.0, top=None).select("musicName", "percentile")


@query("w13_rolling_baseline", """WITH b AS (SELECT "musicName" AS s, CAST("createTimeISO" AS DATE) AS dd, count(*) AS n FROM song_history GROUP BY 1, 2),
 sp AS (SELECT k.s, dy.dd, coalesce(n, 0) AS n FROM (SELECT DISTINCT s FROM b) k CROSS JOIN (SELECT DISTINCT dd FROM b) dy LEFT JOIN b ON b.s = k.s AND b.dd = dy.dd)
SELECT s AS "musicName", CAST(dd AS VARCHAR) AS day, n, CAST(sum(n) OVER (PARTITION BY s ORDER BY dd ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_sum,
 CASE WHEN count(n) OVER h = 60 THEN R6(avg(n) OVER h) END AS hist_mean FROM sp
 WINDOW h AS (PARTITION BY s ORDER BY dd ROWS BETWEEN 66 PRECEDING AND 7 PRECEDING)""")
def _(spark, d):
    daily = t.song_history(spark, d).groupBy("musicName", F.to_date("createTimeISO").alias("day")).agg(F.count("*").alias("n"))
    return music.rolling_baseline(daily, "musicName", "day", "n")


@query("q28_top_tracks", """WITH r AS (SELECT * FROM music WHERE "createTimeISO" >= (SELECT max("createTimeISO") FROM music) - INTERVAL 30 DAY)
SELECT "musicName", count(*) AS n, R6(count(*) * 100.0 / (SELECT count(*) FROM r)) AS share_pct FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    return music.top_tracks(t.music(spark, d))


@query("q28_top_authors", """SELECT "musicAuthor", count(*) AS n, R6(count(*) * 100.0 / (SELECT count(*) FROM music)) AS share_pct FROM music GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    return music.top_tracks(t.music(spark, d), "musicAuthor")


@query("q28_original_split", """SELECT "musicOriginal", count(*) AS n, R6(count(*) / (SELECT count(*) FROM music)) AS share FROM music GROUP BY 1""")
def _(spark, d):
    return music.original_split(t.music(spark, d))
