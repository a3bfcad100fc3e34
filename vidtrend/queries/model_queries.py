"""Feature assembly, models, metrics and explanations."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.operators import aggregates
from vidtrend.plans import ml, virality
from vidtrend.queries import adapters as t
from vidtrend.queries.registry import query
from vidtrend.queries.text_queries import STOP
from vidtrend.session import cut_lineage, written

NUM = ["author_fans", "video_duration", "word_count", "hour_posting", "is_ad"]
DAILY_SQL = """WITH p AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd, post_id, max("diggCount") AS l, max("shareCount") AS s, max("playCount") AS pl FROM tag_posts GROUP BY 1, 2, 3),
 dl AS (SELECT hashtag_name, dd, count(*) AS n, sum(l) AS likes, sum(s) AS shares, sum(pl) AS plays FROM p GROUP BY 1, 2),
 r AS (SELECT *, sum(n) OVER (PARTITION BY hashtag_name ORDER BY dd ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7 FROM dl),
 c AS (SELECT *, coalesce((s7 - lag(s7) OVER w) / lag(s7) OVER w, 0) AS ch FROM r WINDOW w AS (PARTITION BY hashtag_name ORDER BY dd))"""


def _features(spark, d):
    return written(virality.features(t.posts(spark, d), stop=STOP))


@query("m1_feature_assembly")
def _(spark, d):
    tagged = virality.popular_tags(_features(spark, d)).select("post_id", "popular_tags", "tokens", *virality.NUMERIC)
    data = virality.with_grams(written(tagged))  # read by each step of the fit: joined and written once
    from pyspark.ml.functions import vector_to_array
    model = virality.assembler(with_tags=True).fit(data)
    return model.transform(data).select("post_id", F.size(vector_to_array("features")).alias("features"))


@query("m1_period_dummies", """WITH h AS (SELECT post_id, hour(("createTimeISO" AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin') AS h FROM posts)
SELECT post_id, CASE WHEN h >= 17 AND h < 21 THEN 1.0::DOUBLE ELSE 0.0 END AS period_evening, CASE WHEN h >= 5 AND h < 12 THEN 1.0::DOUBLE ELSE 0.0 END AS period_morning,
 CASE WHEN h >= 21 OR h < 5 THEN 1.0::DOUBLE ELSE 0.0 END AS period_night, CASE WHEN doc_sponsored THEN 1.0::DOUBLE ELSE 0.0 END AS is_sponsored
FROM h JOIN (SELECT post_id, "isSponsored" AS doc_sponsored FROM posts) USING (post_id)""")
def _(spark, d):
    return _features(spark, d).select("post_id", "period_evening", "period_morning", "period_night", "is_sponsored")


@query("m2_time_split", """WITH c AS (SELECT quantile_cont(epoch_us("createTimeISO"), 0.8) AS q FROM posts) SELECT post_id, epoch_us("createTimeISO") <= q AS in_train FROM posts, c""")
def _(spark, d):
    train, test = virality.time_split(t.posts(spark, d))
    return train.select("post_id", F.lit(True).alias("in_train")).unionByName(test.select("post_id", F.lit(False).alias("in_train")))


def _vectors(spark, d):
    return VectorAssembler(inputCols=NUM, outputCol="features").transform(_features(spark, d))


@query("m3_m14_boosted_regression")
def _(spark, d):
    train, test = virality.time_split(_vectors(spark, d))
    model = virality.regressor().fit(train)
    return ml.regression_report(model.transform(test), "viral_target")


@query("m4_boosted_classifier")
def _(spark, d):
    train, test = virality.time_split(virality.viral_labels(_vectors(spark, d)))
    model = virality.classifier().fit(train)
    return ml.confusion(model.transform(test), "is_viral")


@query("m4_viral_labels", """SELECT post_id, CASE WHEN ln(1 + "playCount") > (SELECT quantile_cont(ln(1 + "playCount"), 0.75) FROM posts) THEN 1.0::DOUBLE ELSE 0.0 END AS is_viral FROM posts""")
def _(spark, d):
    p = t.posts(spark, d).withColumn("viral_target", F.log1p("playCount"))
    return virality.viral_labels(p).select("post_id", "is_viral")


@query("m5_time_folds", """WITH q AS (SELECT """ + ", ".join(f"quantile_cont(epoch_us(\"createTimeISO\"), {i}/6.0::DOUBLE) AS q{i}" for i in range(1, 7)) + """ FROM posts), e AS (SELECT epoch_us("createTimeISO") AS x FROM posts)
""" + " UNION ALL ".join(f"SELECT {i} AS fold, count(*) FILTER (x <= q{i}) AS train_rows, count(*) FILTER (x > q{i} AND x <= q{i + 1}) AS test_rows FROM e, q" for i in range(1, 6)))
def _(spark, d):
    out = None
    for i, (train, test) in enumerate(virality.time_folds(t.posts(spark, d).select("post_id", "createTimeISO")), 1):
        both = train.select(F.lit(1).alias("k")).unionByName(test.select(F.lit(2).alias("k")))
        row = both.agg(F.lit(i).alias("fold"), F.count_if(F.col("k") == 1).alias("train_rows"), F.count_if(F.col("k") == 2).alias("test_rows"))
        out = row if out is None else out.unionByName(row)
    return out


_SLICES = """q AS (SELECT """ + ", ".join(f"quantile_cont(epoch_us(\"createTimeISO\"), {i}/6.0::DOUBLE) AS q{i}" for i in range(1, 6)) + """ FROM posts),
 r AS (SELECT CAST(video_duration AS DOUBLE) AS a, CAST("commentCount" AS DOUBLE) AS b, ln(1 + CAST("playCount" AS DOUBLE)) AS y,
 """ + " + ".join(f"CAST(epoch_us(\"createTimeISO\") > q{i} AS INT)" for i in range(1, 6)) + """ AS s FROM posts, q
 WHERE video_duration IS NOT NULL AND "commentCount" IS NOT NULL AND "playCount" IS NOT NULL AND "createTimeISO" IS NOT NULL)"""


@query("m5_time_series_validation", "WITH " + _SLICES + """, f AS (SELECT generate_series AS fold FROM generate_series(1, 5)),
 t AS (SELECT fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_
  FROM f JOIN r ON s < fold GROUP BY fold),
 w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM t),
 g AS (SELECT fold, n, y, y - (my + wa * (a - ma) + wb * (b - mb)) AS gap FROM w JOIN r ON s = fold),
 m AS (SELECT fold, any_value(n) AS train_rows, count(*) AS test_rows, sqrt(avg(gap * gap)) AS rmse, avg(abs(gap)) AS mae, 1 - sum(gap * gap) / (var_pop(y) * count(*)) AS r2 FROM g GROUP BY fold)
SELECT fold, train_rows, test_rows, R6(rmse) AS rmse, R6(mae) AS mae, R6(r2) AS r2 FROM m
UNION ALL SELECT 0, CAST(sum(train_rows) AS BIGINT), CAST(sum(test_rows) AS BIGINT), R6(avg(rmse)), R6(avg(mae)), R6(avg(r2)) FROM m""")
def _(spark, d):
    posts = t.posts(spark, d).withColumn("y", F.log1p(F.col("playCount").cast("double")))
    return virality.time_series_validation(posts, ["video_duration", "commentCount"], "y")


_DRAW = "CAST('0x' || substr(md5('{m}' || {k}), 1, 8) AS BIGINT)"


@query("m6_hash_split", f"""SELECT post_id, {_DRAW.format(m='42:fold:', k='post_id')} % 5 AS fold,
 CASE WHEN {_DRAW.format(m='42:', k="post_id || ':' || sentiment")} % 10000 < 8000 THEN 'train' ELSE 'test' END AS part FROM scored_posts""")
def _(spark, d):
    train, test = ml.hash_split(ml.fold_column(t.scored_posts(spark, d), "post_id"), "post_id", "sentiment")
    return train.select("post_id", "fold", F.lit("train").alias("part")).unionByName(test.select("post_id", "fold", F.lit("test").alias("part")))


@query("m7_tag_trend_features", DAILY_SQL + """ SELECT hashtag_name, CAST(dd AS VARCHAR) AS day, n AS post_count, CAST(likes AS BIGINT) AS likes, CAST(shares AS BIGINT) AS shares, CAST(plays AS BIGINT) AS plays,
 CAST(s7 AS BIGINT) AS posts_7, R6(ch) AS change_7, CASE WHEN ch > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS label FROM c""")
def _(spark, d):
    return ml.daily_tag_features(t.tag_posts(spark, d))


@query("m7_m8_ranked_tags")
def _(spark, d):
    data = ml.daily_tag_features(t.tag_posts(spark, d))
    model = ml.train_tag_trend(data)
    return ml.rank_tags(model.transform(data), days=7, minimum=None)


@query("m9_weekly_features", """WITH w AS (SELECT hashtag_name, CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, count(*) AS n, avg("diggCount" + "shareCount" + "commentCount") AS e, avg(CASE WHEN "isSponsored" THEN 1.0 ELSE 0 END) AS sp FROM tag_posts GROUP BY 1, 2),
 p AS (SELECT *, lag(n) OVER (PARTITION BY hashtag_name ORDER BY w) AS pn FROM w)
SELECT hashtag_name, CAST(w AS VARCHAR) AS week, n AS post_count, R6(e) AS avg_engagement, R6(sp) AS sponsored_ratio, pn AS previous_count, R6((n - pn) / (pn + 1e-6)) AS growth, CASE WHEN (n - pn) / (pn + 1e-6) > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS label FROM p WHERE pn IS NOT NULL""")
def _(spark, d):
    return ml.weekly_tag_features(t.tag_posts(spark, d))


@query("m9_m18_weekly_forest")
def _(spark, d):
    data = ml.weekly_tag_features(t.tag_posts(spark, d))
    scored = ml.train_weekly_forest(data).transform(data)
    return ml.predicted(ml.decoded(scored, ["steady", "trending"])).select("hashtag_name", "week", "label", "prediction", "predicted_label")


def _engagement(spark, d):
    p = t.tag_posts(spark, d).withColumns({"tags": F.array("hashtag_name"), "tokens": text.word_tokens("text")})
    return cut_lineage(ml.tag_popularity(ml.engagement_labels(p)))


@query("m10_engagement_labels", """WITH e AS (SELECT *, "diggCount" + "shareCount" + "commentCount" AS e FROM tag_posts), u AS (SELECT hashtag_name, count(*) AS n FROM tag_posts GROUP BY 1)
SELECT post_id, CASE WHEN e > (SELECT quantile_cont(e, 0.5) FROM e) THEN 1.0::DOUBLE ELSE 0.0 END AS label, CAST(hour("createTimeISO") AS DOUBLE) AS hour, R6(n) AS avg_tag_popularity FROM e JOIN u USING (hashtag_name)""")
def _(spark, d):
    return _engagement(spark, d).select("post_id", "label", "hour", "avg_tag_popularity")


_NUMERIC = ("playCount", "hour", "dayofweek", "avg_tag_popularity")


@query("m10_m11_importance_by_kind")
def _(spark, d):
    data = _engagement(spark, d)
    model = ml.engagement_pipeline().fit(data)
    return ml.importance_by_kind(ml.coefficient_table(model, data, _NUMERIC)).select("kind", "features", "share")


@query("m12_scored_posts")
def _(spark, d):
    data = _engagement(spark, d)
    model = ml.engagement_pipeline().fit(data)
    return ml.score_posts(model, data, 1.0, 0.5).select("post_id", "score", "band")


@query("m13_soft_vote")
def _(spark, d):
    train, test = ml.hash_split(_engagement(spark, d), "post_id")
    out = ml.soft_vote(train, test, ["playCount", "hour", "dayofweek", "avg_tag_popularity"])
    return out.select("post_id", "probability_mean", "prediction")


@query("m13_vote_is_a_probability", f"""SELECT post_id, true AS in_range FROM tag_posts WHERE {_DRAW.format(m='42:', k='post_id')} % 10000 >= 8000""")
def _(spark, d):
    train, test = ml.hash_split(_engagement(spark, d), "post_id")
    out = ml.soft_vote(train, test, list(_NUMERIC))
    agrees = (F.col("probability_mean") >= 0.5) == (F.col("prediction") == 1)
    return out.select("post_id", (F.col("probability_mean").between(0, 1) & agrees).alias("in_range"))


_PRED = """WITH x AS (SELECT CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END AS label, CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END AS prediction, ((doc_id * 37) % 100) / 100.0::DOUBLE AS score FROM labels)"""


def _predictions(spark, d):
    return t.table(spark, d, "labels").select(
        F.when(F.col("toxic") == 1, 1.0).otherwise(0.0).alias("label"), F.when(F.col("quality") == 0, 1.0).otherwise(0.0).alias("prediction"),
        (F.expr("(doc_id * 37) % 100") / 100.0).alias("score"))


@query("m14_classification_report", _PRED + """, k AS (SELECT unnest([0.0, 1.0]) AS c), g AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS p, count(*) FILTER (label = c AND prediction = c) AS h FROM k, x GROUP BY 1),
 m AS (SELECT *, coalesce(h / nullif(p, 0), 0) AS pr, coalesce(h / nullif(support, 0), 0) AS re FROM g)
SELECT CAST(c AS DOUBLE) AS class, support, R6(pr) AS precision, R6(re) AS recall, R6(coalesce(2 * pr * re / nullif(pr + re, 0), 0)) AS f1, R6((SELECT count(*) FILTER (label = prediction) / count(*) FROM x)) AS accuracy FROM m WHERE support + p > 0""")
def _(spark, d):
    return ml.classification_report(_predictions(spark, d))


@query("m14_auc", _PRED + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x)
SELECT R6((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))) AS auc FROM r""")
def _(spark, d):
    return ml.auc(_predictions(spark, d), "score")


@query("m14_regression_report", """WITH x AS (SELECT "diggCount" AS y, "shareCount" * 10.0 AS p FROM tag_posts) SELECT R6(sqrt(avg((y - p) * (y - p)))) AS rmse, R6(avg(abs(y - p))) AS mae, R6(stddev_pop(y)) AS baseline_rmse,
 R6(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))) AS r2 FROM x""")
def _(spark, d):
    return ml.regression_report(t.tag_posts(spark, d).withColumn("prediction", F.col("shareCount") * 10.0), "diggCount")


@query("m15_linear_contributions")
def _(spark, d):
    out, _model = virality.linear_contributions(_features(spark, d), NUM)
    return virality.importance(virality.contribution_rows(out, NUM))


@query("m15_contributions_add_up", "SELECT count(*) AS posts, true AS add_up FROM posts")
def _(spark, d):
    out = cut_lineage(virality.linear_contributions(_features(spark, d), NUM)[0])
    gap = sum((F.col(f"c_{c}") for c in NUM), F.lit(0.0)) - (F.col("prediction") - out.agg(F.avg("prediction")).scalar())
    return out.agg(F.count("*").alias("posts"), (F.max(F.abs(gap)) < 1e-6).alias("add_up"))


@query("m15_response_curves")
def _(spark, d):
    out, _model = virality.linear_contributions(_features(spark, d), NUM)
    parts = None
    for c in ("author_fans", "video_duration"):
        part = virality.response_curve(out, c)
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("m15_ablation_contributions")
def _(spark, d):
    from pyspark.ml import PipelineModel
    data = _features(spark, d).select("post_id", "viral_target", *NUM)
    vec = VectorAssembler(inputCols=NUM, outputCol="features")
    model = PipelineModel(stages=[vec, virality.regressor().fit(vec.transform(data))])
    out = virality.ablation_contributions(model, data, NUM)
    return virality.contribution_rows(out, NUM)


def _explained(spark, d):
    data = cut_lineage(_vectors(spark, d).select("post_id", "features", "viral_target"))
    model = virality.regressor().fit(data)
    return (*virality.tree_contributions(model, data, NUM), model.transform(data))


@query("m15_tree_contributions")
def _(spark, d):
    return virality.importance(_explained(spark, d)[0])


@query("m15_tree_contributions_add_up", "SELECT count(*) AS posts, true AS add_up FROM posts")
def _(spark, d):
    rows, base, scored = _explained(spark, d)
    total = rows.groupBy("post_id").agg(F.sum("contribution").alias("total"))
    gap = F.col("prediction") - F.lit(base) - F.coalesce("total", F.lit(0.0))
    return scored.join(total, "post_id", "left").agg(F.count("*").alias("posts"), (F.max(F.abs(gap)) < 1e-6).alias("add_up"))


@query("m16_feature_importances")
def _(spark, d):
    model = virality.regressor().fit(_vectors(spark, d))
    return ml.importances(model, NUM, spark, 5)


@query("m17_effect_by_hour")
def _(spark, d):
    data = _vectors(spark, d)
    return virality.effect_by_hour(virality.regressor().fit(data).transform(data))


@query("m18_confusion_of_labels", _PRED + " SELECT label::DOUBLE AS label, prediction::DOUBLE AS prediction, count(*) AS n FROM x GROUP BY 1, 2")
def _(spark, d):
    return aggregates.counts(_predictions(spark, d), "label", "prediction")
