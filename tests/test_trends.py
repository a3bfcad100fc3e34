"""Trend queries on hand-made series, sources, and plan checks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vidtrend import sources
from vidtrend.operators import aggregates, windows
from vidtrend.plans import hashtags, music, topics, trends, virality
from vidtrend.queries import adapters as t

DATA = "/root/testdata/sf0.001"


def posts(spark, rows):
    return spark.createDataFrame([(i, tag, dt.datetime.fromisoformat(ts), likes) for i, (tag, ts, likes) in enumerate(rows)],
                                 "post_id bigint, hashtag_name string, createTimeISO timestamp_ntz, diggCount bigint").withColumns(
        {"text": F.concat(F.lit("t"), "post_id"), "webVideoUrl": F.concat(F.lit("v"), "post_id")})


def test_share_trends_new_key_and_example(spark):
    df = posts(spark, [("a", "2024-01-21 23:59:59", 1), ("a", "2024-01-20 00:00:00", 9), ("b", "2024-01-14 12:00:00", 3), (None, "2024-01-21 01:00:00", 7)])
    rows = hashtags.share_trends(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.hashtag_name, r.diggCount, r.text) == ("a", 9, "t1")
    assert r.this_week_share == pytest.approx(2 / 3) and r.last_week_share == 0 and r.trend_change_pct == 0.67


def test_week_borders(spark):
    df = spark.createDataFrame([("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",), ("2024-12-30 10:00:00",)], "s string")
    from vidtrend.functions.scalars import calendar_fields, week_start
    got = df.select(week_start(F.col("s").cast("timestamp_ntz")).cast("string").alias("w"), calendar_fields(F.col("s").cast("timestamp_ntz"))["iso_year"].alias("y")).collect()
    assert [r.w for r in got] == ["2024-01-01", "2024-01-08", "2024-12-30"] and got[2].y == 2025


def test_robust_z_constant_history(spark):
    df = spark.createDataFrame([("k", i, 1.0) for i in range(5)] + [("k", 5, 4.0), ("one", 0, 1.0)], "k string, d int, v double")
    rows = windows.robust_z_last(df, ["k"], "d", "v").collect()
    assert [(r.k, r.z) for r in rows] == [("k", 3.0)]


def test_kleinberg_matches_plain_recurrence(spark):
    r, d = [1, 1, 1, 8, 9], [20] * 5
    days = [dt.date(2024, 1, 1 + i) for i in range(5)]
    series = spark.createDataFrame([(3, day, x) for day, x in zip(days, r)], "topic int, day date, frequency bigint")
    totals = spark.createDataFrame(list(zip(days, d)), "day date, d bigint")
    p0 = sum(r) / sum(d)
    p1, up = min(2 * p0, 0.9999), math.log(5)
    c0, c1 = 0.0, math.inf
    for x, n in zip(r, d):
        cost = lambda p: -(x * math.log(p) + (n - x) * math.log(1 - p))
        c0, c1 = min(c0, c1) + cost(p0), min(c0 + up, c1) + cost(p1)
    assert trends.kleinberg(series, totals).first().level == int(c1 < c0) == 1


def test_song_surge_needs_full_history(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "musicName string, createTimeISO timestamp_ntz")
    assert music.surges(df).count() == 0
    assert music.surges(df, recent=2, history=5).first().recent_sum == 2


def test_components_and_communities(spark):
    chain = [(f"n{i}", f"n{i + 1}", 5) for i in range(6)] + [("x", "y", 5)]
    pairs = spark.createDataFrame(chain, "a string, b string, n int")
    labels = {r.v: r.label for r in hashtags.components(pairs).collect()}
    assert set(labels.values()) == {"n0", "x"} and labels["n6"] == "n0" and labels["y"] == "x"
    found = {r.v: r.label for r in hashtags.communities(pairs).collect()}
    assert len(found) == 9 and found["x"] == found["y"]
    assert hashtags.unsettled(pairs, hashtags.communities(pairs)).count() == 0


def test_bins_are_right_closed_and_hold_the_extremes(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(11)], "x double, y double")
    rows = aggregates.bin_means(df, "x", "y", bins=5, low=0.0, high=1.0).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 2, 2, 2, 2]


def test_raw_scan_keeps_posts_without_tags_and_bad_times(spark):
    raw = spark.read.schema(sources.RAW_POSTS).json(spark.sparkContext.parallelize([
        '{"id": 1, "createTimeISO": "2024-01-02T03:04:05Z", "hashtags": [{"name": "a", "title": "A"}, {"name": "b"}], "authorMeta": {"nickName": "n"}}',
        '{"id": 2, "createTimeISO": "nope", "hashtags": []}']))
    rows = sources.hashtag_posts(raw).collect()
    assert sorted((r.post_id, r.hashtag_name) for r in rows if r.hashtag_name) == [(1, "a"), (1, "b")]
    assert [r.createTimeISO for r in rows if r.post_id == 2] == [None]


def test_cache_redoes_a_write_that_was_cut_short(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    path = str(tmp_path / "t")
    assert sources.cached(spark, path, build).count() == 3 and sources.cached(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    sources.cached(spark, path, build)
    assert len(calls) == 2


def test_profile_table(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    got = {r.column_name: (r.nulls, r.distinct_values, r.data_type) for r in sources.profile_table(df).collect()}
    assert got == {"a": (0, 1, "int"), "b": (1, 1, "string")}


@pytest.mark.parametrize("build", [
    lambda s: hashtags.weekly_engagement(t.tag_posts(s, DATA)),
    lambda s: hashtags.consistency(t.tag_posts(s, DATA)),
    lambda s: trends.share_change(t.topic_posts(s, DATA)),
])
def test_plans_stay_in_the_jvm_without_nested_loops(spark, build):
    plan = build(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema" in plan


def test_entry_points():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200


def test_viral_score_keeps_posts_without_comments(spark):

    posts = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), 10 * i, 1, 100, 5) for i in range(5)],
                                  "post_id int, createTimeISO timestamp_ntz, diggCount int, shareCount int, playCount int, author_fans int")
    rollup = spark.createDataFrame([(i, 2 + i, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 1 + i), 3, 2) for i in range(4)],
                                   "post_id int, comments int, first_comment timestamp_ntz, last_comment timestamp_ntz, likes_sum int, distinct_users int")
    rows = {r.post_id: r for r in virality.with_trending_flag(virality.viral_score(posts, rollup)).collect()}
    assert len(rows) == 5 and rows[4].viral_score is None and rows[4].is_trending is False


def test_small_broad_topics_keep_their_rows(spark):
    rows = [(i, [float(i // 20), float(i % 3) / 10]) for i in range(43)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    out = topics.two_level(df, "id", "v", k=3, sub_k=2, min_size=2, min_sub=10).collect()
    assert len(out) == 43 and all(r.sub_topic == topics.NOISE for r in out if r.id >= 40)


def test_recent_rows_are_pruned_at_the_scan(spark, tmp_path):

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"t{i % 3}", i) for i in range(60)]
    spark.createDataFrame(rows, "post_id int, createTimeISO timestamp_ntz, hashtag_name string, diggCount int").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    for out in (hashtags.daily_zscore(df), hashtags.daily_interest(df), hashtags.monthly_growth(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(createTimeISO" in plan, plan


def test_model_queries_run_at_their_operators_own_size():
    import ast
    import inspect

    from vidtrend.plans import ml, topics, virality
    from vidtrend.queries import model_queries, text_queries
    sizes = {"maxIter", "maxDepth", "iterations", "trees", "rounds", "size", "text_features"}
    own = {f.__name__ for f in (virality.regressor, virality.classifier, virality.assembler, ml.train_tag_trend,
                                ml.train_weekly_forest, ml.soft_vote, topics.word_vectors)}
    seen = set()
    for module in (model_queries, text_queries):
        for call in ast.walk(ast.parse(inspect.getsource(module))):
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in own:
                seen.add(call.func.attr)
                assert not sizes & {k.arg for k in call.keywords}, ast.unparse(call)
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "ablation_contributions":
                assert ast.unparse(call.args[2]) == "NUM"
    assert seen == own
