"""Hashtag trends, growth, consistency, co-occurrence and communities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import fixed
from vidtrend.functions.scalars import LIKES_SHARES_COMMENTS, METRICS, SOCIAL, banded, engagement, \
    month_start, percent_text, relative_change, three_way, week_start
from vidtrend.operators import aggregates, windows
from vidtrend.operators.joins import pairs_in_group
from vidtrend.operators.scale import best, calendar_broadcast, exact_quantiles, scalar, \
    with_quantiles
from vidtrend.session import cut_lineage, written

TAG = "hashtag_name"
EXAMPLE = {"text": "text", "webVideoUrl": "webVideoUrl", "diggCount": "diggCount"}


def normalised(df: DataFrame, tag: str = TAG) -> DataFrame:
    return df.withColumn(tag, F.lower(F.trim(F.col(tag))))


def rounded(col: Column, digits: int = 2) -> Column:
    """Half-even rounding of the scaled value."""
    scale = F.lit(10.0 ** digits)
    return F.rint(col * scale) / scale


def newest_day(df: DataFrame, ts: str) -> Column:
    """Date of the newest row as a literal: one job over one column, so that later scans can prune by it."""
    return F.lit(df.agg(F.max(F.col(ts))).first()[0]).cast("date")


def since(df: DataFrame, ts: str, newest: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; the bound is on the raw column and reaches the file scan."""
    return df.filter(F.col(ts) >= F.date_add(newest, 1 - days))


def _weeks(df: DataFrame, ts: str, weeks: int, as_of=None) -> DataFrame:
    """Rows of the last ``weeks`` seven-day windows with their window number (0 = newest)."""
    day = F.to_date(ts)
    newest = newest_day(df, ts) if as_of is None else F.lit(as_of).cast("date")
    recent = since(df, ts, newest, 7 * weeks)
    if as_of is not None:
        recent = recent.filter(F.col(ts) < F.date_add(newest, 1))
    return recent.withColumns(
        {"post_date": day, "week_no": F.floor(F.datediff(newest, day) / 7).cast("int")})


def share_trends(df: DataFrame, key: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                 weeks: int = 3, top: int | None = 20, order: Sequence[str] = ("diggCount", "post_id"),
                 examples: Mapping[str, str] = EXAMPLE, labels: bool = True, as_of=None) -> DataFrame:
    """Share of posts per key in each seven-day window, its change, label and an example row.

    One scan, one (post, key, week) distinct, one conditional count per key.
    """
    names = ["this_week_share", "last_week_share", "week_before_last_share"][:weeks]
    recent = _weeks(df, ts, weeks, as_of)
    totals = recent.select(post, "week_no").distinct().agg(
        F.struct(*[F.count_if(F.col("week_no") == w).alias(f"w{w}") for w in range(weeks)]).alias("t")
    ).scalar()
    seen = recent.filter(F.col(key).isNotNull()).select(post, key, "week_no").distinct()
    shares = seen.groupBy(key).agg(*[F.count_if(F.col("week_no") == w).alias(f"_n{w}") for w in range(weeks)])
    shares = shares.withColumn("_t", totals).select(key, *[
        F.coalesce(F.try_divide(F.col(f"_n{w}").cast("double"), F.col(f"_t.w{w}")), F.lit(0.0)).alias(n)
        for w, n in enumerate(names)])
    shares = shares.withColumn("trend_change_pct", rounded(relative_change(names[0], names[1])))
    if weeks > 2:
        shares = shares.withColumn("last_week_trend_pct", rounded(relative_change(names[1], names[2])))
    if labels:
        # one row per key; read again for the quantiles, so the posts are not scanned again
        shares = cut_lineage(shares)
        shares = with_quantiles(shares, shares, "trend_change_pct", [0.25, 0.75])
        q1, q3 = F.col("_q.p0"), F.col("_q.p1")
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        shares = shares.withColumn("trend_label", three_way("trend_change_pct", low, high, fixed.TREND_LABELS))
        if weeks > 2:
            shares = shares.withColumn(
                "last_week_trend_label", three_way("last_week_trend_pct", low, high, fixed.TREND_LABELS))
    shares = shares.filter(F.col(names[0]) > 0).drop("_q")
    if top:
        shares = shares.orderBy(F.desc(names[0]), key).limit(top)
    example = example_rows(recent.filter(F.col("week_no") == 0), key, order, {**examples, "post_date": "post_date"})
    return shares.join(example, key)


def example_rows(df: DataFrame, key: str, order: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Per key, each field's first non-null value in descending ``order``."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[best(col, *order).alias(name) for name, col in fields.items()])


def weekly_engagement(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                      metrics: Sequence[str] = METRICS, min_posts: int = 1, smooth: int = 3) -> DataFrame:
    """Engagement, posts, peak-normalised engagement and post share per tag and ISO week."""
    base = df.na.drop(subset=[tag, ts, post, *metrics]).withColumns(
        {"date": week_start(ts), "engagement": engagement(metrics)})
    # summing per (tag, week, post) first gives the distinct posts without a second shuffle of rows
    per_post = base.groupBy(tag, "date", post).agg(F.sum("engagement").alias("engagement"))
    stats = per_post.groupBy(tag, "date").agg(
        F.sum("engagement").alias("weekly_engagement"), F.count("*").alias("post_count"))
    totals = (per_post.select("date", post).distinct()
              .groupBy("date").agg(F.count("*").alias("total_weekly_posts")))
    stats = stats.filter(F.col("post_count") >= min_posts).join(calendar_broadcast(totals), "date")
    peaks = calendar_broadcast(stats.groupBy("date").agg(F.max("weekly_engagement").alias("_peak")))
    stats = windows.trailing_mean(stats, [tag], "date", "post_count", smooth, "smoothed_post_count")
    return stats.join(peaks, "date").select(
        tag, "date", F.extract(F.lit("YEAROFWEEK"), "date").alias("year"), F.weekofyear("date").alias("week"),
        "weekly_engagement", "post_count", "total_weekly_posts", "smoothed_post_count",
        (F.col("weekly_engagement") / F.col("_peak")).alias("normalized_weekly_engagement"),
        (F.col("post_count") / F.col("total_weekly_posts")).alias("post_share_of_week"))


def mention_trends(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                   limit: float = 0.5, top: int = 20) -> DataFrame:
    """Mentions per seven-day window, change labels at +-limit, best-liked example."""
    recent = _weeks(df.filter(F.col(tag).isNotNull()), ts, 3)
    names = ["this_week_mentions", "last_week_mentions", "week_before_last_mentions"]
    seen = recent.select(post, tag, "post_date", "week_no").distinct()
    table = seen.groupBy(tag).agg(*[F.count_if(F.col("week_no") == w).alias(n) for w, n in enumerate(names)])
    table = table.withColumns({
        "trend_change_pct": rounded(relative_change(names[0], names[1])),
        "last_week_trend_pct": rounded(relative_change(names[1], names[2]))})
    table = table.withColumns({
        "trend_label": three_way("trend_change_pct", -limit, limit, fixed.TREND_LABELS),
        "last_week_trend_label": three_way("last_week_trend_pct", -limit, limit, fixed.TREND_LABELS)})
    table = table.filter(F.col(names[0]) > 0).orderBy(F.desc(names[0]), tag).limit(top)
    example = example_rows(recent.filter(F.col("week_no") == 0), tag, ("diggCount", post),
                           {**EXAMPLE, "post_date": "post_date"})
    return table.join(example, tag)


def daily_interest(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                   days: int = 7) -> DataFrame:
    """Daily posts of a tag as a percentage of its best day in the window."""
    newest = newest_day(df, ts)
    base = since(df, ts, newest, days).withColumn("post_date", F.to_date(ts))
    daily = windows.daily_counts(base, tag, "post_date", post)
    out = aggregates.peak_normalised(daily, [tag], "n", "interest", 100.0)
    return out.withColumn("interest", rounded(F.col("interest"), 1))


def monthly_growth(df: DataFrame, tag: str = TAG, ts: str = "createTimeISO", minimum: int = 5,
                   top: int | None = 10) -> DataFrame:
    """Tags growing between the last two months seen, both with at least ``minimum`` rows."""
    newest = month_start(newest_day(df, ts))
    base = df.filter(F.col(tag).isNotNull() & (F.col(ts) >= F.add_months(newest, -1)))
    table = base.groupBy(tag).agg(
        F.count_if(month_start(ts) < newest).alias("prev_month"),
        F.count_if(month_start(ts) == newest).alias("last_month"))
    table = table.filter((F.col("prev_month") >= minimum) & (F.col("last_month") >= minimum)
                         & (F.col("last_month") > F.col("prev_month")))
    table = table.withColumn("growth_rate", (F.col("last_month") - F.col("prev_month")) / F.col("prev_month"))
    return table.orderBy(F.desc("growth_rate"), tag).limit(top) if top else table


def daily_zscore(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                 days: int = 28) -> DataFrame:
    """z of the newest day against the tag's observed days in the window."""
    newest = newest_day(df, ts)
    base = since(df, ts, newest, days).withColumn("post_date", F.to_date(ts))
    return windows.classical_z_last(windows.daily_counts(base, tag, "post_date", post), [tag],
                                    "post_date", "n", newest)


def share_of_voice(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                   limit: float = 0.1) -> DataFrame:
    """Share of all mentions this week and last week and its change label."""
    recent = _weeks(df.filter(F.col(tag).isNotNull()), ts, 2)
    seen = recent.select(post, tag, "week_no").distinct()
    per_tag = seen.groupBy(tag).agg(F.count_if(F.col("week_no") == 0).alias("n0"),
                                    F.count_if(F.col("week_no") == 1).alias("n1"))
    sums = per_tag.agg(F.struct(F.sum("n0").alias("s0"), F.sum("n1").alias("s1")).alias("s")).scalar()
    table = per_tag.withColumn("_s", sums).select(
        tag, F.try_divide(F.col("n0").cast("double"), F.col("_s.s0")).alias("this_week_share"),
        F.try_divide(F.col("n1").cast("double"), F.col("_s.s1")).alias("last_week_share"))
    table = table.withColumn("share_change", relative_change("this_week_share", "last_week_share"))
    return table.withColumn("trend_label", three_way("share_change", -limit, limit, fixed.TREND_LABELS))


def leaderboard(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                author: str = "author_nickName", metrics: Sequence[str] = LIKES_SHARES_COMMENTS,
                minimum: int = 50, split: bool = True) -> DataFrame:
    """Average-engagement change between the last two weeks, post count, rank and top creator."""
    base = df
    if split:
        base = base.withColumn(tag, F.explode(F.split(F.coalesce(F.col(tag), F.lit("")), ",")))
    base = base.withColumns({tag: F.lower(F.trim(F.col(tag))), "week": week_start(ts),
                             "engagement": engagement(metrics)}).filter(F.col(tag) != "")
    newest = scalar(base, F.max("week"))
    before = scalar(base.filter(F.col("week") < newest), F.max("week"))
    in_week = lambda w: F.when(F.col("week") == w, F.col("engagement"))
    stats = base.groupBy(tag).agg(F.count(post).alias("post_count"), F.avg(in_week(newest)).alias("avg_last"),
                                  F.avg(in_week(before)).alias("avg_prev"))
    stats = stats.filter((F.col("post_count") >= minimum) & F.col("avg_last").isNotNull()
                         & F.col("avg_prev").isNotNull())
    per_author = base.groupBy(tag, author).agg(F.sum("engagement").alias("total"))
    creators = per_author.groupBy(tag).agg(F.max_by(author, F.struct("total", author)).alias("top_creator"))
    table = stats.join(creators, tag).withColumn(
        "engagement_change", (F.col("avg_last") - F.col("avg_prev")) / F.col("avg_prev") * 100)
    return table.withColumns({
        "trendline": F.when(F.col("engagement_change") > 0, "📈").otherwise("📉"),
        "avg_engagement": percent_text("engagement_change")})


def ranked_leaderboard(table: DataFrame, tag: str = TAG, k: int = 10) -> DataFrame:
    """First k rows by post count with their rank."""
    from pyspark.sql import Window
    head = table.orderBy(F.desc("post_count"), tag).limit(k)
    return head.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("post_count"), tag)))


def consistency(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                metrics: Sequence[str] = SOCIAL, min_posts: int = 20) -> DataFrame:
    """Mean weekly engagement x log posts / (1 + deviation), scaled to 0..1."""
    base = df.filter(F.col(tag).isNotNull()).withColumns(
        {"week": week_start(ts), "engagement": engagement(metrics)})
    per_post = base.groupBy(tag, "week", post).agg(F.sum("engagement").alias("engagement"))
    weekly = per_post.groupBy(tag, "week").agg(F.sum("engagement").alias("weekly"))
    peaks = calendar_broadcast(weekly.groupBy("week").agg(F.max("weekly").alias("_peak")))
    per_tag = weekly.join(peaks, "week").groupBy(tag).agg(
        F.avg("weekly").alias("mean_weekly_engagement"), F.stddev_samp("weekly").alias("std_weekly_engagement"),
        F.avg(F.col("weekly") / F.col("_peak")).alias("mean_normalized_weekly_engagement"),
        F.count("*").alias("weeks_active"))
    posts = per_post.select(tag, post).distinct().groupBy(tag).agg(F.count("*").alias("total_posts"))
    table = per_tag.join(posts.filter(F.col("total_posts") >= min_posts), tag)
    table = table.withColumn("score", F.col("mean_weekly_engagement") * F.log1p("total_posts")
                             / (1 + F.coalesce("std_weekly_engagement", F.lit(0.0))))
    return windows.min_max(table, "score", "normalized_score")


def relative_engagement(df: DataFrame, tag: str = TAG, post: str = "post_id", ts: str = "createTimeISO",
                        metrics: Sequence[str] = SOCIAL) -> DataFrame:
    """Posts, mean engagement, and mean peak-normalised engagement by week, month and year."""
    base = df.filter(F.col(tag).isNotNull()).withColumn("engagement", engagement(metrics))
    # (tag, day) partial sums feed all three period lengths
    daily = base.groupBy(tag, F.to_date(ts).alias("day")).agg(
        F.sum("engagement").alias("s"), F.count("*").alias("n"))
    out = base.select(tag, post).distinct().groupBy(tag).agg(F.count("*").alias("total_posts"))
    out = out.join(daily.groupBy(tag).agg((F.sum("s") / F.sum("n")).alias("average_engagement")), tag)
    for unit in ("week", "month", "year"):
        per = daily.groupBy(tag, F.date_trunc(unit, "day").alias("p")).agg((F.sum("s") / F.sum("n")).alias("m"))
        peak = calendar_broadcast(per.groupBy("p").agg(F.max("m").alias("_peak")))
        rel = per.join(peak, "p").groupBy(tag).agg(
            F.avg(F.try_divide("m", "_peak")).alias(f"relative_engagement_{unit}"))
        out = out.join(rel, tag, "left")
    return out


def cooccurrence(df: DataFrame, tag: str = TAG, post: str = "post_id", minimum: int = 5) -> DataFrame:
    return pairs_in_group(df, post, tag, minimum)


def connected(pairs: DataFrame, min_degree: int = 3) -> DataFrame:
    """Pairs whose two ends both have more than ``min_degree`` partners."""
    degree = (pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v")
              .agg(F.count("*").alias("d")).filter(F.col("d") > min_degree).select("v"))
    return pairs.join(degree.withColumnRenamed("v", "a"), "a", "left_semi").join(
        degree.withColumnRenamed("v", "b"), "b", "left_semi")


def components(pairs: DataFrame) -> DataFrame:
    """Connected components by spreading the smallest label, two hops a round, until stable."""
    edges = written(_both_ways(pairs.select("a", "b").distinct()))
    labels = edges.groupBy("a").agg(F.min("b").alias("_low")).select(
        F.col("a").alias("v"), F.least("a", "_low").alias("label"))
    labels = written(labels)
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("label").alias("_near"))
        hop = labels.join(near, labels.v == near.a).select("v", F.least("label", "_near").alias("_new"),
                                                           F.col("label").alias("_old"))
        # also take over the label of one's label (halves the number of rounds on chains)
        jump = hop.select(F.col("v").alias("_new"), F.col("_new").alias("_jump"))
        fresh = written(hop.join(jump, "_new", "left").select(
            "v", F.least(F.col("_new"), F.coalesce("_jump", "_new")).alias("label"), "_old"))
        changed = fresh.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = fresh.drop("_old")
        if not changed:
            return labels


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each edge in both directions, from one computation of the pairs."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(ends).alias("e"), *rest).select("e.a", "e.b", *rest)


def communities(pairs: DataFrame, weight: str = "n") -> DataFrame:
    """Weighted label propagation until no vertex has a label that weighs more among its partners.

    A vertex changes only for a strictly heavier label (of equal ones the smallest), and in each
    round only vertices of one half of a hash may change, another half in every round. So partners
    do not swap labels for ever, and every change made alone adds weight inside communities.
    """
    edges = cut_lineage(_both_ways(pairs.select("a", "b", weight)))
    labels = cut_lineage(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    turn = 0
    while True:
        votes = edges.join(labels, edges.b == labels.v).groupBy(F.col("a").alias("v"), "label").agg(F.sum(weight).alias("_w"))
        best_label = votes.groupBy("v").agg(F.min_by(F.struct("label", "_w"), F.struct(-F.col("_w"), "label")).alias("_best"))
        own = votes.withColumnRenamed("label", "_label").withColumnRenamed("_w", "_own")
        known = (labels.join(best_label, "v").join(own, (own["v"] == labels["v"]) & (own["_label"] == labels["label"]), "left")
                 .select(labels["v"], "label", "_best", F.coalesce("_own", F.lit(0)).alias("_own")))
        wants = F.col("_best._w") > F.col("_own")
        now = F.pmod(F.xxhash64("v", F.lit(turn // 2)), F.lit(2)) == turn % 2
        moved = cut_lineage(known.select("v", F.when(wants & now, F.col("_best.label")).otherwise(F.col("label")).alias("label"),
                                         wants.alias("_wants")))
        labels, turn = moved.drop("_wants"), turn + 1
        if moved.filter("_wants").isEmpty():
            return labels


#: Modularity that a step has to add to be taken; it is at most 1, so steps are bounded in number.
LEAST_GAIN = 1e-9


def modularity(edges: DataFrame, labels: DataFrame) -> Column:
    """Scalar: weight share inside communities minus its expectation, of directed ``a, b, w`` edges."""
    named = lambda end: labels.select(F.col("v").alias(end), F.col("label").alias(f"l{end}"))
    per = edges.join(named("a"), "a").join(named("b"), "b").groupBy(F.col("la").alias("label")).agg(
        F.sum("w").alias("_all"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0)).alias("_in"))
    total = F.sum("_all")
    return scalar(per, F.sum("_in") / total - F.sum(F.col("_all").cast("double") * F.col("_all")) / (total.cast("double") * total))


def _moves(edges: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """``v, label, gain``: the neighbouring community that raises the modularity most, for vertices that have one."""
    degree = edges.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"))
    own = labels.join(degree, "v")
    size = own.groupBy("label").agg(F.sum("k").alias("tot"))
    near = edges.filter("a <> b").join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v"), "label").agg(F.sum("w").alias("w"))
    # the own community is a candidate too, also without a neighbour in it
    options = near.unionByName(labels.select("v", "label", F.lit(0).cast("bigint").alias("w"))).groupBy("v", "label").agg(F.sum("w").alias("w"))
    options = options.join(own.select("v", "k", F.col("label").alias("own")), "v").join(size, "label")
    stays = F.col("label") == F.col("own")
    score = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0)) / F.lit(total)
    best = options.withColumn("score", score).groupBy("v").agg(
        F.max(F.when(stays, F.col("score"))).alias("_own"), F.max("score").alias("_most"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"))
    gain = 2 * (F.col("_most") - F.col("_own")) / F.lit(total)
    return best.select("v", "label", gain.alias("gain")).filter(F.col("gain") > LEAST_GAIN)


def _settle(edges: DataFrame) -> tuple[DataFrame, float, bool]:
    """Labels after moves of single vertices, their modularity, and whether any vertex moved.

    All moves of one half of the vertices are tried together and kept if the modularity rises; if neither
    half does, the single best move is made, which always does. So every step raises it, and the end
    is a partition that no single move improves.
    """
    total = float(edges.agg(F.sum("w")).first()[0])
    labels = cut_lineage(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    known = edges.select(modularity(edges, labels).alias("q")).first()["q"]
    moved = False
    while True:
        moves = cut_lineage(_moves(edges, labels, total))
        if moves.isEmpty():
            return labels, known, moved
        half = F.pmod(F.xxhash64("v"), F.lit(2))
        for chosen in (moves.filter(half == 0), moves.filter(half == 1), moves.orderBy(F.desc("gain"), "v").limit(1)):
            step = chosen.select("v", F.col("label").alias("_to"))
            tried = cut_lineage(labels.join(step, "v", "left").select("v", F.coalesce("_to", "label").alias("label")))
            now = edges.select(modularity(edges, tried).alias("q")).first()["q"]
            if now > known + LEAST_GAIN / 2:
                labels, known, moved = tried, now, True
                break
        else:
            return labels, known, moved


def modularity_communities(pairs: DataFrame, weight: str = "n") -> DataFrame:
    """``v, label, modularity``: communities by modularity gain and contraction, level by level.

    Vertices move to the neighbouring community that raises the modularity most; communities then become
    the vertices of a smaller graph (inner weight as a loop), until a level moves nothing. A community
    is named by one of its vertices. Vertices without a partner are not in the pairs; no pairs give no rows.
    """
    edges = cut_lineage(_both_ways(pairs.select("a", "b", F.col(weight).cast("bigint").alias("w"))))
    labels = cut_lineage(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    if labels.isEmpty():
        return labels.withColumn("modularity", F.lit(0.0))
    while True:
        found, reached, moved = _settle(edges)
        if not moved:
            return labels.withColumn("modularity", F.lit(float(reached)))
        labels = cut_lineage(labels.join(found.select(F.col("v").alias("label"), F.col("label").alias("_up")), "label").select("v", F.col("_up").alias("label")))
        ends = lambda end: found.select(F.col("v").alias(end), F.col("label").alias(f"_{end}"))  # noqa: E731, B023
        edges = cut_lineage(edges.join(ends("a"), "a").join(ends("b"), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))


def unsettled(pairs: DataFrame, labels: DataFrame, weight: str = "n") -> DataFrame:
    """Vertices for whose partners another label weighs more than their own."""
    edges = _both_ways(pairs.select("a", "b", weight))
    votes = edges.join(labels, edges.b == labels.v).groupBy(F.col("a").alias("v"), "label").agg(F.sum(weight).alias("w"))
    most = votes.groupBy("v").agg(F.max("w").alias("most"))
    own = labels.join(votes, ["v", "label"], "left").select("v", F.coalesce("w", F.lit(0)).alias("own"))
    return own.join(most, "v").filter("most > own").select("v")


def popularity(df: DataFrame, tag: str = TAG, post: str = "post_id",
               probs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99)) -> DataFrame:
    """Quantiles of distinct posts per tag."""
    counts = aggregates.distinct_counts(df, [tag], post, "n")
    return exact_quantiles(counts, "n", probs)


def popularity_bands(df: DataFrame, tag: str = TAG, post: str = "post_id") -> DataFrame:
    counts = aggregates.distinct_counts(df, [tag], post, "n")
    return counts.groupBy(banded("n", [1000, 10_000, 100_000, 1_000_000],
                                 ["<1k", "1k-10k", "10k-100k", "100k-1M", "1M+"]).alias("band")
                          ).agg(F.count("*").alias("tags"))


def popular_tag_flags(df: DataFrame, tag: str = TAG, post: str = "post_id", prob: float = 0.8) -> DataFrame:
    """Per post: does it carry a tag whose row count reaches the quantile?"""
    from vidtrend.operators.filters import quantile_keys
    popular = quantile_keys(df, tag, prob).select(tag, F.lit(1).alias("_hit"))
    return df.select(post, tag).join(popular, tag, "left").groupBy(post).agg(
        (F.max(F.coalesce("_hit", F.lit(0))) == 1).alias("has_popular_tag"))


def top_by_period(df: DataFrame, tag: str = TAG, ts: str = "createTimeISO", k: int = 10,
                  days: Mapping[str, int] = {"weekly": 7, "monthly": 30}) -> DataFrame:  # noqa: B006
    """Top tags of each window with the sorted list of windows they lead in."""
    newest = newest_day(df, ts)
    parts = None
    for name, span in days.items():
        recent = since(df, ts, newest, span).filter(F.col(tag).isNotNull())
        part = aggregates.top_values(recent, tag, k).withColumn("source", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return aggregates.tag_union(parts, tag, "source")

