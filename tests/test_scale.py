"""The skew-safe building blocks against brute force, with one key holding most rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from vidtrend.operators import joins
from vidtrend.operators.scale import average_rank_pct, exact_quantiles, preceding_rows, row_positions, running_total, top_n


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.choice([1, 1, 1, 5, 7, 9, rng.randrange(1000)]), i)
            for i in range(3000)]
    return pd.DataFrame(rows, columns=["k", "v", "id"]), spark.createDataFrame(rows, "k string, v int, id bigint").cache()


def test_grouped_quantiles_match_linear_interpolation(skewed):
    pdf, df = skewed
    got = {r.k: (r.q0250, r.q0500, r.q0990) for r in exact_quantiles(df, "v", [0.25, 0.5, 0.99], ["k"]).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(g.v, [25, 50, 99]))


def test_global_quantiles_and_single_value(spark, skewed):
    pdf, df = skewed
    row = exact_quantiles(df, "v", [0.1, 0.75]).first()
    assert tuple(row) == pytest.approx(np.percentile(pdf.v, [10, 75]))
    one = spark.createDataFrame([(4.0,), (None,)], "v double")
    assert exact_quantiles(one, "v", [0.5]).first()[0] == 4.0


def test_running_total_is_exact_for_any_bucket_count(skewed):
    pdf, df = skewed
    counts = df.groupBy("k", "v").count()
    for buckets in (4, 64):
        got = {(r.k, r.v): r.before for r in running_total(counts, ["v"], "count", ["k"], buckets=buckets).collect()}
        for (k, v), before in got.items():
            assert before == ((pdf.k == k) & (pdf.v < v)).sum()


def test_average_rank_pct(skewed):
    pdf, df = skewed
    want = dict(zip(pdf.id, pdf.v.rank(pct=True)))
    for r in average_rank_pct(df, "v").collect():
        assert r.percentile == pytest.approx(want[r.id])


def test_row_positions_are_a_permutation_in_order(skewed):
    _, df = skewed
    rows = row_positions(df, "v", "id", ["k"]).toPandas()
    for _, g in rows.groupby("k"):
        assert sorted(g.position) == list(range(len(g)))
        assert g.sort_values("position").v.is_monotonic_increasing


def test_preceding_rows_across_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in range(57)] + [("b", i) for i in range(3)], "k string, t int")
    out = preceding_rows(df, "t", "t", ["k"], ["t"], 5, block=10).collect()
    assert len(out) == 60
    for r in out:
        assert [h.t for h in r.history] == list(range(max(0, r.t - 5), r.t))


def test_top_n_limits_each_group_before_the_shuffle(skewed):
    _, df = skewed
    from pyspark.sql import functions as F
    out = top_n(df, ["k"], [F.desc("v"), F.col("id")], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.k for r in out.collect()).most_common(1)[0][1] == 2


@pytest.mark.parametrize("heavy", [2, 4, 1000])
def test_pairs_with_large_groups_match_brute_force(spark, heavy):
    rng = random.Random(5)
    groups = {g: set(rng.sample("abcdefghij", rng.choice([2, 3, 6]))) for g in range(40)}
    groups[99] = set("abcdefghij")
    rows = [(g, x) for g, items in groups.items() for x in items for _ in range(2)] + [(7, None)]
    df = spark.createDataFrame(rows, "g int, x string")
    want = Counter(p for items in groups.values() for p in itertools.combinations(sorted(items), 2))
    got = {(r.a, r.b): r.n for r in joins.pairs_in_group(df, "g", "x", 5, heavy).collect()}
    assert got == {p: n for p, n in want.items() if n >= 5}


def test_left_join_with_a_hot_right_side(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, a string")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "k int, b int")
    out = joins.left_join_hot_right(left, right, "k").collect()
    assert Counter(r.k for r in out) == {1: 50, 2: 1, 3: 1}
    assert [r.b for r in out if r.k == 3] == [None]
