"""Cross-validation over time and contributions of tree models against numpy and plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from vidtrend.plans import virality

START = dt.datetime(2024, 1, 1)


def table(spark, n=240):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(n, 3)) * [1, 1000, 0.01] + [0, 5000, 3]
    y = 2 * x[:, 0] + x[:, 1] / 500 - 40 * x[:, 2] + draw.normal(size=n)
    rows = [(i, START + dt.timedelta(hours=int(draw.integers(0, 900))), *map(float, x[i]), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "post_id int, ts timestamp, a double, b double, c double, y double").repartition(3)


def test_time_series_validation_equals_fits_per_fold(spark):
    rows, df = table(spark)
    odd = spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0), (901, START, None, 1.0, 1.0, 1.0)], df.schema)
    got = {r.fold: r for r in virality.time_series_validation(df.unionByName(odd), ["a", "b", "c"], "y", "ts").collect()}
    times = np.array([r[1].timestamp() for r in rows])
    cuts = np.quantile(times, [i / 6 for i in range(1, 6)])
    part = (times[:, None] > cuts[None, :]).sum(1)
    x, y = np.array([[1, *r[2:5]] for r in rows]), np.array([r[5] for r in rows])
    for fold in range(1, 6):
        w = np.linalg.lstsq(x[part < fold], y[part < fold], rcond=None)[0]
        test = part == fold
        gap = y[test] - x[test] @ w
        want = (np.sqrt((gap ** 2).mean()), np.abs(gap).mean(), 1 - (gap ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        assert (got[fold].train_rows, got[fold].test_rows) == ((part < fold).sum(), test.sum())
        assert np.allclose((got[fold].rmse, got[fold].mae, got[fold].r2), want, rtol=1e-6)
    assert np.isclose(got[0].r2, np.mean([got[f].r2 for f in range(1, 6)])) and set(got) == set(range(6))


def test_time_series_validation_of_constant_columns(spark):
    df = spark.createDataFrame([(START + dt.timedelta(days=i), 5.0, float(i)) for i in range(12)], "ts timestamp, a double, y double")
    got = virality.time_series_validation(df, ["a"], "y", "ts", folds=2).collect()
    assert {r.fold for r in got} == {0, 1, 2} and all(r.rmse > 0 for r in got)


def walk(node, x, out):
    """Contributions by recursion over the model's own nodes."""
    if node.numDescendants() == 0:
        return
    split = node.split()
    below = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    out[split.featureIndex()] += below.prediction() - node.prediction()
    walk(below, x, out)


@pytest.mark.parametrize("boosted", [True, False])
def test_tree_contributions_equal_a_walk_over_the_nodes(spark, boosted):
    algorithm = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1) if boosted else RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1)
    rows, df = table(spark, 80)
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = algorithm.fit(data)
    found, base = virality.tree_contributions(model, data, ["a", "b", "c"])
    by = {(r.post_id, r.feature): (r.value, r.contribution) for r in found.collect()}
    predicted = {r.post_id: r.prediction for r in model.transform(data).collect()}
    scale = 1.0 if boosted else 1 / 3
    for row in rows[:25]:
        want = np.zeros(3)
        for tree, weight in zip(model.trees, model.treeWeights):
            one = np.zeros(3)
            walk(tree._call_java("rootNode"), row[2:5], one)
            want += one * weight * scale
        for i, name in enumerate("abc"):
            value, contribution = by.get((row[0], name), (row[2 + i], 0.0))
            assert np.isclose(value, row[2 + i]) and np.isclose(contribution, want[i], atol=1e-9)
    for post, prediction in predicted.items():
        assert np.isclose(base + sum(by.get((post, n), (0, 0.0))[1] for n in "abc"), prediction, atol=1e-9)


def test_contributions_without_a_split(spark):
    df = spark.createDataFrame([(i, 1.0, 3.0) for i in range(10)], "post_id int, a double, y double")
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    found, base = virality.tree_contributions(GBTRegressor(labelCol="y", maxIter=2).fit(data), data, ["a"])
    assert found.count() == 0 and abs(base - 3.0) < 1e-9
    assert found.agg(F.count("contribution")).first()[0] == 0
