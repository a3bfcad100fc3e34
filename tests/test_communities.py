"""Modularity communities on planted graphs, measured again by plain Python."""

import random
from collections import defaultdict

from vidtrend.plans import hashtags


def measured(pairs, label):
    total, inside, degree = 0, 0, defaultdict(int)
    for a, b, n in pairs:
        total += 2 * n
        inside += 2 * n * (label[a] == label[b])
        degree[label[a]] += n
        degree[label[b]] += n
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def planted(groups, size, seed):
    draw = random.Random(seed)
    names = [f"t{g}_{i}" for g in range(groups) for i in range(size)]
    out = []
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            same = a.split("_")[0] == b.split("_")[0]
            if draw.random() < (0.7 if same else 0.03):
                out.append((a, b, draw.randrange(5, 9) if same else 1))
    return out


def test_planted_communities_come_out(spark):
    pairs = planted(4, 8, 4)
    got = hashtags.modularity_communities(spark.createDataFrame(pairs, "a string, b string, n bigint")).collect()
    label = {r.v: r.label for r in got}
    assert set(label) == {v for a, b, _ in pairs for v in (a, b)} and set(label.values()) <= set(label)
    assert abs(got[0].modularity - measured(pairs, label)) < 1e-9
    assert got[0].modularity >= measured(pairs, {v: v.split("_")[0] for v in label}) - 1e-9
    assert len({(v.split("_")[0], own) for v, own in label.items()}) == 4
    for v in label:  # no vertex gains by leaving for a community of its own level
        for other in set(label.values()):
            assert measured(pairs, {**label, v: other}) <= got[0].modularity + 1e-3


def test_ring_and_nothing(spark):
    ring = [(f"v{i}", f"v{(i + 1) % 8}", 1) for i in range(8)]
    got = hashtags.modularity_communities(spark.createDataFrame(ring, "a string, b string, n bigint")).collect()
    assert len(got) == 8 and abs(got[0].modularity - measured(ring, {r.v: r.label for r in got})) < 1e-9 and got[0].modularity > 0.3
    assert hashtags.modularity_communities(spark.createDataFrame([], "a string, b string, n bigint")).count() == 0
