"""Density clusters against plain Python on planted groups of unequal density."""

import math
import random
from collections import defaultdict

import pytest

from vidtrend.plans import density


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def planted(seed):
    draw = random.Random(seed)
    rows, truth = [], {}
    for name, (n, spread) in enumerate([(60, 0.02), (50, 0.06), (40, 0.12)]):
        centre = [0.0] * 8
        centre[name * 2] = 1.0
        for _ in range(n):
            truth[len(rows)] = name
            rows.append([x + draw.gauss(0, spread) for x in centre])
    for _ in range(30):
        truth[len(rows)] = None
        rows.append([draw.gauss(0, 1) for _ in range(8)])
    return [(i, v) for i, v in enumerate(rows)], truth


def by_hand(rows, min_points, min_size, reach, levels):
    """All levels by flooding, then the better of a cluster and its parts, from the top."""
    u = {i: unit(v) for i, v in rows}
    d = {i: {j: math.dist(u[i], u[j]) for j in u} for i in u}
    core = {i: sorted(d[i].values())[min_points - 1] if len(u) >= min_points else math.inf for i in u}
    cuts = [reach * 50.0 ** (i / (levels - 1) - 1) for i in range(levels)]

    def parts(ids, r):
        left, out = {i for i in ids if core[i] <= r}, []
        while left:
            seen = [left.pop()]
            for i in seen:
                near = {j for j in left if d[i][j] <= r}
                left -= near
                seen += near
            if len(seen) >= min_size:
                out.append(frozenset(seen))
        return out

    def best(ids, level):
        """Stability and clusters of the cluster that has its highest component ``ids`` at ``level``."""
        gained, now, at = 0.0, ids, level
        while True:
            gained += len(now) * (1 / cuts[at] - 1 / cuts[min(at + 1, levels - 1)])
            below = parts(now, cuts[at - 1]) if at else []
            if len(below) != 1:
                break
            now, at = below[0], at - 1
        inner = [best(c, at - 1) for c in below]
        total = sum(v for v, _ in inner)
        return (gained, [ids]) if gained >= total else (total, [c for _, cs in inner for c in cs])

    return core, {c for top in parts(u, cuts[-1]) for c in best(top, levels - 1)[1]}


def clusters(got):
    out = defaultdict(set)
    for r in got:
        if r.cluster is not None:
            out[r.cluster].add(r.id)
    assert all(min(ids) == name for name, ids in out.items())
    return {frozenset(ids) for ids in out.values()}


def test_planted_clusters_and_noise(spark):
    rows, truth = planted(3)
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = density.density_clusters(df, "id", "v", 5, 15, 0.6, 8).collect()
    core, want = by_hand(rows, 5, 15, 0.6, 8)
    assert clusters(got) == want and len(want) == 3
    assert {truth[r.id] for r in got if r.cluster is not None} == {0, 1, 2}
    assert all(len({truth[i] for i in c}) == 1 for c in want)
    assert all((r.cluster is None) == (r.strength == 0) and 0 <= r.strength <= 1 for r in got)
    far = {r.id: r.core for r in density.core_distances(df, "id", "v", 5, 0.6).collect()}
    assert set(far) == {i for i, c in core.items() if c < 0.6}
    assert all(abs(far[i] - core[i]) < 1e-7 for i in far)


def test_clusters_inside_a_cluster(spark):
    draw = random.Random(8)
    rows = [(i, [1.0, 0.3 * (i % 2), 0.0] + [draw.gauss(0, 0.01) for _ in range(3)]) for i in range(60)]
    rows += [(60 + i, [1.0, draw.random() * 0.3, 0.0] + [draw.gauss(0, 0.05) for _ in range(3)]) for i in range(25)]
    rows += [(100 + i, [0.0, 0.0, 1.0] + [draw.gauss(0, 0.03) for _ in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = density.density_clusters(df, "id", "v", 4, 10, 0.9, 8).collect()
    assert clusters(got) == by_hand(rows, 4, 10, 0.9, 8)[1] and len(clusters(got)) == 3


def test_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(25)] + [(30, None), (31, []), (32, [0.0, 0.0]), (33, [float("nan"), 1.0]), (None, [1.0, 0.0]), (34, [None, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = density.density_clusters(df, "id", "v", 5, 20, 0.5, 4).collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.cluster == 0} == set(range(25)) and {r.cluster for r in got} == {0, None}
    assert density.density_clusters(df.limit(0), "id", "v").count() == 0
    with pytest.raises(ValueError):
        density.density_clusters(df, "id", "v", reach=2.5)


def test_spanning_forest_is_minimal(spark):
    draw = random.Random(2)
    edges = [(a, b, float(draw.randrange(12))) for a in range(40) for b in range(a + 1, 40) if draw.random() < 0.15 and (a < 25) == (b < 25)]
    got = {(r.a, r.b, r.w) for r in density.spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint, w double")).collect()}
    root = {v: v for v in range(40)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert got == want


def blocks(seed, left, right, size=6):
    import numpy as np
    import pyarrow as pa
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(left + right, size)) + (np.arange(left + right) % 3 == 0)[:, None] * 3
    v[5] = v[-3]  # a copy, and ties by id
    v /= np.sqrt((v * v).sum(1))[:, None]
    core = draw.random(left + right) * 0.4

    def side(at, end):
        held = pa.ListArray.from_arrays(np.arange(0, (end - at) * size + 1, size, dtype=np.int32), v[at:end].ravel())
        return pa.StructArray.from_arrays([pa.array(np.arange(at, end)), held, pa.array(core[at:end])], names=["id", "u", "extra"])
    return v, core, {"key": -1, "lo": 0, "hi": 1 if right else 0, "left": side(0, left), "right": side(left, left + right) if right else side(0, left)}


@pytest.mark.parametrize("left,right", [(150, 90), (120, 0)])
def test_pairs_of_blocks_against_all_pairs(monkeypatch, left, right):
    import numpy as np

    from vidtrend.operators import similarity as S
    monkeypatch.setattr(S, "TILE", (32, 48))
    monkeypatch.setattr(S, "GATHERED", 300)
    monkeypatch.setattr(S, "FIRST", 20)
    v, core, row = blocks(6, left, right)
    monkeypatch.setattr(S, "_rows", lambda _: [row])
    cosine = v @ v.T
    pairs = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cosine[i, j] > 0.2 and (not right or i < left <= j)]
    d = {p: math.sqrt(max(0.0, 2 - 2 * cosine[p])) for p in pairs}
    near = defaultdict(list)
    for i, j in pairs:
        near[i].append((round(d[i, j], 9), j))
        near[j].append((round(d[i, j], 9), i))
    got = defaultdict(list)
    for batch in S._nearest(0.2, 4)(None):
        for p, q, far in zip(*[c.to_pylist() for c in batch.columns]):
            got[p].append((round(far, 9), q))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x)[:4] for p, x in near.items()}
    w = {(i, j): max(d[i, j], core[i], core[j]) for i, j in pairs}
    root, want = list(range(len(v))), []
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in sorted(pairs, key=w.get):
        if find(i) != find(j):
            root[find(i)] = find(j)
            want.append(w[i, j])
    forest = [x for batch in S._forest(0.2)(None) for x in batch["w"].to_pylist()]
    assert np.allclose(sorted(forest), sorted(want))


def test_forest_of_few_edges_takes_few_jobs(spark, monkeypatch):
    draw = random.Random(5)
    edges = [(i, i + 1, draw.random()) for i in range(300)] + [(i, i + 7, 1 + draw.random()) for i in range(290)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    rounds = []
    monkeypatch.setattr(density, "components", lambda pairs: rounds.append(1) or components(pairs))
    from vidtrend.plans.hashtags import components
    want = set(edges[:300])
    assert {(r.a, r.b, r.w) for r in density.spanning_forest(df).collect()} == want and not rounds
    for most in (100, 350):  # by rounds until a task may hold the rest
        monkeypatch.setattr(density, "TASK_EDGES", most)
        assert {(r.a, r.b, r.w) for r in density.spanning_forest(df).collect()} == want
    assert rounds


def test_components_of_levels(spark, monkeypatch):
    pairs = [(level, 10 * i + level, 10 * (i + 1) + level) for level in range(3) for i in range(40) if i % (5 + level)]
    df = spark.createDataFrame(pairs, "level int, a bigint, b bigint")
    one = {(r.v, r.label) for r in density._labels(df).collect()}
    monkeypatch.setattr(density, "TASK_EDGES", 5)
    assert one == {(r.v, r.label) for r in density._labels(df).collect()} and len({label for _, label in one}) == 8 + 7 + 6
