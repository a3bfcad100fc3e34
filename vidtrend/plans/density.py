"""Density clusters of vectors with noise, without a number of clusters.

Two rows are linked if their unit vectors are closer than ``reach`` (an exact cosine join). The mutual
reachability of a link is the greatest of its length and of the core distances of both ends (the distance
within which a row has ``min_points`` rows, itself included). Whatever has a mutual reachability within
``reach`` has its whole neighbourhood in the links, so the graph is exact up to there. Borůvka rounds over
the edge table keep its minimum spanning forest, at most one edge a row (tasks thin the table first, and finish it
as soon as one may hold what is left); the forest is cut at ``levels``
distances, and components of at least ``min_size`` rows become a tree of clusters. A cluster that persists
over a longer range of densities than the clusters it splits into together is kept, else those are.

Equal vectors are one point with a weight, so copies cost nothing. All tables are edges, points or points
times levels; the only loops are Borůvka rounds (halving the components), label spreading, and one
round per depth of the cluster tree, which is below ``levels``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.operators.scale import top_n
from vidtrend.operators.similarity import forest_edges, least_edges, nearest, smallest_labels, unit
from vidtrend.plans.hashtags import components
from vidtrend.session import written


#: Edges that one task may hold.
TASK_EDGES = 1 << 20


def _points(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a number and their unit vector (null if it has none), and the distinct vectors with their weight."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    unit_of = unit(F.col(f"`{vector}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), unit_of.alias("u"))
    rows = written(rows.withColumn("u", F.when(F.col("id").isNotNull() & (F.size("u") > 0) & F.forall("u", finite), F.col("u"))))
    points = rows.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("weight"))
    return rows, written(points.withColumn("p", F.monotonically_increasing_id()))


def _cores(points: DataFrame, reach: float, min_points: int) -> DataFrame:
    """``p, weight, core`` of the points that have ``min_points`` rows within reach.

    Only the nearest partners of a point count, so each pair of blocks gives those instead of all its links.
    """
    around = written(nearest(points, "p", "u", 1 - reach * reach / 2, max(1, min_points - 1)))
    weights = points.select("p", "weight")
    # every partner weighs at least one row, so the first min_points - 1 of them decide
    first = top_n(around, ["p"], [F.col("d"), F.col("q")], max(1, min_points - 1))
    first = first.join(weights.select(F.col("p").alias("q"), F.col("weight").alias("more")), "q").join(weights, "p")
    so_far = F.sum("more").over(Window.partitionBy("p").orderBy("rank"))
    far = first.withColumn("rows", F.col("weight") + so_far).filter(F.col("rows") >= min_points).groupBy("p").agg(F.min("d").alias("far"))
    core = F.when(F.col("weight") >= min_points, 0.0).otherwise(F.col("far"))
    return written(weights.join(far, "p", "left").select("p", "weight", core.alias("core")).filter("core IS NOT NULL"))


def core_distances(df: DataFrame, id_col: str, vector: str, min_points: int = 5, reach: float = 1.0) -> DataFrame:
    """``id, core``: the distance within which a row has ``min_points`` rows, for rows where that is below ``reach``."""
    rows, points = _points(df, id_col, vector)
    cores = _cores(points, reach, min_points)
    return rows.join(points.join(cores.select("p", "core"), "p").select("u", "core"), "u").select(F.col("id").alias(id_col), "core")


def _numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of the ends of edges, ascending, and the ends as places among them."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    return ids, at[:len(x)], at[len(x):]


def _own_forest(batches):
    """The edges of a task that its own minimum spanning forest keeps."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if table is not None and table.num_rows:
        w, a, b, ca, cb = [table[c].to_numpy() for c in ("w", "a", "b", "ca", "cb")]
        ids, u, v = _numbered(ca, cb)
        kept = least_edges(np.lexsort((b, a, w)), u, v, len(ids))
        yield from table.take(pa.array(kept)).combine_chunks().to_batches()


def _thinned(left: DataFrame) -> tuple[DataFrame, int]:
    """Edges without those that the forests of tasks leave out, as long as that takes half of them away, and their number."""
    count = left.count()
    while count > TASK_EDGES:
        less = written(left.repartition(-(-count // TASK_EDGES)).mapInArrow(_own_forest, left.schema))
        before, count, left = count, less.count(), less
        if 2 * count > before:
            break
    return left, count


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``a, b, w``: minimum spanning forest of undirected edges, ties by ``a`` and ``b``.

    Every round takes the least edge of each component (edges are totally ordered, so no cycle arises) and
    contracts; components at least halve, and parallel edges leave but their least. As soon as one task may
    hold the edges that are left, it takes all that remains.
    """
    left = written(edges.select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = left.select("a", "b", "w").limit(0)
    while True:
        left, count = _thinned(left)
        if count <= TASK_EDGES:
            return forest.unionByName(written(left.repartition(1).mapInArrow(_own_forest, left.schema)).select("a", "b", "w"))
        edge = F.struct("w", "a", "b", "ca", "cb")
        ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), edge.alias("e"))
        chosen = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        forest = forest.unionByName(chosen.select("a", "b", "w"))
        names = components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        to = lambda end: names.select(F.col("v").alias(end), F.col("label").alias(f"_{end}"))  # noqa: E731, B023
        moved = left.join(to("ca"), "ca").join(to("cb"), "cb").filter("_ca <> _cb")
        least = moved.groupBy(F.least("_ca", "_cb").alias("ca"), F.greatest("_ca", "_cb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        left = written(least.select("e.w", "e.a", "e.b", "ca", "cb"))


def _own_labels(table: pa.Table) -> pa.Table:
    ids, u, v = _numbered(table["a"].to_numpy(), table["b"].to_numpy())
    return pa.table({"v": ids, "label": ids[smallest_labels(u, v, len(ids))]})


def _labels(pairs: DataFrame) -> DataFrame:
    """``v, label`` of the components of ``level, a, b`` (no vertex is in two levels); a level that a task may hold is one task."""
    pairs = written(pairs)
    if pairs.groupBy("level").agg(F.count("*").alias("n")).filter(F.col("n") > TASK_EDGES).isEmpty():
        return pairs.groupBy("level").applyInArrow(_own_labels, "v bigint, label bigint")
    return components(pairs.select("a", "b"))


def _cuts(reach: float, levels: int) -> list[float]:
    """Distances from ``reach / 50`` to ``reach``, each the same factor above the one before."""
    return [reach * 50.0 ** (i / (levels - 1) - 1) for i in range(levels)]


def _members(cores: DataFrame, forest: DataFrame, cuts: list[float]) -> DataFrame:
    """``p, weight, level, node, comp``: the component of each point at each level from its core distance on.

    A node is ``p * levels + level``; a component is named by its smallest node, so one level up that
    node's number is one more.
    """
    levels, bounds = len(cuts), F.array(*[F.lit(c) for c in cuts[:-1]])
    level = lambda x: F.size(F.filter(bounds, lambda c: c < x))
    every = lambda x: F.explode(F.sequence(level(F.col(x)), F.lit(levels - 1)))
    at = lambda x: (F.col(x) * levels + F.col("level")).alias(x)
    labels = _labels(forest.select("a", "b", every("w").alias("level")).select("level", at("a"), at("b")))
    nodes = cores.select("p", "weight", every("core").alias("level")).withColumn("node", F.col("p") * levels + F.col("level"))
    named = nodes.join(labels.withColumnRenamed("v", "node"), "node", "left")
    return written(named.select("p", "weight", "level", "node", F.coalesce("label", "node").alias("comp")))


def _chains(members: DataFrame, cuts: list[float], min_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large components (``comp, level, size``), clusters (``head, depth, parent, stability``) and their ancestors.

    A component goes on as the cluster of the component above it unless that one holds several large ones.
    """
    levels = len(cuts)
    nodes = members.groupBy("level", "comp").agg(F.sum("weight").alias("size")).filter(F.col("size") >= min_size)
    nodes = written(nodes)
    where = members.select(F.col("node").alias("seen"), F.col("comp").alias("above"))
    over = nodes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(levels - 1) - F.col("level"))))
    over = written(over.withColumn("seen", F.col("comp") + F.col("step")).join(where, "seen").select("comp", "level", "size", "step", "above"))
    next_up = over.filter("step = 1").select("comp", F.col("above").alias("up"))
    splits = next_up.groupBy("up").agg(F.count("*").alias("kids")).filter("kids > 1").select("up")
    heads = nodes.filter(F.col("level") == levels - 1).select(F.col("comp").alias("head")).unionByName(
        next_up.join(splits, "up").select(F.col("comp").alias("head")))
    lines = written(over.join(heads.withColumnRenamed("head", "above"), "above"))
    own = lines.groupBy("comp", "level", "size").agg(F.min_by("above", "step").alias("head"))
    density = F.array(*[F.lit(1 / c) for c in cuts])
    gain = F.get(density, "level") - F.get(density, F.least(F.col("level") + 1, F.lit(levels - 1)))
    stability = own.groupBy("head").agg(F.sum(F.col("size") * gain).alias("stability"))
    ancestors = written(heads.join(lines.select(F.col("comp").alias("head"), "step", "above").filter("step > 0"), "head"))
    place = ancestors.groupBy("head").agg(F.count("*").alias("depth"), F.min_by("above", "step").alias("parent"))
    tree = stability.join(place, "head", "left").select("head", F.coalesce("depth", F.lit(0)).alias("depth"), "parent", "stability")
    return nodes, written(tree), ancestors


def _selected(tree: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``head`` of the clusters that outweigh what they split into and lie in no such cluster."""
    deepest = tree.agg(F.max("depth").alias("m")).first()["m"]
    below = tree.select(F.col("head"), F.col("stability").alias("inner")).limit(0)
    winners = tree.select("head").limit(0)
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = tree.filter(F.col("depth") == depth).join(below, "head", "left").withColumn("inner", F.coalesce("inner", F.lit(0.0)))
        own = written(own.withColumn("best", F.greatest("stability", "inner")))
        winners = winners.unionByName(own.filter("stability >= inner").select("head"))
        below = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("head")).agg(F.sum("best").alias("inner"))
    winners = written(winners)
    inside = ancestors.join(winners.withColumnRenamed("head", "above"), "above", "left_semi").select("head")
    return winners.join(inside, "head", "left_anti")


def density_clusters(df: DataFrame, id_col: str, vector: str, min_points: int = 5, min_size: int = 20, reach: float = 1.0,
                     levels: int = 16) -> DataFrame:
    """``id, cluster, strength`` of every row; ``cluster`` is the smallest id in it and null for noise.

    ``reach`` is the greatest Euclidean distance of unit vectors that links rows (below 2; 1 is a cosine of
    0.5). ``strength`` is the greatest density at which a row is in a large component, as a share of the
    cluster's greatest; 0 for noise. Rows without id, and vectors that are null, empty, all zero or not
    finite, are noise; rows that repeat count each. An empty table gives no rows.
    """
    if not (0 < reach < 2 and levels > 1 and min_points > 0 and min_size > 0):
        raise ValueError("reach must lie between 0 and 2, levels be at least 2, min_points and min_size positive")
    rows, points = _points(df, id_col, vector)
    cuts, cores = _cuts(reach, levels), _cores(points, reach, min_points)
    reachable = forest_edges(points.join(cores.select("p", "core"), "p"), "p", "u", "core", 1 - reach * reach / 2)
    members = _members(cores, spanning_forest(reachable), cuts)
    nodes, tree, ancestors = _chains(members, cuts, min_size)
    chosen = _selected(tree, ancestors)
    inside = members.join(chosen, members.comp == chosen["head"]).select("p", "head")
    density = F.array(*[F.lit(1 / c) for c in cuts])
    dense = members.join(nodes.select("comp"), "comp").groupBy("p").agg(F.min("level").alias("level"))
    placed = written(inside.join(dense, "p").join(points.select("p", "u"), "p").select("u", "head", F.get(density, "level").alias("density")))
    known = written(rows.join(placed, "u", "left").select("id", "head", "density"))
    names = known.filter("head IS NOT NULL").groupBy("head").agg(F.min("id").alias("cluster"), F.max("density").alias("most"))
    strength: Column = F.coalesce(F.col("density") / F.col("most"), F.lit(0.0))
    return known.join(names, "head", "left").select(F.col("id").alias(id_col), "cluster", strength.alias("strength"))
