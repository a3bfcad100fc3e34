"""Exact cosine self-join for any number of vectors.

Positions of the vectors are ordered from the rarest to the most frequent (rows with a non-zero value
there). A row is listed under its first positions, up to where the norm of the rest falls below the
threshold: two vectors without a common listed position have their whole product in the shorter rest, so
it stays below the threshold. Rows meet by an equi-join on listed positions. Positions held by very many
rows are one list together, so dense vectors meet once and not once per position. A long list is cut into
blocks; pairs of blocks are multiplied in tasks of their own, so a list of any length is no single task.
What is shipped grows with rows times blocks, so a block is as large as a task may hold, and multiplied tile by tile.
Tiles are multiplied in single precision; only pairs that may matter are summed in double precision and in order.
``nearest`` and ``forest`` keep in a task only what can still matter of its pairs, so no pair of vectors is shipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vidtrend.functions import text
from vidtrend.operators.scale import checked_broadcast
from vidtrend.session import cut_lineage

#: List of all positions that more than ``hot`` rows hold.
FREQUENT = -1
#: Sums in another order may differ by so much; pairs this near the threshold are summed in order.
SLACK = 1e-9
#: Bytes of the vectors in a block; blocks of a list below that; rows of a tile; pairs that a task gathers before it reduces them.
BLOCK_BYTES, LEAST_BLOCKS, LEAST_ROWS, TILE, GATHERED = 16 << 20, 16, 512, (1024, 4096), 1 << 18
#: Rows of a block that give the first bounds of the nearest of another one.
FIRST = 1024
#: Share of the edges of a forest up to which it tells apart what a later pair can still join.
SETTLED = 0.98


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its norm; null elements where the norm is 0."""
    norm = lambda d: text.bind(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: F.try_divide(x, n)))
    return text.bind(v.cast("array<double>"), norm)


def _lists(rows: DataFrame, minimum: float, hot: int) -> DataFrame:
    """Adds ``keys``: the lists that a row stands in."""
    if minimum <= 0:  # vectors without a common position pass too
        return rows.withColumn("keys", F.array(F.lit(FREQUENT)))
    held = rows.select("n", F.posexplode("u").alias("at", "x")).filter("x <> 0").groupBy("n", "at").agg(F.count("*").alias("rows"))
    held = cut_lineage(held)
    if minimum <= 1 and held.filter(F.col("rows") <= hot).isEmpty():  # one list, and every row stands in it
        return rows.withColumn("keys", F.array(F.lit(FREQUENT)))
    # one row per length of vectors, with an entry per position, whatever the number of vectors
    orders = held.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("rows", "at"))).alias("order"))
    start = F.struct(F.lit(1.0).alias("rest"), F.array().cast("array<int>").alias("keys"))

    def step(acc, o):
        x = F.get(F.col("u"), o["at"])
        key = F.when(o["rows"] > hot, FREQUENT).otherwise(o["at"])
        new = (x != 0) & (acc["rest"] >= minimum * minimum - SLACK) & ~F.array_contains(acc["keys"], key)
        return F.struct((acc["rest"] - x * x).alias("rest"), F.when(new, F.array_append(acc["keys"], key)).otherwise(acc["keys"]).alias("keys"))

    ordered = rows.join(checked_broadcast(orders, 1_000), "n")
    return ordered.withColumn("keys", F.aggregate("order", start, step)["keys"]).drop("order")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _slack(size: int) -> float:
    """What a product of unit vectors in single precision may be off by, and ``SLACK``."""
    return SLACK + (size + 8) * 2.0 ** -23


def _tiles(row: dict, minimum: float, wanted=None):
    """``i, j, cosine`` of the pairs of two blocks above the threshold, each at the first list that both rows stand in.

    ``wanted(near, x, y, slack)`` marks the pairs of the tile at ``x, y`` that are looked at, by cosines that may be off by ``slack``.
    """
    key, same, left, right = row["key"], row["lo"] == row["hi"], row["left"], row["right"]
    a, b = _matrix(left.field("u")), _matrix(right.field("u"))
    slack = _slack(a.shape[1])
    a, b, rows, columns = a.astype(np.float32), b.astype(np.float32), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    # the frequent list is the first of all rows that stand in it
    sets = None if key == FREQUENT else [[frozenset(k) for k in side.field("keys").to_pylist()] for side in (left, right)]
    for x in range(0, len(a), TILE[0]):
        for y in range(0, len(b), TILE[1]):
            if same and y + TILE[1] <= x:
                continue
            near = a[x:x + TILE[0]] @ b[y:y + TILE[1]].T
            at = np.flatnonzero(wanted(near, x, y, slack) if wanted else near > minimum - slack)
            i = at // near.shape[1]
            i, j = i + x, at - i * near.shape[1] + y
            if same:
                i, j = i[i < j], j[i < j]
            total = np.zeros(len(i))
            for d in range(len(rows)):
                total += rows[d].take(i) * columns[d].take(j)
            take = total > minimum
            if sets:
                take &= np.fromiter((min(sets[0][p] & sets[1][q]) == key for p, q in zip(i, j)), bool, len(i))
            yield i[take], j[take], total[take]


def _rows(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch[name][at].as_py() for name in ("key", "lo", "hi")}
            yield row | {name: batch[name][at].values for name in ("left", "right")}


def _products(minimum: float):
    def work(batches):
        for row in _rows(batches):
            for i, j, cosine in _tiles(row, minimum):
                x, y = row["left"].field("id").take(pa.array(i)), row["right"].field("id").take(pa.array(j))
                yield pa.RecordBatch.from_arrays([x, y, pa.array(cosine)], names=["x", "y", "cosine"])

    return work


def _ends(row: dict) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Ids of both blocks, the place of the right one in them, and their extra numbers."""
    sides = [row["left"]] if row["lo"] == row["hi"] else [row["left"], row["right"]]
    column = lambda name: np.concatenate([side.field(name).to_numpy(zero_copy_only=False) for side in sides])
    return column("id"), 0 if len(sides) == 1 else len(sides[0]), column("extra") if sides[0].type.get_field_index("extra") >= 0 else None


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0.0))


def _known_low(row: dict, minimum: float, count: int) -> np.ndarray:
    """A cosine that ``count`` partners of each row of two blocks reach, from the first rows of the other block; ``minimum`` at least."""
    a, b = [_matrix(row[side].field("u")).astype(np.float32) for side in ("left", "right")]
    same, found = row["lo"] == row["hi"], []
    for own, other in [(a, b)] if same else [(a, b), (b, a)]:
        other, low = other[:FIRST], np.full(len(own), minimum)
        place = len(other) - count - same  # a row of the same block may meet itself
        if place >= 0:
            for x in range(0, len(own), TILE[0]):
                reached = np.partition(own[x:x + TILE[0]] @ other.T, place, axis=1)[:, place]
                low[x:x + TILE[0]] = np.maximum(minimum, reached - _slack(a.shape[1]))
        found.append(low)
    return np.concatenate(found)


def _nearest(minimum: float, count: int):
    def first(own, other, d, ids):
        order = np.lexsort((ids[other], d, own))
        own, other, d = own[order], other[order], d[order]
        place = np.arange(len(own))
        start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]][:len(own)], place, 0))
        keep, last = place - start < count, place - start == count - 1
        return own[keep], other[keep], d[keep], own[last], d[last]

    def work(batches):
        for row in _rows(batches):
            ids, offset, _ = _ends(row)
            low, parts, size = _known_low(row, minimum, count), [], 0
            bound = _distance(low - SLACK)

            def reduced():
                own, other, d, full, far = first(*[np.concatenate(c) for c in zip(*parts)], ids)
                bound[full], low[full] = far, 1 - far * far / 2
                return [(own, other, d)]

            def nearer(near, x, y, slack):
                lows = (low - slack).astype(np.float32)
                return (near > lows[x:x + len(near), None]) | (near > lows[offset + y:offset + y + near.shape[1]])

            for i, j, cosine in _tiles(row, minimum, nearer):
                d, i, j = _distance(cosine), i, j + offset
                for own, other in ((i, j), (j, i)):
                    near = d <= bound[own]
                    parts.append((own[near], other[near], d[near]))
                    size += int(near.sum())
                if size > GATHERED:
                    parts, size = reduced(), 0
            if parts:
                own, other, d = reduced()[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[other]), pa.array(d)], names=["p", "q", "d"])

    return work


def smallest_labels(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The smallest number that each of ``count`` vertices is joined with by the edges ``x, y``."""
    root = np.arange(count)
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        low = np.minimum(p, q)
        for end in (p, q):
            np.minimum.at(root, end, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def least_edges(order: np.ndarray, u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the edges ``u, v`` of ``count`` vertices in the minimum spanning forest, if ``order`` sorts the edges."""
    u, v, label, keep, left = u[order], v[order], np.arange(count), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        cu, cv = label[u[left]], label[v[left]]
        left, cu, cv = left[cu != cv], cu[cu != cv], cv[cu != cv]
        if not len(left):
            return order[keep]
        least = np.full(count, len(order))
        for c in (cu, cv):  # edges ascend, so the last one written is the least
            own = np.full(count, len(order))
            own[c[::-1]] = left[::-1]
            least = np.minimum(least, own)
        chosen = np.unique(least[least < len(order)])
        keep[chosen] = True
        label = smallest_labels(label[u[chosen]], label[v[chosen]], count)[label]


def _least_edges(w: np.ndarray, u: np.ndarray, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers of the edges of the minimum spanning forest, ties by the ids of the ends (the smaller first)."""
    a, b = np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v])
    return least_edges(np.lexsort((b, a, w)), u, v, len(ids))


def _forest(minimum: float):
    def work(batches):
        for row in _rows(batches):
            ids, offset, core = _ends(row)
            parts, size, part, close = [], 0, None, minimum

            def reduced():
                nonlocal part, close
                w, u, v = [np.concatenate(c) for c in zip(*parts)]
                kept = _least_edges(w, u, v, ids)
                w, u, v = w[kept], u[kept], v[kept]
                if len(w):
                    far = np.quantile(w, SETTLED)
                    part, close = smallest_labels(u[w <= far], v[w <= far], len(ids)).astype(np.int32), 1 - far * far / 2
                return [(w, u, v)]

            def joining(near, x, y, slack):
                # a pair longer than all edges of a path between its ends is in no forest
                if part is None:
                    return near > minimum - slack
                apart = part[x:x + len(near), None] != part[offset + y:offset + y + near.shape[1]]
                return (near > max(minimum, close) - slack) | (apart & (near > minimum - slack))

            for i, j, cosine in _tiles(row, minimum, joining):
                u, v = i, j + offset
                parts.append((np.maximum(_distance(cosine), np.maximum(core[u], core[v])), u, v))
                size += len(u)
                if size > GATHERED:
                    parts, size = reduced(), 0
            if parts:
                w, u, v = reduced()[0]
                ends = [np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ends, w)], names=["a", "b", "w"])

    return work


def _met(df: DataFrame, id_col: str, vector: str, minimum: float, block: int | None, hot: int, extra: str | None = None) -> DataFrame:
    """``key, lo, hi, left, right``: the pairs of blocks of every list; a block holds ``id, u, keys`` and maybe ``extra``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    more = [F.col(f"`{extra}`").alias("extra")] if extra else []
    rows = df.select(F.col(f"`{id_col}`").alias("id"), unit(F.col(f"`{vector}`")).alias("u"), *more).filter(
        F.col("id").isNotNull() & (F.size("u") > 0) & F.forall("u", finite))
    # read for the order, the sizes and the blocks; the written numbers keep a row in its block if a task runs again
    rows = cut_lineage(rows.withColumn("n", F.size("u")).withColumn("row", F.monotonically_increasing_id()))
    listed = cut_lineage(_lists(rows, minimum, hot).withColumn("key", F.explode("keys")))
    sizes = listed.groupBy("n", "key").agg(F.count("*").alias("rows")).filter("rows > 1")
    if block:
        blocks = F.ceil(F.col("rows") / block)
    else:
        blocks = F.greatest(F.ceil(F.col("rows") * F.col("n") * 8 / BLOCK_BYTES), F.least(F.ceil(F.col("rows") / LEAST_ROWS), F.lit(LEAST_BLOCKS)))
    dealt = (listed.join(checked_broadcast(sizes), ["n", "key"]).withColumn("blocks", blocks.cast("int"))
             .withColumn("lo", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")))
    held = F.struct("id", "u", "keys", *(["extra"] if extra else []))
    blocks = cut_lineage(dealt.groupBy("n", "key", "blocks", "lo").agg(F.collect_list(held).alias("left")))
    ahead = blocks.withColumn("hi", F.explode(F.sequence("lo", F.col("blocks") - 1))).drop("blocks")
    met = ahead.join(blocks.select("n", "key", F.col("lo").alias("hi"), F.col("left").alias("right")), ["n", "key", "hi"])
    return met.select("key", "lo", "hi", "left", "right")


def cosine_pairs(df: DataFrame, id_col: str, vector: str, minimum: float, block: int | None = None, hot: int = 2048) -> DataFrame:
    """``a, b, cosine`` of all pairs of ids ``a < b`` with a cosine above ``minimum``.

    ``vector`` is an array of numbers. Rows without id, and vectors that are null, all zero, or hold a null
    or non-finite value, are in no pair; nor are vectors of different lengths. Rows with one id are not paired
    with each other, and their pairs with others are all listed. ``block`` bounds the rows of a block (by
    default ``BLOCK_BYTES`` do), ``hot`` the list from which positions share one list; neither changes the result.
    """
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType
    schema = StructType([StructField("x", kind), StructField("y", kind), StructField("cosine", DoubleType())])
    found = _met(df, id_col, vector, minimum, block, hot).mapInArrow(_products(minimum), schema)
    return found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def nearest(df: DataFrame, id_col: str, vector: str, minimum: float, count: int, block: int | None = None, hot: int = 2048) -> DataFrame:
    """``p, q, d``: rows that hold, for each id, the ``count`` nearest others (by distance, then id) with a cosine above ``minimum``.

    Ids are unique bigints. Each pair of blocks gives its own nearest, so there are more rows than those; all of
    them are pairs above ``minimum``.
    """
    return _met(df, id_col, vector, minimum, block, hot).mapInArrow(_nearest(minimum, count), "p bigint, q bigint, d double")


def forest_edges(df: DataFrame, id_col: str, vector: str, core: str, minimum: float, block: int | None = None, hot: int = 2048) -> DataFrame:
    """``a, b, w``: edges that hold the minimum spanning forest of all pairs with a cosine above ``minimum``.

    An edge weighs the greatest of its length and of ``core`` at both ends. An edge that the forest of two blocks
    leaves out is in no forest of the whole. Ids are unique bigints.
    """
    return _met(df, id_col, vector, minimum, block, hot, core).mapInArrow(_forest(minimum), "a bigint, b bigint, w double")
