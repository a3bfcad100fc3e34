"""Exact top-k search by inner product: columnar branch and bound over blocks of vectors.

Vectors are quantised to integers and packed into blocks in vertical layout (one row per dimension).
Queries meet candidate blocks through an equi-join on (length, query group, block slice): each
query group is sent to every slice and each block to every group, so the work is spread over
groups x slices tasks and no task holds more than one query group and one block. Inside a task the
score is accumulated dimension block by dimension block; after each one the candidates whose score
so far plus the largest possible rest (Cauchy-Schwarz over the remaining mass of both vectors) stays
below the k-th best score are dropped and the survivors are compacted.

Blocks hold 32-bit integers; blocks with larger components hold doubles, which are exact for whole
numbers of that size, and what the bounds leave of them is summed as integers of any size.

Defined results: a vector that is null, empty, holds a null or non-finite component, or one that leaves the
range of a double when scaled, takes no part, as does a row without id. A score beyond 64 bits is cut to the nearest 64-bit number. Vectors meet those of equal length.
Rows with the query's id are its own rows; of several that take part, the one with the smallest vector asks. Repeated rows are candidates of their own. Ties go to
the smaller id. Fewer than k candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.llm.common import stored

PACKED = "dim int, n int, wide boolean, ids binary, data binary, lead bigint"
LARGEST = 1 << 28
TOP = (1 << 63) - 1


def _pack(size: int, scale: int):
    """Arrow batches of (id, vector) to blocks of up to ``size`` vectors of one length."""
    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                ids, lists = batch.column(0), batch.column(1)
                if isinstance(lists, pa.ChunkedArray):
                    lists = lists.combine_chunks()
                lengths = np.asarray(lists.value_lengths().fill_null(0))
                known = np.asarray(ids.is_valid()) & (lengths > 0)
                flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")))
                begin = np.concatenate([[0], np.cumsum(lengths)])
                keys = np.asarray(ids.fill_null(0)).astype("<i8")
                out = []
                for dim in np.unique(lengths[known]):
                    at = np.flatnonzero(known & (lengths == dim))
                    x = flat[begin[at][:, None] + np.arange(dim)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(x * scale)
                    finite = np.isfinite(x).all(axis=1)
                    small = (np.abs(x) <= LARGEST).all(axis=1)
                    for wide, good in ((False, finite & small), (True, finite & ~small)):
                        if good.any():
                            own, kind = keys[at[good]], "<f8" if wide else "<i4"
                            out.append((int(dim), len(own), wide, own.tobytes(), np.ascontiguousarray(x[good].astype(kind).T).tobytes(), int(own[0])))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                     names=["dim", "n", "wide", "ids", "data", "lead"])
    return work


def _rest(columns: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    """Length of the part of each vector that lies at or after each edge."""
    squares = np.cumsum((columns.astype("f8") ** 2)[::-1], axis=0)[::-1]
    return [np.sqrt(squares[e]) if e < len(columns) else np.zeros(columns.shape[1]) for e in edges]


def search_block(q_ids, q, x_ids, x, best: dict, k: int, step: int) -> None:
    """Update ``best`` (query id -> [(-score, id)]) with one block; ``q`` and ``x`` are vertical."""
    dim = len(q)
    edges = [*range(step, dim, step), dim]
    q, wide = q.astype("f8"), x.astype("f8")  # sums stay below 2**53 for short vectors, see exact below
    exact = dim * float(np.abs(q).max(initial=0)) * float(np.abs(wide).max(initial=0)) < 2.0 ** 52
    (q_whole, *q_rest), (x_whole, *x_rest) = (_rest(part, [0, *edges]) for part in (q, wide))
    first = q[:edges[0]].T @ wide[:edges[0]]
    for i, query in enumerate(q_ids.tolist()):
        held = best.setdefault(query, [])
        mass = first[i]
        alive = np.flatnonzero(x_ids != query)
        floor = float(-held[k - 1][0]) if len(held) >= k else None
        # what rounding may add to or take from a sum of products of these lengths
        blur = 0.0 if exact else 1e-9 * float(q_whole[i]) * float(x_whole.max(initial=0))
        if floor is None and len(alive) > k:  # scores of the k most promising give a first bound
            top = alive[np.argpartition(-mass[alive], k - 1)[:k]]
            floor = float((q[:, i] @ wide[:, top]).min()) - blur
        score = mass[alive]
        for e, (edge, q_tail, x_tail) in enumerate(zip(edges, q_rest, x_rest)):
            if e:
                low = edges[e - 1]
                score = score + q[low:edge, i] @ wide[low:edge, alive]
            if floor is not None:
                reach = score + q_tail[i] * x_tail[alive]
                on = ~(reach < floor - 1e-6 * (1 + np.abs(reach)) - blur)  # what is not a number stays
                alive, score = alive[on], score[on]
        if exact:
            whole = score.astype("i8").tolist()
        else:
            own = [int(v) for v in q[:, i]]
            whole = [min(TOP, max(-TOP - 1, sum(a * int(b) for a, b in zip(own, x[:, j])))) for j in alive]
        if len(alive):
            held += [(-s, c) for s, c in zip(whole, x_ids[alive].tolist())]
            held.sort()
            del held[k:]


def _search(k: int, step: int):
    def work(batches):
        group, best = None, {}

        def flush():
            rows = [(q, c, -s) for q, held in best.items() for s, c in held]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in (zip(*rows) if rows else ([], [], []))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if (row["dim"], row["grp"]) != group:  # rows of a group come together
                    if best:
                        yield flush()
                    group, best = (row["dim"], row["grp"]), {}
                load = lambda p: np.frombuffer(row[p + "data"], "<f8" if row[p + "wide"] else "<i4").reshape(row["dim"], -1)  # noqa: B023, E731
                with np.errstate(over="ignore", invalid="ignore"):
                    search_block(np.frombuffer(row["q_ids"], "<i8"), load("q_"), np.frombuffer(row["ids"], "<i8"), load(""), best, k, step)
        if best:
            yield flush()
    return work


def top_k(vectors: DataFrame, id_col: str, vector_col: str, queries, k: int = 5, scale: int = 256,
          block: int = 4096, group: int = 1024, step: int = 16, blocks_per_slice: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows for each row that meets ``queries``.

    ``queries`` is a column condition. ``block`` candidates and ``group`` queries are held at a time.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          queries.alias("_q"))
    packed = stored(rows.select("id", "v").mapInArrow(_pack(block, scale), PACKED), "blocks")
    wanted, blocks = rows.filter("_q").count(), packed.count()
    groups, cuts = max(1, -(-wanted // group)), max(1, -(-blocks // blocks_per_slice))
    takes_part = F.expr(f"size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x * {scale}) = double('infinity'))")
    # hash groups have about ``group`` queries each, so the list of a group is bounded
    asked = (rows.filter("_q").filter(takes_part).groupBy("id").agg(F.min("v").alias("v"))
             .groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("grp"))
             .agg(F.collect_list(F.struct("id", "v")).alias("members")).select(F.inline("members")))
    asked = stored(asked.mapInArrow(_pack(group, scale), PACKED), "asked")
    asked = asked.select("dim", F.pmod(F.xxhash64("lead", "dim"), F.lit(groups)).cast("int").alias("grp"),
                         F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"),
                         F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    blocks = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
                           F.pmod(F.xxhash64("ids"), F.lit(cuts)).cast("int").alias("cut"), "wide", "ids", "data")
    pairs = asked.join(blocks.hint("shuffle_merge"), ["dim", "grp", "cut"])
    found = pairs.select("dim", "grp", "q_wide", "q_ids", "q_data", "wide", "ids", "data").mapInArrow(
        _search(k, step), "query_id bigint, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
