"""A Merkle manifest of a table: digests of rows, of each source and of the whole table, with proofs.

1. Leaves. A row's digest covers its columns, each as ``-`` (null) or UTF-8 byte count, ``:``, value.
2. Places. Rows are range-partitioned by (group, id, digests); a row's place in its group is its number
   inside its partition plus the rows of the group in the partitions before, so no task holds a group.
3. Slot pivot. ``fanout ** levels`` neighbours of a group meet in one row: a conditional aggregate per
   slot spreads them into columns. Concatenating the columns of one parent hashes it, and leaving out a
   node's own column gives its siblings; ``levels`` levels are built in a row before the next shuffle.
   Groups that are down to one node are finished; their subroots form one more tree.
4. Proofs go down: a block joins the proof of its top node, and every node adds its siblings, as
   (left, right) per level. Only one row per block is shuffled, never one per row of the table.

Defined results: null columns count as ``-``; a null group is its own and comes first, groups ascend by
UTF-8 bytes; null ids come first. Rows that repeat an id are ordered by their digests, and equal rows
are leaves of their own with equal results except for their proofs. Texts are hashed whole. A single
row is leaf and subroot at once; an only subroot is the root; an empty proof is the digest of nothing.
Columns that are not named take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.llm.common import stored

PROOF = "array<struct<left: string, right: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts; absent (null) parts count as empty."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx`` (place in ``grp`` by ``order``, from 0) and ``n`` (rows of ``grp``)."""
    cut = (leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
           .withColumn("_m", F.monotonically_increasing_id()))
    cut = stored(cut.withColumn("_part", F.shiftright("_m", 33)), "placed")
    runs = cut.groupBy("grp", "_part").agg(F.min("_m").alias("_first"), F.count("*").alias("_rows"))
    per = Window.partitionBy("grp")
    before = per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(per).alias("n"))
    return (cut.join(runs, ["grp", "_part"]).withColumn("idx", F.col("_before") + F.col("_m") - F.col("_first"))
            .drop("_m", "_part", "_first", "_before"))


def _pivot(nodes: DataFrame, fanout: int, levels: int, payload: Sequence[str]) -> DataFrame:
    """One row per ``fanout ** levels`` neighbours: their columns ``s0…``, the nodes above, and the top."""
    size = fanout ** levels
    slot = F.pmod("idx", F.lit(size))
    item = F.struct("hash", *payload)
    rows = nodes.groupBy("grp", F.floor(F.col("idx") / size).alias("block"), "n").agg(
        *[F.max(F.when(slot == i, item)).alias(f"s{i}") for i in range(size)])
    rows = rows.select("*", *[F.col(f"s{i}.hash").alias(f"h0_{i}") for i in range(size)], F.col("n").alias("n0"))
    for level in range(1, levels + 1):
        below, one = f"h{level - 1}_", F.col(f"n{level - 1}") == 1
        parents = []
        for j in range(fanout ** (levels - level)):
            kids = [F.col(f"{below}{j * fanout + k}") for k in range(fanout)]
            parents.append(F.when(one, kids[0]).when(kids[0].isNotNull(), digest(*kids)).alias(f"h{level}_{j}"))
        rows = rows.select("*", *parents, F.ceil(F.col(f"n{level - 1}") / fanout).alias(f"n{level}"))
    return rows


def build(leaves: DataFrame, fanout: int = 3, levels: int = 3, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of pivoted blocks, one per round, and ``grp, hash`` of the finished trees.

    Each round divides the nodes by ``fanout ** levels``, so the number of rounds is logarithmic.
    """
    rounds, tops, nodes, extra = [], [], leaves, list(payload)
    while True:
        blocks = stored(_pivot(nodes, fanout, levels, extra), "blocks")
        rounds.append(blocks)
        top = blocks.select("grp", F.col("block").alias("idx"), F.col(f"n{levels}").alias("n"), F.col(f"h{levels}_0").alias("hash"))
        tops.append(top.filter("n = 1").select("grp", "hash"))
        nodes, extra = top.filter("n > 1"), []
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)


def _paths(fanout: int, levels: int) -> Column:
    """Array of the children of a block, each with its siblings up to the block's top and its slot."""
    def steps(i: int) -> Column:
        path = []
        for level in range(levels):
            node = i // fanout ** level
            kids = [F.col(f"h{level}_{node // fanout * fanout + k}") for k in range(fanout)]
            own = node % fanout
            step = F.struct(F.concat_ws("", *kids[:own]).alias("left"), F.concat_ws("", *kids[own + 1:]).alias("right"))
            path.append(F.when(F.col(f"n{level}") > 1, step))
        return F.filter(F.array(*path), lambda s: s.isNotNull())
    size = fanout ** levels
    return F.filter(F.array(*[F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"s{i}").alias("node"), steps(i).alias("path")))
                              for i in range(size)]), lambda s: s.isNotNull())


def proofs(rounds: Sequence[DataFrame], above: DataFrame, fanout: int = 3, levels: int = 3) -> DataFrame:
    """Every leaf (``grp``, ``node`` struct) with its ``proof`` and the columns of ``above``.

    ``above`` has ``grp``, ``proof`` (that of the finished tree itself, empty at the very top) and any
    further columns, which are handed down.
    """
    handed = [c for c in above.columns if c not in ("grp", "proof")]
    waiting = None
    for number, blocks in reversed(list(enumerate(rounds))):
        done = blocks.filter(F.col(f"n{levels}") == 1).join(above, "grp")
        if waiting is not None:
            done = done.unionByName(blocks.filter(F.col(f"n{levels}") > 1).join(waiting, ["grp", "block"]))
        child = done.select("grp", "block", "proof", *handed, F.explode(_paths(fanout, levels)).alias("_c"))
        child = child.select("grp", (F.col("block") * fanout ** levels + F.col("_c.slot")).alias("block"), F.col("_c.node").alias("node"),
                             F.concat(F.col("_c.path"), F.col("proof")).alias("proof"), *handed)
        if number:
            waiting = stored(child.drop("node"), "proofs")
    return child.drop("block")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(rows: DataFrame, by: str, order: str, columns: Sequence[str], candidate: Sequence[Column] | None = None,
             fanout: int = 3, levels: int = 3) -> DataFrame:
    """``order, leaf, subroot, root, proof, checked`` of every row.

    ``candidate`` replaces the columns by those of a copy under test; ``checked`` is that copy's leaf
    (the leaf itself without one). Fold it with ``proof`` to see whether the copy belongs to ``root``.
    """
    leaf = digest(*[encoded(F.col(f"`{c}`")) for c in columns])
    other = digest(*[encoded(c) for c in candidate]) if candidate is not None else leaf
    leaves = stored(rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit("")).alias("grp"),
        F.col(f"`{order}`").cast("bigint").alias("id"), leaf.alias("hash"), other.alias("checked")), "leaves")
    rounds, subroots = build(placed(leaves, ["id", "hash", "checked"]), fanout, levels, ["id", "checked"])
    subroots = stored(subroots, "subroots")
    # one tree over the subroots: its only group is '', the group of a subroot is its payload
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "hash")
    upper, roots = build(placed(named, ["source"]), fanout, levels, ["source"])
    start = roots.select("grp", F.col("hash").alias("root"), F.array().cast(PROOF).alias("proof"))
    above = stored(proofs(upper, start, fanout, levels).select(
        F.col("node.source").alias("grp"), F.col("node.hash").alias("subroot"), "root", "proof"), "above")
    return proofs(rounds, above, fanout, levels).select(
        F.col("node.id").alias(order), F.col("node.hash").alias("leaf"), "subroot", "root", "proof", F.col("node.checked").alias("checked"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_report(docs: DataFrame) -> DataFrame:
    """Manifest of documents, checked against a copy in which every second text (by crc32) lost its line ends."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    copy = [F.col(c) for c in COLUMNS[:-1]] + [F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
    made = manifest(docs, "source", "doc_id", COLUMNS, copy)
    made = made.withColumn("folded_root", folded(F.col("checked"), F.col("proof")))
    siblings = F.transform("proof", lambda s: F.concat(s["left"], s["right"]))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
WITH RECURSIVE tab AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
                     FOR n IN range(256)] AS t),
d AS (SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS id FROM documents),
c AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(id, '')]),
                                  lambda a, b : xor(a // 256, t[CAST(xor(a, b) % 256 + 1 AS INT)])), 4294967295) AS crc FROM d, tab),
e AS (SELECT k, doc_id, source, text AS original, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS copied,
             coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
             || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM c),
leaf AS (SELECT k, doc_id, source, sha256(head || coalesce(strlen(original) || ':' || original, '-')) AS leaf,
                sha256(head || coalesce(strlen(copied) || ':' || copied, '-')) AS checked FROM e),
base AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
t AS (SELECT 0 AS l, source, idx, leaf AS h, n FROM base
      UNION ALL SELECT l + 1, source, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), CAST(ceil(any_value(n) / 3.0) AS BIGINT) FROM t WHERE n > 1 GROUP BY l, source, idx // 3),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, idx, h, n FROM sub
      UNION ALL SELECT l + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), CAST(ceil(any_value(n) / 3.0) AS BIGINT) FROM u WHERE n > 1 GROUP BY l, idx // 3),
deep AS (SELECT source, max(l) AS depth FROM t GROUP BY source),
every AS (SELECT source, l, idx, h FROM t WHERE n > 1),
low AS (SELECT b.k, e.l, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx < b.idx // CAST(3 ** e.l AS BIGINT)), '') AS le,
               coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx > b.idx // CAST(3 ** e.l AS BIGINT)), '') AS ri
        FROM base b JOIN every e ON e.source IS NOT DISTINCT FROM b.source AND e.idx // 3 = b.idx // CAST(3 ** (e.l + 1) AS BIGINT) GROUP BY b.k, e.l),
high AS (SELECT b.k, 1000 + u.l AS l, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < s.idx // CAST(3 ** u.l AS BIGINT)), '') AS le,
                coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > s.idx // CAST(3 ** u.l AS BIGINT)), '') AS ri
         FROM base b JOIN sub s ON s.source IS NOT DISTINCT FROM b.source JOIN u ON u.n > 1 AND u.idx // 3 = s.idx // CAST(3 ** (u.l + 1) AS BIGINT) GROUP BY b.k, u.l),
steps AS (SELECT k, list(struct_pack(le := le, ri := ri) ORDER BY l) AS s FROM (FROM low UNION ALL FROM high) GROUP BY k),
fold AS (SELECT b.k, 0 AS i, b.checked AS h, coalesce(s.s, []) AS s FROM base b LEFT JOIN steps s ON s.k = b.k
         UNION ALL SELECT k, i + 1, sha256(s[i + 1].le || h || s[i + 1].ri), s FROM fold WHERE i < len(s))
SELECT b.doc_id, b.leaf, sub.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root,
       sha256(array_to_string([x.le || x.ri FOR x IN f.s], '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM base b JOIN fold f ON f.k = b.k AND f.i = len(f.s) JOIN sub ON sub.source IS NOT DISTINCT FROM b.source
"""
