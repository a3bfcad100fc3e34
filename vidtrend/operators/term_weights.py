"""Exact TF-IDF weights of any number of texts without a shuffled row per occurrence.

Texts are packed into blocks that are written once; a task unpacks a block and counts its n-grams (``_Counted``). Most
n-grams of a corpus stand in one document only, so the document frequencies come in two exchanges. First every block
sends short hashes of its n-grams to ranges of hashes and gets back one bit each: whether another block sent the same
one. An n-gram without that bit, and in one document of its block, has document frequency 1. The others (a few of them
by chance, which changes nothing) are sent as strings and come back with their frequencies. No frequency
depends on a hash.

A weight is at most 1, so the summed weight of a term is at most its document frequency: ``best_terms`` sums only terms
that are frequent enough to reach the places asked for, and lowers that bound until it is proven.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from vidtrend.operators.scale import calendar_broadcast, top_n
from vidtrend.session import cut_lineage, written

#: N-grams of a block (one document may hold more); hashes of a range.
BLOCK_GRAMS, RANGE_HASHES = 1 << 19, 1 << 20
#: The first bound of ``best_terms`` is the frequency of the last place divided by this.
SPARE = 64
_PRIME = np.uint64(0x9E3779B97F4A7C15)


# --- packing --------------------------------------------------------------------------------

def _squeezed(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(pa.py_buffer(np.ascontiguousarray(data)), asbytes=True)


def _expanded(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], size), np.uint8) if size else np.empty(0, np.uint8)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by place of byte: the upper bytes of small ones are equal."""
    return _squeezed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).reshape(-1))


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = _expanded(data).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _packed_strings(strings: pa.Array) -> tuple[bytes, bytes]:
    """Lengths (-1 for null) and bytes."""
    lengths = pc.fill_null(pc.binary_length(strings), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    strings = pc.fill_null(strings, "") if strings.null_count else strings
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    body = strings.buffers()[2]
    return _packed(lengths), _squeezed(np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body else np.empty(0, np.uint8))


def _unpacked_strings(lengths: bytes, body: bytes) -> pa.Array:
    sizes = _unpacked(lengths, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0), dtype=np.int64)]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(_expanded(body)))
    return pc.if_else(pa.array(sizes >= 0), strings, pa.scalar(None, pa.large_string())) if (sizes < 0).any() else strings


def _hashed(strings: pa.Array) -> np.ndarray:
    """64 bits of each string, from running sums of its bytes times powers of an odd number."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    body = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    out, inverse = np.empty(len(strings), np.uint64), np.uint64(pow(int(_PRIME), -1, 1 << 64))
    power = back = np.ones(1, np.uint64)
    for at in range(0, len(strings), 1 << 15):
        own = offsets[at:at + (1 << 15) + 1]
        size = int(own[-1] - own[0])
        if size >= len(power):
            steps = max(size, 2 * len(power), 1 << 20)
            power, back = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(steps, x, np.uint64))]) for x in (_PRIME, inverse)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body[own[0]:own[-1]].astype(np.uint64) + np.uint64(1)) * power[:size], dtype=np.uint64)])
        place = own - own[0]
        out[at:at + len(own) - 1] = (sums[place[1:]] - sums[place[:-1]]) * back[place[:-1]]
    for shift in (31, 29, 32):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


# --- blocks ---------------------------------------------------------------------------------

def _upto(lengths: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.to_numpy())]).astype(np.int64)


def _blocks(by: Sequence[str], low: int, high: int):
    """Arrow function: rows ``*by, doc, runs`` to packed blocks of one period each."""
    most = max(1, BLOCK_GRAMS // (high - low + 1))

    def work(batches):
        from pyspark import TaskContext
        number, pending, kinds = TaskContext.get().partitionId() << 33, {}, None

        def packed(key):
            nonlocal number
            docs, runs = [pa.concat_arrays(column) for column in list(zip(*pending.pop(key)))[:2]]
            per_doc, runs = pc.list_value_length(runs).to_numpy().astype(np.int32), runs.flatten()
            per_run, words = pc.list_value_length(runs).to_numpy().astype(np.int32), runs.flatten().cast(pa.large_string())
            grams = sum(int(np.maximum(per_run - n + 1, 0).sum()) for n in range(low, high + 1))
            number += 1
            values = [number, *key, grams, docs.to_pylist(), _packed(per_doc), _packed(per_run), *_packed_strings(words)]
            types = [pa.int64(), *kinds, pa.int64(), pa.list_(docs.type), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types)],
                                              names=["block", *by, "grams", "docs", "per_doc", "per_run", "lengths", "body"])

        held = lambda key: sum(p[2] for p in pending.get(key, ()))
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch[c].to_pylist() for c in by])):
                places.setdefault(key, []).append(at)
            for key, rows in places.items():
                docs, runs = [batch[c].take(pa.array(rows)) for c in ("doc", "runs")]
                tokens = np.diff(_upto(pc.list_value_length(runs.flatten()))[_upto(pc.list_value_length(runs))])
                upto, at = np.cumsum(tokens), 0
                while at < len(rows):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                    size = int(tokens[at:end].sum())
                    if pending.get(key) and held(key) + size > most:
                        yield packed(key)
                    pending.setdefault(key, []).append((docs.slice(at, end - at), runs.slice(at, end - at), size))
                    at = end
                while sum(map(held, pending)) > 4 * most:
                    yield packed(max(pending, key=held))
        for key in list(pending):
            yield packed(key)

    return work


class _Counted:
    """The distinct terms of a block, their place among the hashes, and ``doc, code, tf`` of each term of each document."""

    def __init__(self, row: dict, low: int, high: int, ranges: int):
        per_doc, per_run = _unpacked(row["per_doc"], np.int32), _unpacked(row["per_run"], np.int32)
        words = _unpacked_strings(row["lengths"], row["body"])
        run, doc = np.repeat(np.arange(len(per_run)), per_run), np.repeat(np.arange(len(per_doc)), per_doc)
        grams, owners = [pa.array([], pa.large_string())], [np.empty(0, np.int64)]
        for n in range(low, min(high, len(words)) + 1):
            count = len(words) - n + 1
            inside = run[:count] == run[n - 1:]
            if n == 1:
                joined, inside = words, inside & words.is_valid().to_numpy(zero_copy_only=False)
            else:
                joined = pc.binary_join_element_wise(*[words.slice(k, count) for k in range(n)], pa.scalar(" ", pa.large_string()), null_handling="skip")
            grams.append(joined.filter(pa.array(inside)))
            owners.append(doc[run[:count][inside]])
        coded = pa.concat_arrays(grams).dictionary_encode()
        self.terms = coded.dictionary
        pairs, self.tf = np.unique(np.concatenate(owners) * len(self.terms) + coded.indices.to_numpy(), return_counts=True)
        self.doc = pairs // max(1, len(self.terms))
        self.code = pairs - self.doc * len(self.terms)
        self.documents, self.ranges, self.own = len(per_doc), ranges, np.bincount(self.code, minlength=len(self.terms))
        hashes = _hashed(self.terms)
        range_of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.place = (range_of << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        self.places, self.at = np.unique(self.place, return_inverse=True)
        self.cuts = self._cuts(self.places)

    def _cuts(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, np.arange(self.ranges + 1, dtype=np.uint64) << np.uint64(32))

    def shared(self, bits: dict[int, bytes]) -> np.ndarray:
        """Numbers of the terms that may stand in several documents, by range; the same in every run over the block."""
        seen = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=self.cuts[r + 1] - self.cuts[r]) for r in sorted(bits)]
        return self.ordered(np.nonzero(np.concatenate([np.empty(0, np.uint8), *seen]).astype(bool)[self.at] | (self.own > 1))[0])

    def ordered(self, codes: np.ndarray) -> np.ndarray:
        return codes[np.argsort(self.place[codes] >> np.uint64(32), kind="stable")]

    def split(self, codes: np.ndarray):
        """``range`` and the terms of it, of numbers ordered by range."""
        cuts = self._cuts(self.place[codes] & ~np.uint64(0xFFFFFFFF))
        for r in range(self.ranges):
            if cuts[r] < cuts[r + 1]:
                yield r, codes[cuts[r]:cuts[r + 1]]


def _dicts(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1), {name: batch[name][at].as_py() for name in ("block", "per_doc", "per_run", "lengths", "body")}


def _keyed(row, by: Sequence[str], count: int) -> list[pa.Array]:
    """The period of a block's row, ``count`` times."""
    at = pa.array(np.zeros(count, np.int64))
    return [pc.take(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, at) for c in (row.column(b) for b in by)]


def _hashes(by: Sequence[str], low: int, high: int, ranges: int):
    def work(batches):
        for row, block in _dicts(batches):
            c = _Counted(block, low, high, ranges)
            held = [r for r in range(ranges) if c.cuts[r] < c.cuts[r + 1]]
            each = [_packed(np.diff((c.places[c.cuts[r]:c.cuts[r + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0))) for r in held]
            columns = [pa.array(held, pa.int32()), pa.array([block["block"]] * len(held), pa.int64()), pa.array(each, pa.binary())]
            yield pa.RecordBatch.from_arrays([*_keyed(row, by, len(held)), *columns], names=[*by, "range", "block", "hashes"])

    return work


def _seen_twice(table: pa.Table) -> pa.Table:
    """A bit for each hash of each block: whether another block sent it."""
    each = [np.cumsum(_unpacked(h, np.uint32), dtype=np.uint32) for h in table["hashes"].to_pylist()]
    _, at, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    twice = np.split(counts[at] > 1, np.cumsum([len(x) for x in each])[:-1])
    return pa.table({"block": table["block"], "range": table["range"], "bits": pa.array([np.packbits(x).tobytes() for x in twice], pa.binary())})


def _bits(table: pa.Table) -> dict[int, bytes]:
    return {r: b for r, b in zip(table["range"].to_pylist(), table["bits"].to_pylist()) if b is not None}


def _shared(by: Sequence[str], low: int, high: int, ranges: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block = next(_dicts(left.to_batches()))
        c, rows = _Counted(block, low, high, ranges), []
        for r, codes in c.split(c.shared(_bits(right))):
            rows.append((r, block["block"], *_packed_strings(c.terms.take(pa.array(codes))), _packed(c.own[codes].astype(np.uint32))))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)]
        return pa.Table.from_arrays([*_keyed(left, by, len(rows)), *columns], names=[*by, "range", "block", "lengths", "body", "own"])

    return work


def _gathered(table: pa.Table) -> tuple[pa.Array, np.ndarray, list[int]]:
    """Distinct strings of the rows of a range, the number of each string sent, and how many each row sent."""
    each = [_unpacked_strings(a, b) for a, b in zip(table["lengths"].to_pylist(), table["body"].to_pylist())]
    coded = pa.concat_arrays(each).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), [len(x) for x in each]


def _frequencies(by: Sequence[str], top: int):
    def work(table: pa.Table) -> pa.Table:
        terms, codes, sizes = _gathered(table)
        own = np.concatenate([_unpacked(x, np.uint32) for x in table["own"].to_pylist()]).astype(np.int64)
        total = np.bincount(codes, own, len(terms)).astype(np.uint32)
        each = [_packed(x) for x in np.split(total[codes], np.cumsum(sizes)[:-1])]
        most = [np.sort(total)[::-1][:top].astype(np.int64).tolist()] + [None] * (len(each) - 1)
        columns = [table["block"], table["range"], pa.array(each, pa.binary()), pa.array(most, pa.list_(pa.int64()))]
        return pa.Table.from_arrays([*[table[b] for b in by], *columns], names=[*by, "block", "range", "df", "most"])

    return work


def _weighed(left: pa.Table, right: pa.Table, low: int, high: int, ranges: int) -> tuple[_Counted, np.ndarray, np.ndarray]:
    """A block's terms, their document frequencies and the weight of each term of each document."""
    _, block = next(_dicts(left.to_batches()))
    c, df = _Counted(block, low, high, ranges), None
    given = sorted((r, d) for r, d in zip(right["range"].to_pylist(), right["df"].to_pylist()) if d is not None)
    df = np.ones(len(c.terms))
    df[c.shared(_bits(right))] = np.concatenate([np.empty(0, np.uint32), *[_unpacked(d, np.uint32) for _, d in given]])
    w = c.tf * (np.log((left["documents"][0].as_py() + 1) / (df + 1)) + 1)[c.code]
    return c, df, w / np.sqrt(np.bincount(c.doc, w * w, c.documents))[c.doc]


def _weights(by: Sequence[str], doc: str, low: int, high: int, ranges: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        c, _, weight = _weighed(left, right, low, high, ranges)
        docs = left["docs"].combine_chunks().flatten().take(pa.array(c.doc))
        columns = [docs, c.terms.take(pa.array(c.code)).cast(pa.string()), pa.array(weight)]
        return pa.Table.from_arrays([*_keyed(left, by, len(weight)), *columns], names=[*by, doc, "term", "weight"])

    return work


def _sums(by: Sequence[str], low: int, high: int, ranges: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        c, df, weight = _weighed(left, right, low, high, ranges)
        total, rows = np.bincount(c.code, weight, len(c.terms)), []
        for r, codes in c.split(c.ordered(np.nonzero(df >= left["least"][0].as_py())[0])):
            rows.append((r, *_packed_strings(c.terms.take(pa.array(codes))), total[codes].tobytes()))
        columns = [pa.array([row[i] for row in rows], k) for i, k in enumerate([pa.int32(), *[pa.binary()] * 3])]
        return pa.Table.from_arrays([*_keyed(left, by, len(rows)), *columns], names=[*by, "range", "lengths", "body", "sums"])

    return work


def _largest(by: Sequence[str], top: int):
    def work(table: pa.Table) -> pa.Table:
        terms, codes, _ = _gathered(table)
        score = np.bincount(codes, np.concatenate([np.frombuffer(x, np.float64) for x in table["sums"].to_pylist()]), len(terms))
        # whatever equals the last place goes on, so ties are settled over all ranges
        keep = np.nonzero(score >= (np.partition(score, -top)[-top] if len(score) > top else -np.inf))[0]
        columns = [terms.take(pa.array(keep)).cast(pa.string()), pa.array(score[keep])]
        return pa.Table.from_arrays([*_keyed(table, by, len(keep)), *columns], names=[*by, "term", "score"])

    return work


# --- operators ------------------------------------------------------------------------------

class _Corpus:
    """Written blocks of a table, and what its blocks must know about each other."""

    def __init__(self, df: DataFrame, doc: str, tokens: Column, low: int, high: int, by: Sequence[str], top: int = 1):
        self.by, self.low, self.high = list(by) or ["_all"], low, high
        dated = df if by else df.withColumn("_all", F.lit(0))
        dated = dated.na.drop(subset=self.by)
        self.periods = dated.groupBy(*self.by).agg(F.count("*").alias("documents"))
        rows = dated.select(*self.by, F.col(f"`{doc}`").alias("doc"), tokens.alias("tokens"))
        self.keys = [f for f in rows.schema.fields if f.name in self.by]
        self.doc = StructField(doc, rows.schema["doc"].dataType)
        self.blocks = self._written(rows)
        grams = self.blocks.groupBy(*self.by).agg(F.sum("grams").alias("n")).agg(F.max("n")).first()[0] or 0
        self.ranges = max(1, -(-grams // RANGE_HASHES))
        self.bits = written(self.blocks.mapInArrow(_hashes(self.by, low, high, self.ranges), self._schema("range int, block bigint, hashes binary"))
                            .groupBy(*self.by, "range").applyInArrow(_seen_twice, "block bigint, range int, bits binary"))
        strings = self._met(self.blocks, self.bits, _shared(self.by, low, high, self.ranges),
                            self._schema("range int, block bigint, lengths binary, body binary, own binary"))
        self.frequencies = written(strings.groupBy(*self.by, "range").applyInArrow(
            _frequencies(self.by, top), self._schema("block bigint, range int, df binary, most array<bigint>")))

    def _schema(self, rest: str | list[StructField]) -> StructType:
        kinds = {"int": IntegerType(), "bigint": LongType(), "binary": BinaryType(), "string": StringType(), "double": DoubleType(), "array<bigint>": ArrayType(LongType())}
        named = [StructField(n, kinds[k]) for n, k in (x.split(" ") for x in rest.split(", "))] if isinstance(rest, str) else rest
        return StructType([*self.keys, *named])

    def _written(self, rows: DataFrame) -> DataFrame:
        """Rows that share an id are one document; only those are shuffled."""
        ids = [*self.by, "doc"]
        shared = cut_lineage(rows.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
        alone = F.array_compact(F.array("tokens")).alias("runs")
        whole = rows.select(*ids, alone)
        if not shared.isEmpty():
            known = shared.select(*[F.col(c).alias(f"_{c}") for c in ids])
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids])
            whole = rows.join(known, same, "left_anti").select(*ids, alone).unionByName(
                rows.join(known, same, "left_semi").groupBy(*ids).agg(F.collect_list("tokens").alias("runs")))
        schema = StructType([StructField("block", LongType()), *self.keys, StructField("grams", LongType()), StructField("docs", ArrayType(self.doc.dataType)),
                             *[StructField(n, BinaryType()) for n in ("per_doc", "per_run", "lengths", "body")]])
        return written(whole.mapInArrow(_blocks(self.by, self.low, self.high), schema))

    def _met(self, blocks: DataFrame, known: DataFrame, work, schema: StructType) -> DataFrame:
        return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(work, schema)

    def _known(self) -> DataFrame:
        return self.bits.select("block", "range", "bits", F.lit(None).cast("binary").alias("df")).unionByName(
            self.frequencies.select("block", "range", F.lit(None).cast("binary").alias("bits"), "df"))

    def weights(self) -> DataFrame:
        blocks = self.blocks.join(calendar_broadcast(self.periods), self.by)
        return self._met(blocks, self._known(), _weights(self.by, self.doc.name, self.low, self.high, self.ranges),
                         self._schema([self.doc, StructField("term", StringType()), StructField("weight", DoubleType())]))

    def best(self, top: int) -> DataFrame:
        most = top_n(self.frequencies.select(*self.by, F.explode("most").alias("n")), self.by, [F.desc("n")], top)
        least = most.groupBy(*self.by).agg(F.when(F.count("*") == top, F.min("n") / SPARE).otherwise(1.0).alias("least"))
        bounds = written(self.periods.join(least, self.by, "left").na.fill(1.0, ["least"]))
        while True:
            sums = self._met(self.blocks.join(calendar_broadcast(bounds), self.by), self._known(), _sums(self.by, self.low, self.high, self.ranges),
                             self._schema("range int, lengths binary, body binary, sums binary"))
            scores = sums.groupBy(*self.by, "range").applyInArrow(_largest(self.by, top), self._schema("term string, score double"))
            best = written(top_n(scores, self.by, [F.desc("score"), F.col("term")], top))
            reached = best.groupBy(*self.by).agg(F.when(F.count("*") == top, F.min("score")).otherwise(0.0).alias("reached"))
            proven = (F.col("least") <= 1) | (F.coalesce("reached", F.lit(0.0)) >= F.col("least"))
            held = bounds.join(reached, self.by, "left")
            if held.filter(~proven).isEmpty():
                return best
            bounds = written(held.withColumn("least", F.when(proven, F.col("least")).otherwise(F.coalesce("reached", F.lit(0.0)) * (1 - 1e-9))).drop("reached"))


def term_weights(df: DataFrame, doc: str, tokens: Column, low: int, high: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, doc, term, weight): smooth idf, each document scaled to unit length; rows that share ``doc`` are one document."""
    return _Corpus(df, doc, tokens, low, high, by).weights().select(*by, doc, "term", "weight")


def best_terms(df: DataFrame, doc: str, tokens: Column, low: int, high: int, top: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, term, score, rank): the ``top`` terms by summed weight (ties by term) of each period, or of the whole table."""
    best = _Corpus(df, doc, tokens, low, high, by, top).best(top)
    return best.select(*by, "term", "score", "rank")
