"""Near-duplicate classes by word shingles: an exact Jaccard join with signature trees.

1. Sets. Each text becomes its set of hashed shingles; equal sets share a fingerprint and are one
   class member from then on.
2. Families. Two sets that link differ in at most k shingles. Shingles are dealt to more than k
   parts by hash, so linked sets agree in a whole part, and in all of a set's filled parts but k: parts
   are equi-join keys. Sizes are cut into levels such that linked sets lie in the same or in neighbouring
   levels; a set emits the parts of both. Keys are combined inside each task first, so a key that very many
   sets share has one row per task. A set that shares fewer keys of a level with others than a link
   needs is linked with nothing and leaves; of the rest, pairs that share enough keys are joined. Keys
   of more than SMALL sets are not paired up but joined by a star. The components are families: every
   link lies inside one family.
3. Trees. Each family gets a signature tree: leaves are sets with their shingle bitmaps, nodes hold
   the OR of the bitmaps below them, the range of sizes and the largest number of shingles that
   share a bit. A dual traversal of the tree with itself drops node pairs whose largest possible
   overlap, min(sizes, common bits + shared-bit excess), is below the overlap that a link needs, and pairs
   already connected; what is left at the leaves is compared exactly.
   A tree over all documents would not prune at its upper nodes, whose bitmaps are full; families are
   what makes the traversal of many documents possible.
4. Large families, mostly sets that share no more than a passage, are dealt again by keys over three times as
   many shingles. What is still large is cut into blocks of bounded size. First every block is traversed
   with itself and a few sets of the whole family; blocks are then dealt anew by the classes found, and only pairs
   that involve sets outside the family's largest class remain. No pair is left out except by the bounds.
5. Classes are the components of the exact links.

Defined results: a text without words (or null) has an empty set and is linked with nothing; fewer
words than a shingle form one shingle. A row without id is returned, linked with nothing, without
class. Rows that repeat an id are linked row by row, and so are equal texts. Ties do not arise: a class
is named by its smallest id. Extra columns are ignored; an empty table gives no rows. Fingerprints
have 64 bits in keys and 128 where equality of sets is decided.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.llm.common import connected_components, slices, stored
from vidtrend.operators.scale import checked_broadcast

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_KEYS = 250_000
FOREST_NODES = 300_000
BLOCK_SETS, BLOCK_TOKENS = 256, 1_000_000
SMALL, STAR = 8, 1 << 20
LEAF, FANOUT = 8, 8
HUB_SETS = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, "u8")])


def _power_table(length: int, base: int) -> np.ndarray:
    return _powers(1 << max(12, (length - 1).bit_length()), base)[:length]


_INVERSE = pow(_BASE, -1, 1 << 64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), "u1")
    inside = np.r_[False, ~_SPACE[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, "u8")
    with np.errstate(over="ignore"):
        # polynomial hash of every word from one running sum over the text
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype("u8") + np.uint64(1)) * _power_table(len(raw), _BASE))]
        words = mix((sums[ends] - sums[starts]) * _power_table(len(raw), _INVERSE)[starts] + (ends - starts).astype("u8"))
        size = min(width, len(words))
        count = len(words) - size + 1
        total = np.full(count, size, "u8")
        for i in range(size):
            total = mix(total * np.uint64(_BASE) + words[i:i + count])
    return np.unique(total)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(tokens ^ np.uint64(salt)).sum(dtype="u8").astype("i8")) for salt in (0xA5A5, 0x5A5A5A5A))


class Levels:
    """Size levels, and the parts of a level, for sets that link from ``num / den`` similarity on."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts, self.known = num, den, [1], {}

    def needed(self, total):
        """Smallest overlap of two sets with ``total`` elements together."""
        return -(-self.num * total // (self.num + self.den))

    def level(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return bisect_right(self.starts, n) - 1

    def parts(self, level: int) -> tuple[int, int]:
        """Largest number of differing shingles of linked sets of a level, and its number of parts."""
        if level not in self.known:
            while len(self.starts) <= level + 1:
                self.level(self.starts[-1])
            most = self.starts[level + 1] - 1
            total = most + most * self.den // self.num
            differ = total - 2 * self.needed(total)
            self.known[level] = differ, 1 if differ == 0 else differ + 1 + differ // 16 + 2
        return self.known[level]

    def needs(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set, and for each how many keys of its level every set that links shares at least.

        A link differs in at most ``differ`` parts, and a filled part that does not differ is a key of
        both. The last bit of a key tells its level from the neighbouring one.
        """
        own, out, need = self.level(len(tokens)), [], []
        with np.errstate(over="ignore"):
            value, place = mix(tokens ^ np.uint64(0x1234567)), mix(tokens ^ np.uint64(0x7654321))
            for level in {own, max(0, own - 1)}:
                differ, parts = self.parts(level)
                at = (place % np.uint64(parts)).astype("i8")
                sums = np.zeros(parts, "u8")
                np.add.at(sums, at, value)
                keys = mix(sums + mix(np.arange(parts, dtype="u8") + np.uint64(level * 1_000_003 + 1)))
                keys = keys & ~np.uint64(1) | np.uint64(level & 1)
                used = np.bincount(at, minlength=parts) > 0
                # sets agree in a part that neither leaves empty unless both fill too few parts
                out.append(keys[used] if used.sum() > differ else keys)
                need.append(np.full(len(out[-1]), max(1, int(used.sum()) - differ)))
        return np.concatenate(out).astype("i8"), np.concatenate(need)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        return self.needs(tokens)[0]

    def strong_keys(self, tokens: np.ndarray) -> np.ndarray:
        """Keys over about three times as many shingles, and three times as many of them.

        With more than ``differ`` / 3 groups of five parts some group differs in two shingles at most, so
        three of its parts agree; every choice of three parts is a key. A group is poor if fewer than
        three of its parts are filled; there are spare groups, so agreement in empty parts alone
        counts only for sets with more poor groups than spare ones.
        """
        own, out = self.level(len(tokens)), []
        with np.errstate(over="ignore"):
            value, place = mix(tokens ^ np.uint64(0x1111111)), mix(tokens ^ np.uint64(0x2222222))
            for level in {own, max(0, own - 1)}:
                differ = self.parts(level)[0]
                needed = differ // 3 + 1
                spare = 1 + needed // 16
                groups = needed + spare
                at = (place % np.uint64(5 * groups)).astype("i8")
                sums = np.zeros(5 * groups, "u8")
                np.add.at(sums, at, value)
                sums = mix(sums + mix(np.arange(5 * groups, dtype="u8"))).reshape(groups, 5)
                used = (np.bincount(at, minlength=5 * groups) > 0).reshape(groups, 5)
                all_keys = (used.sum(1) < 3).sum() > spare
                base = mix(np.arange(groups, dtype="u8") + np.uint64(level * 1_000_003 + 7))
                for number, three in enumerate(combinations(range(5), 3)):
                    keys = mix(base + np.uint64(number))
                    for part in three:
                        keys = mix(keys ^ sums[:, part]) * np.uint64(_BASE)
                    out.append(keys if all_keys else keys[used[:, list(three)].any(1)])
        return np.concatenate(out).astype("i8")


def _chunks(sets, needs_of):
    """Keys, nodes and needs of sets, sorted by key and node; a node is met once in a chunk."""
    parts, size, seen = [], 0, set()
    for node, tokens in sets:
        if node in seen:
            continue
        seen.add(node)
        keys, needs = needs_of(tokens)
        parts.append((keys, np.full(len(keys), node, "i8"), needs))
        size += len(keys)
        if size >= CHUNK_KEYS:
            yield _sorted(*map(np.concatenate, zip(*parts)))
            parts, size, seen = [], 0, set()
    if size:
        yield _sorted(*map(np.concatenate, zip(*parts)))


def _sorted(keys, nodes, *more):
    order = np.lexsort((nodes, keys))
    return [column[order] for column in (keys, nodes, *more)]


def _groups(keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: whether a row is the first of its key, the number of its group, the sizes of the groups."""
    first = np.r_[True, keys[1:] != keys[:-1]]
    group = np.cumsum(first) - 1
    return first, group, np.bincount(group)


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _sums(count, *by) -> list[np.ndarray]:
    """The distinct rows of ``by`` and the sum of ``count`` of each."""
    order = np.lexsort(by[::-1])
    by, count = [c[order] for c in by], count[order]
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in by], axis=0)]) if len(count) else np.zeros(0, "i8")
    return [*[c[first] for c in by], np.add.reduceat(count, first) if len(count) else count]


def _entries(width: int, levels: Levels):
    """Texts to ``key, node, tag`` by the keys of their sets.

    The tag of a key that one set of the chunk has is the set's need. A key that several sets have is
    written once with tag 0, and each of these sets has one row for all such keys of a level: their
    number, times 2 ** 32, plus the need.
    """
    def sets(batches):
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                tokens = shingles(text, width)
                if len(tokens):
                    yield fingerprint(tokens)[0], tokens

    def work(batches):
        for keys, nodes, needs in _chunks(sets(batches), levels.needs):
            first, group, size = _groups(keys)
            alone = size[group] == 1
            yield _batch((keys[first], nodes[first], np.where(alone, needs, 0)[first]), ["key", "node", "tag"])
            node, odd, need, count = _sums(np.ones((~alone).sum(), "i8"), nodes[~alone], keys[~alone] & 1, needs[~alone])
            yield _batch(((node & ~1) | odd, node, need + (count << 32)), ["key", "node", "tag"])
    return work


def _shared(batches):
    """Entries sorted by key and node to ``node, odd, need, count``: how many keys a set shares with others."""
    held = [np.zeros(0, "i8")] * 3  # the last key: its only node so far, or tag 0 once it is shared
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        counted = rows[2] >> 32 > 0
        out = [[rows[1][counted], rows[0][counted] & 1, rows[2][counted] & 0xFFFFFFFF, rows[2][counted] >> 32]]
        keys, nodes, tags = [np.r_[h, c[~counted]] for h, c in zip(held, rows)]
        if len(keys):
            group = _groups(keys)[1]
            other = np.r_[False, (keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1])]
            shared = np.bincount(group, other | (tags == 0)) > 0
            again = np.r_[False, (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1]) & (tags[:-1] > 0)]
            hit = shared[group] & (tags > 0) & ~again
            out.append([nodes[hit], keys[hit] & 1, tags[hit], np.ones(hit.sum(), "i8")])
            held = [keys[-1:], nodes[-1:], np.where(shared[-1:], 0, tags[-1:])]
        node, odd, need, count = map(np.concatenate, zip(*out))
        yield _batch(_sums(count, node, odd, need), ["node", "odd", "need", "count"])


def _live_entries(levels: Levels):
    """Rows ``node, tokens`` to ``key, node, need, leader``; keys of more than SMALL sets of a chunk have one row.

    That row names itself as leader, and the other sets have a row that points to it.
    """
    names = ["key", "node", "need", "leader"]

    def work(batches):
        for keys, nodes, needs in _chunks(_token_sets(batches), levels.needs):
            first, group, size = _groups(keys)
            many = size[group] > SMALL
            lead = nodes[np.flatnonzero(first)][group]
            row = pa.RecordBatch.from_arrays(
                [pa.array(c[~many | first], pa.int64()) for c in (keys, nodes, needs)]
                + [pa.array(lead[~many | first], pa.int64(), mask=~many[~many | first])], names=names)
            yield row
            pairs = np.unique(np.stack([nodes[many & ~first], lead[many & ~first]]), axis=1)
            yield _batch((pairs[0], pairs[0], np.zeros(pairs.shape[1], "i8"), pairs[1]), names)
    return work


def _pairs(batches):
    """Entries sorted by key and node to ``a, b, odd, need, count``: how many keys two sets share.

    Sets of a key that more than SMALL sets share have as many as any link needs with the key's first set.
    """
    def star(a, b):
        return [a, b, np.zeros(len(a), "i8"), np.zeros(len(a), "i8"), np.full(len(a), STAR)]

    def pairs(keys, nodes, needs, many):
        first, group, size = _groups(keys)
        large = ((np.bincount(group, many) > 0) | (size > SMALL))[group]
        rest = large & ~first
        out = [star(nodes[np.flatnonzero(first)][group][rest], nodes[rest])]
        for step in range(1, SMALL):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & ~large[step:])
            out.append([nodes[at], nodes[at + step], keys[at] & 1, np.maximum(needs[at], needs[at + step]), np.ones(len(at), "i8")])
        return out

    def total(out):
        a, b, odd, need, count = map(np.concatenate, zip(*out))
        return _batch(_sums(count, a, b, odd, need), ["a", "b", "odd", "need", "count"])

    held = [np.zeros(0, "i8")] * 3 + [np.zeros(0, bool)]
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns[:3]]
        leads = np.asarray(batch.column(3).fill_null(0))
        pointed = np.asarray(batch.column(3).is_valid())
        other = pointed & (leads != rows[1])
        out = [star(leads[other], rows[1][other])]
        keys, nodes, needs, many = [np.r_[h, c[~other]] for h, c in zip(held, (*rows, pointed))]
        if len(keys):
            # copies of a set in several chunks are one
            again = np.r_[False, (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])]
            many = np.bincount(np.cumsum(~again) - 1, many) > 0
            keys, nodes, needs = keys[~again], nodes[~again], needs[~again]
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            held = [c[cut:] for c in (keys, nodes, needs, many)]
            if cut:
                out += pairs(*[c[:cut] for c in (keys, nodes, needs, many)])
            if len(held[0]) > SMALL or held[3].any():  # the first set stands for the key from here on
                out += pairs(*held[:3], np.ones(len(held[0]), bool))
                held = [*[c[:1] for c in held[:3]], np.ones(1, bool)]
        yield total(out)
    if len(held[0]):
        yield total(pairs(*held))


def _strong_entries(levels: Levels):
    """Rows ``node, tokens`` to ``key, node, leader`` by the stronger keys."""
    return lambda batches: _keyed(_token_sets(batches), levels.strong_keys)


def _token_sets(batches):
    for batch in slices(batches, 64):
        for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield node, np.frombuffer(tokens, "u8")


def _keyed(sets, keys_of):
    """One entry per key and chunk of a task; further sets of a key point to it."""
    def flush(keys, nodes):
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        lead = nodes[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        rest = ~first & (nodes != lead)
        pairs = np.unique(np.stack([nodes[rest], lead[rest]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(nodes[first]), pa.nulls(int(first.sum()), pa.int64())],
                                         names=["key", "node", "leader"])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "node", "leader"])

    keys, nodes, size, seen = [], [], 0, set()
    for node, tokens in sets:
        if node in seen:
            continue
        seen.add(node)
        own = keys_of(tokens)
        keys.append(own)
        nodes.append(np.full(len(own), node, "i8"))
        size += len(own)
        if size >= CHUNK_KEYS:
            yield from flush(keys, nodes)
            keys, nodes, size, seen = [], [], 0, set()
    if size:
        yield from flush(keys, nodes)


class Forest:
    """Classes of node ids met in a task, each named by its smallest node; stars are what leaves the task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, i: int) -> int:
        root = i
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(i, i)) != root:
            self.parent[i] = root
            i = up
        return root

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def stars(self) -> pa.RecordBatch:
        nodes = list(self.parent)
        roots = [self.find(i) for i in nodes]
        return pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def _stars(batches):
    """Entries sorted by key to edges ``a, b``: classes of the sets that share a key in this task."""
    last_key = last_node = None
    forest = Forest()
    for batch in batches:
        if not batch.num_rows:
            continue
        leader = batch.column(2)
        ready = np.asarray(leader.is_valid())
        keys, nodes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if ready.any():
            for i, j in zip(leader.filter(pa.array(ready)).to_pylist(), nodes[ready].tolist()):
                forest.join(i, j)
        keys, nodes = keys[~ready], nodes[~ready]
        if len(keys):
            first = np.r_[keys[0] != last_key, keys[1:] != keys[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
            lead = np.where(at >= 0, nodes[np.maximum(at, 0)], last_node if last_node is not None else 0)
            rest = nodes != lead
            for i, j in zip(lead[rest].tolist(), nodes[rest].tolist()):
                forest.join(i, j)
            last_key, last_node = keys[-1], lead[-1]
        if len(forest.parent) > FOREST_NODES:
            yield forest.stars()
            forest = Forest()
    yield forest.stars()


class Tree:
    """Sets ordered by size; each node has the OR of the bitmaps below it, a size range and an excess."""

    def __init__(self, tokens: list[np.ndarray], width: int):
        self.order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        self.tokens = [tokens[i] for i in self.order]
        size = np.array([len(t) for t in self.tokens])
        bits = np.zeros((len(size), width // 8), "u1")
        for i, own in enumerate(self.tokens):
            flat = np.zeros(width, bool)
            flat[(own % np.uint64(width)).astype("i8")] = True
            bits[i] = np.packbits(flat)
        bits = bits.view("u8")
        excess = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def children(self, depth: int, node: int) -> range:
        step = LEAF if depth == 1 else FANOUT
        return range(node * step, min((node + 1) * step, len(self.levels[depth - 1][1])))


class Classes:
    """Disjoint sets of small integers."""

    def __init__(self, start):
        self.parent = list(start)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def traverse(left: Tree, right: Tree, levels: Levels, classes: Classes, left_ids, right_ids) -> list[tuple[int, int]]:
    """Links that connect two classes, by dual traversal; ids are positions in ``classes``."""
    links, same = [], left is right
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        a, b, i, j = stack.pop()
        bits_a, low_a, high_a, excess_a = left.levels[a]
        bits_b, low_b, high_b, excess_b = right.levels[b]
        common = np.bitwise_count(bits_a[i][:, None, :] & bits_b[j][None, :, :]).sum(2, dtype="i8")
        reach = np.minimum(common + np.minimum(excess_a[i][:, None], excess_b[j][None, :]),
                           np.minimum(high_a[i][:, None], high_b[j][None, :]))
        open_ = reach >= levels.needed(low_a[i][:, None] + low_b[j][None, :])
        for p, q in zip(*np.nonzero(open_)):
            m, n = int(i[p]), int(j[q])
            if same and a == b and m > n:
                continue
            if a == 0 and b == 0:
                x, y = left_ids[left.order[m]], right_ids[right.order[n]]
                if classes.find(x) == classes.find(y):
                    continue
                one, two = left.tokens[m], right.tokens[n]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= levels.needed(len(one) + len(two)):
                    classes.join(x, y)
                    links.append((x, y))
            elif a >= b and a > 0:
                down = np.array(left.children(a, m))
                if same and a == b:  # both go down together, so that each pair is met once
                    stack.append((a - 1, b - 1, down, np.array(right.children(b, n))))
                else:
                    stack.append((a - 1, b, down, np.array([n])))
            else:
                stack.append((a, b - 1, np.array([m]), np.array(right.children(b, n))))
    return links


def bitmap_width(sets: list[np.ndarray]) -> int:
    return min(1 << 16, max(64, 1 << (4 * max(map(len, sets)) - 1).bit_length()))


def _load(members) -> tuple[list[int], list[int], list[np.ndarray]]:
    return ([m["node"] for m in members], [m["class"] for m in members], [np.frombuffer(m["tokens"], "u8") for m in members])


def link_sets(one, other, levels: Levels) -> list[tuple[int, int]]:
    """Node pairs that link classes of one block, or of two blocks if ``other`` is given."""
    nodes, known, sets = _load(one)
    if other is not None:
        more = _load(other)
        nodes, known, sets = nodes + more[0], known + more[1], sets + more[2]
    if len(nodes) < 2:
        return []
    first = {}
    classes = Classes([first.setdefault(c, i) for i, c in enumerate(known)])
    width, cut = bitmap_width(sets), len(one)
    left = Tree(sets[:cut], width)
    ids = list(range(len(nodes)))
    if other is None:
        found = traverse(left, left, levels, classes, ids, ids)
    else:
        found = traverse(left, Tree(sets[cut:], width), levels, classes, ids[:cut], ids[cut:])
    return [(nodes[a], nodes[b]) for a, b in found]


def _link_blocks(levels: Levels):
    def work(batches):
        for batch in batches:
            forest = Forest()
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for a, b in link_sets(row["members"], row.get("others"), levels):
                    forest.join(a, b)
            yield forest.stars()
    return work


def _blocks(sets: DataFrame, *keep: str) -> DataFrame:
    """Rows ``family, block`` with the list of their sets; a block holds about BLOCK_SETS sets."""
    # dealt by both columns: a join by family before this would leave a large family in one task
    return sets.repartition("family", "block").groupBy("family", "block", *keep).agg(
        F.collect_list(F.struct("node", "class", "tokens")).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.min("class").alias("class_low"), F.max("class").alias("class_high"))


def _block_count(count, tokens):
    return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(tokens / BLOCK_TOKENS)).cast("bigint")


def _families(entries: DataFrame) -> DataFrame:
    """``node, family`` of all sets that share a key with another."""
    edges = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_stars, "a bigint, b bigint")
    return connected_components(edges, "a", "b").withColumnRenamed("component", "family")


def _live(entries: DataFrame) -> DataFrame:
    """``node`` of the sets that share as many keys of a level with other sets as a link needs."""
    shared = entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        _shared, "node bigint, odd bigint, need bigint, count bigint")
    counts = shared.groupBy("node", "odd").agg(F.max("need").alias("need"), F.sum("count").alias("count"))
    return counts.filter("count >= need").select("node").distinct()


def _paired_families(entries: DataFrame) -> DataFrame:
    """``node, family`` of all sets that share as many keys with one other as a link needs."""
    shared = entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        _pairs, "a bigint, b bigint, odd bigint, need bigint, count bigint")
    counts = shared.groupBy("a", "b", "odd").agg(F.max("need").alias("need"), F.sum("count").alias("count"))
    return connected_components(counts.filter("count >= need").select("a", "b"), "a", "b").withColumnRenamed("component", "family")


def _with_blocks(members: DataFrame) -> DataFrame:
    """Adds the number of blocks that a family of ``family, node, n`` needs, and its number of sets."""
    size = members.groupBy("family").agg(_block_count(F.count("*"), F.sum("n")).alias("blocks"), F.count("*").alias("count"))
    return members.join(size, "family")


def _linked(blocks: DataFrame, levels: Levels) -> DataFrame:
    return blocks.mapInArrow(_link_blocks(levels), "a bigint, b bigint")


def family_links(sets: DataFrame, levels: Levels) -> DataFrame:
    """Exact links ``a, b`` inside families that connect their classes.

    ``sets`` is a written table ``family, blocks, count, node, n, tokens``. Families of one block are
    traversed at once; the others are dealt again by stronger keys, which part sets that share no more than
    a passage; what is still large after that is traversed block by block.
    """
    sets = sets.withColumn("class", F.col("node")).withColumn("block", F.lit(0).cast("bigint"))
    links = _linked(_blocks(sets.filter("blocks = 1")).select("members"), levels)
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        return stored(links, "links")
    again = stored(_families(large.select("node", "tokens").mapInArrow(
        _strong_entries(levels), "key bigint, node bigint, leader bigint")), "families")
    dealt = stored(_with_blocks(again.join(large.select("node", "n").distinct(), "node")), "dealt")
    parted = large.drop("family", "blocks", "count", "n").join(checked_broadcast(dealt), "node")
    links = links.unionByName(_linked(_blocks(parted.filter("blocks = 1")).select("members"), levels))
    if dealt.filter("blocks > 1").isEmpty():
        return stored(links, "links")
    huge = stored(parted.filter("blocks > 1"), "huge")
    # first round: every block with itself and with the family's hub, about HUB_SETS sets sent to all blocks
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("count")) < HUB_SETS
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    spread = huge.withColumn("block", F.explode(F.when(hub, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))))
    links = stored(links.unionByName(_linked(_blocks(spread).select("members"), levels)), "links")
    # second round: blocks by class, and no pairs inside the largest class of a family
    classes = stored(connected_components(links, "a", "b"), "classes")
    classed = stored(dealt.filter("blocks > 1").join(classes, "node", "left").select(
        "family", "node", "n", F.coalesce("component", "node").alias("class")), "classed")
    per = classed.groupBy("family", "class").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    main = per.groupBy("family").agg(F.max_by("class", F.struct("c", "class")).alias("main"))
    rest = (per.join(main, "family").filter("class <> main").groupBy("family")
            .agg(_block_count(F.sum("c"), F.sum("t")).alias("rest_blocks")))
    core = per.join(main, "family").filter("class = main").select("family", "main", _block_count(F.col("c"), F.col("t")).alias("main_blocks"))
    placed = classed.join(core, "family").join(rest, "family").select("node", "class", F.when(
        F.col("class") == F.col("main"), F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks")))
        .otherwise(F.pmod(F.xxhash64("node"), F.col("rest_blocks"))).alias("block"), "rest_blocks")
    placed = stored(placed, "placed")
    if placed.isEmpty():
        return links
    blocks = stored(_blocks(huge.drop("class", "block").join(checked_broadcast(placed), "node"), "rest_blocks"), "blocks")
    pick = lambda df, name: df.select("family", F.col("block").alias(f"{name}_block"), F.col("members").alias(name))
    outside = blocks.filter("block < rest_blocks")
    inner = _linked(outside.select("members"), levels)
    # pairs of summaries first: sizes that cannot link, or a single common class, need no lists
    head = blocks.select("family", "block", "low", "high", "class_low", "class_high")
    pair = (outside.select("family", F.col("block").alias("one"), F.col("low").alias("l1"), F.col("high").alias("h1"),
                           F.col("class_low").alias("c1"), F.col("class_high").alias("d1"))
            .join(head, "family").filter("block > one")
            .filter(f"greatest(low, l1) * {levels.num} <= least(high, h1) * {levels.den} OR (low <= h1 AND l1 <= high)")
            .filter("NOT (class_low = class_high AND c1 = d1 AND c1 = class_low)").select("family", "one", "block"))
    cross = (pair.join(pick(outside, "members").withColumnRenamed("members_block", "one"), ["family", "one"])
             .join(pick(blocks, "others").withColumnRenamed("others_block", "block"), ["family", "block"]))
    return links.unionByName(stored(inner.unionByName(_linked(cross.select("members", "others"), levels)), "links"))


def near_duplicates(docs: DataFrame, id_col: str, text: str, width: int = 3, similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """``id, n_shingles, component_id`` of each row; texts link from ``similarity`` (a fraction) on."""
    levels = Levels(*similarity)
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def prints(batches):
        for batch in slices(batches):
            rows = []
            for value in batch.column(1).to_pylist():
                tokens = shingles(value, width)
                rows.append((len(tokens), *fingerprint(tokens)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "node", "check"])

    printed = stored(ids.mapInArrow(prints, "id bigint, n bigint, node bigint, check bigint"), "prints")
    named = printed.filter("n > 0 AND id IS NOT NULL")
    firsts = stored(named.groupBy("node", "check", "n").agg(F.min("id").alias("first")), "firsts")

    live = stored(_live(ids.filter("id IS NOT NULL").select("text").mapInArrow(
        _entries(width, levels), "key bigint, node bigint, tag bigint")), "live")
    wanted = live.join(firsts, "node").select("node", "check", F.col("first").alias("id"))

    def tokenise(batches):
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                tokens = shingles(row["text"], width)
                if fingerprint(tokens) == (row["node"], row["check"]):  # an id may stand at several texts
                    out.append((row["node"], len(tokens), tokens.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else ([],) * 3, kinds)],
                                             names=["node", "n", "tokens"])

    sets = stored(ids.join(checked_broadcast(stored(wanted, "wanted")), "id").mapInArrow(
        tokenise, "node bigint, n bigint, tokens binary"), "sets")
    families = stored(_paired_families(sets.select("node", "tokens").mapInArrow(
        _live_entries(levels), "key bigint, node bigint, need bigint, leader bigint")), "families")
    placed = stored(_with_blocks(families.join(sets.select("node", "n").distinct(), "node")).drop("n"), "placed")
    placed = sets.join(checked_broadcast(placed), "node").select("family", "blocks", "count", "node", "n", "tokens")
    classes = connected_components(family_links(stored(placed, "sets"), levels), "a", "b")
    by_set = firsts.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = by_set.groupBy("class").agg(F.min("first").alias("component_id"))
    by_set = stored(by_set.join(smallest, "class").select("node", "check", "n", "component_id"), "by-set")
    linked = named.join(by_set, ["node", "check", "n"]).select("id", "n", "component_id")
    alone = printed.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                     ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(other) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""
