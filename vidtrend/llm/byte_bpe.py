"""Byte-level BPE: encoding and decoding with the ranks of a public tokenizer.

A text is cut into words by the tokenizer's pattern. The words of a batch of texts that are not yet
known are encoded together: their bytes lie in one flat integer array, and each fold step looks up
the rank of every neighbouring pair in the rank map, merges in each word the leftmost pair of lowest
rank, and goes on with the words that still merge. So the merges are those of one word at a time,
while a step costs a few array operations for all words. Words longer than ``LONG_WORD`` bytes keep
their pairs in a heap instead, which stays near linear. Encoded words are remembered in a table of
bounded size per task. Decoding concatenates the byte strings of the ids.

The rank map and the pieces have the size of the vocabulary, whatever the data; they travel with the
task. There is no shuffle; each text is whole, by itself.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the
empty string. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vidtrend.llm.common import numbered, slices

REMEMBERED = 100_000
LONG_WORD = 64

#: White space as the pattern's \s means it (fixed values: the Unicode property White_Space).
WHITE = r"\t\n\x0b\f\r \x85\xa0  -     　"


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a tokenizer file: a base64 piece and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def splitter(pattern: str):
    """``findall`` of a tokenizer pattern with Unicode classes."""
    import regex
    # the alternatives of this pattern begin with different characters, so the commonest may come first
    endings, words = r"'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+| ?\p{N}+|"
    if pattern.startswith(endings + words):
        pattern = words + endings + pattern[len(endings + words):]
    # \s of the tokenizer is the White_Space property and nothing else
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}\\p{{L}}\\p{{N}}]")
    spelled = spelled.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled).findall


class Merger:
    """Ranked merges over byte arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], "<i4")
        self.pieces = {v: k for k, v in ranks.items()}
        self.width = max(ranks.values()) + 1
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        # open addressing by the low bits of a product: a pair is found in one or two array reads
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, "i8")
        self.slot_rank = np.full(size, self.width, "<i4")
        left_keys, left_ranks = np.array(list(pairs), "i8"), np.array(list(pairs.values()), "<i4")
        self.probes, at = 0, self._slot(left_keys)
        while len(left_keys):
            free = self.slot_key[at] < 0
            first = np.zeros(len(at), bool)
            spots, places = np.unique(at[free], return_index=True)
            first[np.flatnonzero(free)[places]] = True
            self.slot_key[at[first]], self.slot_rank[at[first]] = left_keys[first], left_ranks[first]
            left_keys, left_ranks, at = left_keys[~first], left_ranks[~first], (at[~first] + 1) % size
            self.probes += 1

        self.byte_pairs = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("i8")

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype("i8") * self.width + b
        at = self._slot(keys)
        found = np.where(self.slot_key[at] == keys, self.slot_rank[at], self.width)
        open_ = np.flatnonzero((found == self.width) & (self.slot_key[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.slot_key)
            held = self.slot_key[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def fold(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                out[i] = self.long_word(word)
            else:
                rest.append(i)
        lengths = np.array([len(words[i]) for i in rest], "i8")
        raw = np.frombuffer(b"".join(words[i] for i in rest), "u1")
        tokens, own = self.single[raw], np.repeat(np.arange(len(rest)), lengths)
        if not len(tokens):
            return out
        # ranks[i]: of the pair (i, i + 1); ``width`` where the word ends or the pair does not merge
        ranks = np.full(len(tokens), self.width, "i8")
        ranks[:-1] = np.where(own[1:] == own[:-1], self.byte_pairs[raw[:-1], raw[1:]], self.width)
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            count = np.diff(np.r_[starts, len(tokens)])
            lowest = np.minimum.reduceat(ranks << 32 | np.arange(len(tokens)), starts)
            merging = lowest < self.width << 32
            done = starts[~merging]
            flat = tokens.tobytes()
            for k, low, high in zip(own[done].tolist(), (4 * done).tolist(), (4 * (done + count[~merging])).tolist()):
                out[rest[k]] = flat[low:high]
            at = lowest[merging] & 0xFFFFFFFF
            tokens[at] = (lowest[merging] >> 32).astype("<i4")
            stay = np.repeat(merging, count)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            tokens, own, ranks = tokens[stay], own[stay], ranks[stay]
            if not len(at):
                break
            for left in (at[at > 0] - 1, at):  # only pairs beside a merge have changed
                right = np.minimum(left + 1, len(tokens) - 1)
                same = (right > left) & (own[right] == own[left])
                ranks[left] = self.width
                left, right = left[same], right[same]
                ranks[left] = self.pair_ranks(tokens[left], tokens[right])
        return out

    def long_word(self, word: bytes) -> bytes:
        ids = self.single[np.frombuffer(word, "u1")].tolist()
        after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        rank = lambda i: self.ranks.get(self.pieces[ids[i]] + self.pieces[ids[after[i]]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue  # an entry of before a merge
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([t for t, on in zip(ids, alive) if on], "<u4").tobytes()


def encoder(ranks: dict[bytes, int], pattern: str):
    """Factory of ``texts -> ids of each text`` for one task."""
    def make():
        merger, split, known = Merger(ranks), splitter(pattern), {}

        def encode(texts: Sequence[str]) -> list[bytes]:
            parts = [split(text) for text in texts]
            seen = set(chain.from_iterable(parts))
            order = list(seen.difference(known))
            if len(known) + len(order) > REMEMBERED:
                known.clear()
                order = list(seen)
            known.update(zip(order, merger.fold([w.encode() for w in order])))
            return [b"".join(map(known.__getitem__, words)) for words in parts]
        return encode
    return make


def decoder(ranks: dict[bytes, int]):
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return lambda ids: b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, text: str, keep: Sequence[str], ranks: dict[bytes, int], pattern: str,
           ids: str = "ids", group: int = 256) -> DataFrame:
    """``keep`` columns with the ids of each text, as little-endian unsigned 32-bit integers."""
    kept, names = numbered(docs, keep, text), [*keep, ids]
    make = encoder(ranks, pattern)

    def work(batches):
        run = make()
        for batch in slices(batches, group):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run(texts), pa.binary())], names=names)

    return kept.mapInArrow(work, StructType([*[docs.schema[c] for c in keep], StructField(ids, BinaryType())]))


def decode(encoded: DataFrame, ids: str, ranks: dict[bytes, int], decoded: str = "decoded") -> DataFrame:
    """The bytes that the ids stand for, beside the other columns."""
    make = lambda: decoder(ranks)
    at = encoded.columns.index(ids)

    def work(batches):
        run = make()
        for batch in slices(batches, 64):
            values = [run(i or b"") for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())],
                                             names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(work, StructType([*encoded.schema.fields, StructField(decoded, BinaryType())]))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Number of ids and the digests of ids and decoded bytes, in place of the bytes."""
    return encoded.withColumns({
        "n_tokens": (F.octet_length(ids) / 4).cast("bigint"), "ids_sha256": F.sha2(ids, 256),
        "decoded_sha256": F.sha2(decoded, 256)}).drop(decoded)


