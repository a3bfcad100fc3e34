"""Quality rules from compression: zstandard ratios must lie in a band that depends on the length.

Repetitive text compresses too well, random text not at all. The ratio compressed / raw bytes is
taken over the whole document and over chunks of two sizes; the allowed band narrows with the
length, because short texts carry the frame and long ones repeat vocabulary. Chunks of each size
cover every byte: what is left at the end is a chunk with the band of its own length (or joins the
chunk before it when it is too short to be told from noise), and a shorter text is one chunk. A
text fails when its whole ratio leaves its band, or when too many of its chunks of one size
leave theirs: more than ``chunk_share`` of them, more than one and one of each ``chunk_every``, or
more in a row than ``run_bytes`` hold (one is never a run). Large chunks see repeats that lie far apart, small ones see junk that a
large chunk would average away. Simple counts over words and lines come with the verdict; a text that fails their base rule
is not kept whatever its ratios.

Each text is read whole and by itself in a task: no shuffle, nothing collected.

Defined results: a null text counts as empty; an empty text has zero counts, ratio 1 and fails the
base rule. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import compress

from pyspark.sql import DataFrame

from vidtrend.llm.common import map_texts

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Allowed ratios: ``(smallest bytes, lowest, highest)`` per length, of texts and of chunks.

    The limits lie just outside the ratios of the clean labelled documents of each length; the highest
    of a chunk below ``chunk_bytes`` lies between those and random letters and digits of that length.
    No chunk of a clean labelled document is outside, so one by chance is allowed and few more.
    """

    by_length: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (256, 0.50, 0.85), (512, 0.48, 0.80), (1024, 0.455, 0.75), (2048, 0.44, 0.72),
        (4096, 0.418, 0.70), (8192, 0.405, 0.70), (16384, 0.39, 0.70), (32768, 0.375, 0.70), (131072, 0.34, 0.70))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.44, 0.72)
    small_bytes: int = 512
    least_rest: int = 256
    by_chunk: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (128, 0.53, 0.94), (192, 0.58, 0.86), (256, 0.53, 0.85), (320, 0.53, 0.82), (384, 0.51, 0.79),
        (512, 0.48, 0.76), (768, 0.47, 0.74), (1024, 0.45, 0.73), (1536, 0.44, 0.72))
    chunk_share: float = 0.25
    chunk_every: int = 64
    run_bytes: int = 1024
    level: int = 3


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines that repeat an earlier one, words in repeated triples."""
    raw = text.encode()
    words = raw.split()  # bytes split at \x20 and \x09 to \x0D only
    n = len(words)
    characters = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return n, characters, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    triples = list(zip(words, words[1:], words[2:]))
    counts = Counter(triples)
    if len(counts) == len(triples):
        return 0
    inside = bytearray(len(words))
    for i in compress(range(len(triples)), [counts[t] > 1 for t in triples]):
        inside[i] = inside[i + 1] = inside[i + 2] = 1
    return sum(inside)


def cuts(length: int, size: int, least_rest: int) -> list[tuple[int, int]]:
    """Ends of chunks of ``size`` that cover all bytes; a rest under ``least_rest`` joins the last."""
    starts = list(range(0, length, size))
    if len(starts) > 1 and length - starts[-1] < least_rest:
        starts.pop()
    return list(zip(starts, [*starts[1:], length]))


def longest_run(flags: Sequence[bool]) -> int:
    best = run = 0
    for flag in flags:
        run = run + 1 if flag else 0
        best = max(best, run)
    return best


def measurer(bands: Bands):
    """Factory of ``raw bytes -> (ratio, chunks, chunks outside their band, inside all bands)``.

    Chunks of both sizes are counted; a text that is one small chunk is counted once.
    """
    def make():
        import zstandard
        press = zstandard.ZstdCompressor(level=bands.level).compress
        chunk_bands = [(bands.chunk_bytes, *bands.chunk), *reversed(bands.by_chunk)]

        def leaves(raw: bytes, begin: int, end: int) -> bool:
            size = end - begin
            _, low, high = next(b for b in chunk_bands if size >= b[0])
            return not low <= len(press(raw[begin:end])) / size <= high

        def measure(raw: bytes) -> tuple[float, int, int, bool]:
            if not raw:
                return 1.0, 0, 0, True
            ratio = len(press(raw)) / len(raw)
            _, low, high = next(b for b in reversed(bands.by_length) if len(raw) >= b[0])
            good, chunks, outside = low <= ratio <= high, 0, 0
            for size in (bands.chunk_bytes, bands.small_bytes):
                ends = cuts(len(raw), size, bands.least_rest)
                if size == bands.small_bytes and len(ends) == 1:
                    break  # the same chunk as before
                out = [leaves(raw, *e) for e in ends]
                good = (good and sum(out) <= min(bands.chunk_share * len(out), 1 + len(out) / bands.chunk_every)
                        and longest_run(out) <= max(1, bands.run_bytes // size))
                chunks, outside = chunks + len(out), outside + sum(out)
            return ratio, chunks, outside, good
        return measure
    return make


COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_chunks_outside bigint")


def compression_rules(docs: DataFrame, text: str, keep: Sequence[str], bands: Bands = Bands()) -> DataFrame:
    """``keep`` columns with the base counts, the ratios and the verdict of each text."""
    make = measurer(bands)

    def per_text():
        measure = make()

        def run(text):
            counts = base_counts(text)
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            ratio, chunks, outside, good = measure(text.encode())
            return *counts, failed, not failed and good, ratio, chunks, outside
        return run

    return map_texts(docs, list(keep), text, per_text, COLUMNS)
