"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick lists every vocabulary piece inside a word; dynamic programming over the end positions
carries only the best score and the number of pieces on that path. The rules are those of the
public unigram tokenizers: scores are summed as doubles from the left; of equal sums the path whose
last piece starts first stays; a character that no one-character piece covers may stand as unknown at the lowest
score minus 10; a run of unknown characters counts once, or as its UTF-8 bytes where the vocabulary
has all byte pieces. Words are cut before each space, which is written as U+2581, and one such mark
is put in front of the text.

Counts of distinct words are remembered in a table of bounded size per task, so a word that a text
repeats costs one lookup. Whole texts are read, each by itself: there is no shuffle.

Defined results: a null or empty text has no tokens and no words. Repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame

from vidtrend.llm.common import map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000


def read_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the id of the unknown piece, of a sentencepiece file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


def counter(pieces: Sequence[tuple[str, float]], unknown: int):
    """Factory of ``word -> (pieces, score)`` for one task."""
    pieces = list(pieces)
    lowest = min(score for _, score in pieces)
    bytewise = {p for p, _ in pieces} >= {f"<0x{b:02X}>" for b in range(256)}

    def make():
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        rest = lowest - UNKNOWN_PENALTY
        ring = max(len(piece) for piece, _ in pieces) + 1

        def count(word: str) -> tuple[int, float]:
            matches = automaton.iter(word)
            match = next(matches, None)
            # rings over the last end positions, as no piece is longer
            best, number, odd = [0.0] * ring, [0] * ring, [False] * ring
            for end in range(1, len(word) + 1):
                top, length, one = None, 0, False
                while match is not None and match[0] < end:
                    size, score = match[1]
                    value = best[(end - size) % ring] + score
                    if top is None or value > top or (value == top and size > length):
                        top, length = value, size
                    one = one or size == 1
                    match = next(matches, None)
                here, last = end % ring, (end - 1) % ring
                unknown_here = not one and (top is None or best[last] + rest > top)
                if not unknown_here:
                    pieces_here = number[(end - length) % ring] + 1
                elif bytewise:
                    top, pieces_here = best[last] + rest, number[last] + len(word[end - 1].encode())
                else:
                    top, pieces_here = best[last] + rest, number[last] + (not odd[last])
                best[here], number[here], odd[here] = top, pieces_here, unknown_here
            return number[len(word) % ring], best[len(word) % ring]

        return count
    return make


def words_of(text: str) -> list[str]:
    """The marked words of a text."""
    if not text:
        return []
    text = text.replace(" ", MARK)
    return (text[1:] if text[0] == MARK else text).split(MARK)


def token_counts(docs: DataFrame, text: str, keep: Sequence[str], pieces, unknown: int) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``n_words`` and ``best_score`` of each text."""
    make = counter(pieces, unknown)

    def per_text():
        count, known = make(), {}

        def run(text):
            tokens, score, words = 0, 0.0, Counter(words_of(text))
            for word, times in words.items():
                found = known.get(word)
                if found is None:
                    found = count(MARK + word)
                    if len(word) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = found
                tokens += times * found[0]
                score += times * found[1]
            return tokens, sum(words.values()), score
        return run

    return map_texts(docs, list(keep), text, per_text, "n_tokens bigint, n_words bigint, best_score double")
