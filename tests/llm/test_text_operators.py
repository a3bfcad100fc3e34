"""Compression bands, quality, toxicity, token counts and byte BPE on odd texts and against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from llm_cases import DOCS, ODD, prose
from vidtrend.llm import byte_bpe, compression_bands, quality_score, toxicity, unigram_count


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return byte_bpe.read_ranks(lines)


def odd_strings(n, seed=1):
    draw = random.Random(seed)
    alphabet = "ab  \n\té漢字😀▁<>\x00\x85\xa0 　'sthe123 ²ⅷ"
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(n)]


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = list(zip(words, words[1:], words[2:]))
    inside = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_base_counts_match_the_definition():
    for text in [*odd_strings(400), "a b c a b c d", "x\nx\n \nx\r\n", "", prose(1, 300) + "\n" + prose(1, 300)]:
        assert compression_bands.base_counts(text) == base_by_hand(text), repr(text)


def test_compression_verdicts(docs_of):
    draw = random.Random(8)
    clean = " ".join("".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randrange(2, 9))) for _ in range(500))
    loops = "buy now cheap offer today only here " * 200
    noise = " ".join("".join(chr(random.Random(i * 50 + k).randrange(33, 127)) for k in range(9)) for i in range(400))
    texts = [*ODD, (20, clean), (21, loops), (22, noise)]
    df = compression_bands.compression_rules(docs_of(texts), "text", ["doc_id", "ids", "_text"])
    got = {r.doc_id: r for r in df.collect()}
    assert df.count() == len(texts)
    assert got[20].kept and not got[21].kept and not got[22].kept
    assert got[21].base_failed and not got[22].base_failed  # repeated triples; only the ratio can tell noise
    assert got[1].n_words == 0 and got[1].base_failed and got[2].ratio == 1.0
    assert got[7].n_words == 60_000 and got[7].n_dup_lines == 29_999
    assert compression_bands.compression_rules(docs_of([]), "text", ["doc_id"]).count() == 0


def test_chunks_catch_a_repetitive_middle():
    measure = compression_bands.measurer(compression_bands.Bands())()
    text = (prose(3, 600) + "ab " * 2500 + prose(4, 600)).encode()
    ratio, chunks, outside, good = measure(text)
    assert chunks >= 6 and outside >= 3 and not good


def random_letters(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))


def test_chunks_reach_short_texts_and_the_rest_of_a_text(docs_of):
    draw = random.Random(8)
    base = " ".join("".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randrange(2, 9))) for _ in range(2000))
    junk = {(a, b): base[:a] + random_letters(a + b, b) for a, b in [(2048, 950), (2048, 1500), (2048, 1950), (900, 900), (600, 600)]}
    clean = [base[:n] for n in (400, 767, 768, 900, 1800, 2047, 2048, 2049, 2303, 2304, 3000, 4096, 9000)]
    texts = [*enumerate(clean), *enumerate(junk.values(), 100)]
    got = {r.doc_id: r for r in compression_bands.compression_rules(docs_of(texts), "text", ["doc_id"]).collect()}
    assert all(got[i].kept and got[i].n_chunks >= 1 for i in range(len(clean)))
    assert not any(got[100 + i].kept or got[100 + i].base_failed for i in range(len(junk)))


def test_junk_in_long_texts_fails_at_any_place():
    measure = compression_bands.measurer(compression_bands.Bands())()
    draw = random.Random(8)
    base = " ".join("".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randrange(2, 9))) for _ in range(60_000))

    def mixed(size, *at):
        text = base[:size]
        for i in at:
            text = text[:i * 2048] + random_letters(i, 2048) + text[(i + 1) * 2048:]
        return measure(text.encode())

    assert all(mixed(n)[3] for n in (16_384, 65_536, 262_144))
    assert not mixed(16_384, 2, 3)[3] and not mixed(16_384, 1, 5)[3]
    assert not mixed(262_144, 60, 61)[3] and not mixed(262_144, *range(0, 128, 8))[3]
    assert compression_bands.longest_run([0, 1, 1, 0, 1]) == 2 and compression_bands.longest_run([]) == 0


def test_chunks_cover_every_byte():
    for n in range(1, 3000, 7):
        ends = compression_bands.cuts(n, 512, 256)
        assert [b for b, _ in ends] == [0, *[e for _, e in ends[:-1]]] and ends[-1][1] == n
        assert len(ends) == 1 or min(e - b for b, e in ends) >= 256


def test_bpe_matches_tiktoken_and_round_trips(docs_of, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *[(100 + i, t) for i, t in enumerate([*odd_strings(300), prose(5, 400), "ab" * 3000 + "é" * 999, "it's 'll'S"])]]
    df = byte_bpe.decode(byte_bpe.encode(docs_of(texts), "text", ["doc_id", "text", "_text"], ranks, public_tokenizers.PATTERN), "ids", ranks)
    seen = 0
    for r in df.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or ""), repr(r.text)[:80]
        assert bytes(r.decoded).decode() == (r.text or "")
        seen += 1
    assert seen == len(texts)
    empty = byte_bpe.encode(docs_of([]), "text", ["doc_id"], ranks, public_tokenizers.PATTERN)
    assert byte_bpe.digests(byte_bpe.decode(empty, "ids", ranks)).count() == 0


def test_bpe_long_words_equal_short_way(ranks):
    merger = byte_bpe.Merger(ranks)
    draw = random.Random(7)
    words = [bytes(draw.choice(b"abcdetings\xc3\xa9") for _ in range(draw.randrange(1, 60))) for _ in range(500)]
    assert merger.fold(words) == [merger.long_word(w) if w not in ranks else ranks[w].to_bytes(4, "little") for w in words]


def test_unigram_counts_match_the_library(docs_of):
    tokenizers = pytest.importorskip("tokenizers")
    pieces, unknown = unigram_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    plain = [p for p in pieces if not p[0].startswith("<0x")]
    texts = [*ODD, *[(100 + i, t) for i, t in enumerate([*odd_strings(300), prose(6, 400), "  a", "a ", "▁", "<0x41>"])]]
    for vocabulary, bytewise in ((pieces, True), (plain, False)):
        reference = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=unknown, byte_fallback=bytewise))
        reference.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
        got = unigram_count.token_counts(docs_of(texts), "text", ["text"], vocabulary, unknown).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.n_tokens == len(reference.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)[:80]
    assert unigram_count.token_counts(docs_of([]), "text", ["doc_id"], pieces, unknown).count() == 0


def test_unigram_ties_prefer_the_longer_last_piece():
    count = unigram_count.counter([("?", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0)], 0)()
    assert count("▁ab") == (2, -3.0)  # equal scores: the piece that starts first


def labelled(spark, good, bad, column):
    rows = [(i, 1) for i in good] + [(i, 0) for i in bad]
    other = "toxic" if column == "quality" else "quality"
    return spark.createDataFrame([(i, y, 0) for i, y in rows], f"doc_id bigint, {column} int, {other} int")


def test_quality_separates_held_out_rows(spark, docs_of):
    good = [(i, prose(i, 120)) for i in range(300)]
    bad = [(1000 + i, " | ".join(prose(5000 + i, 60).upper().split()) + " !!! $$$") for i in range(100)]
    labels = labelled(spark, [i for i, _ in good], [i for i, _ in bad], "quality")
    df = quality_score.quality(docs_of([*good, *bad, *ODD]), labels, "doc_id", "text", "quality", features=64)
    got = df.collect()
    assert len(got) == 400 + len(ODD)
    by = {r.doc_id: r for r in got}
    for i, truth in [*[(i, 1) for i, _ in good], *[(i, 0) for i, _ in bad]]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.3)
    held = [(by[i].predicted, y) for i, y in [*[(i, 1) for i, _ in good], *[(i, 0) for i, _ in bad]] if by[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert by[None].held_out


def test_quality_without_labels_and_rows(spark, docs_of):
    none = spark.createDataFrame([(1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_score.quality(docs_of(ODD), none, "doc_id", "text", "quality", features=8).collect()} == {0.5}
    assert quality_score.quality(docs_of([]), none, "doc_id", "text", "quality", features=8).count() == 0


def test_isotonic_pools_violators():
    x, y = quality_score.isotonic(np.arange(4.0), np.array([0, 1, 0.5, 2]), np.ones(4))
    assert y.tolist() == [0, 0.75, 2] and x.tolist() == [0, 1.5, 3]


def test_toxicity_learns_graded_words(spark, docs_of):
    draw = random.Random(3)
    clean = [(i, prose(i, 80)) for i in range(300)]
    toxic = []
    for i in range(120):
        words = prose(2000 + i, 80).split()
        for _ in range(draw.choice([1, 4, 8])):
            words.insert(draw.randrange(80), draw.choice(["scumbag", "vermin" + draw.choice(["y", "ous", "ella", "ito"])]))
        toxic.append((2000 + i, " ".join(words)))
    train_clean, train_toxic = clean[:250], toxic[:100]
    labels = spark.createDataFrame([(i, 0) for i, _ in train_clean] + [(i, 1) for i, _ in train_toxic] + [(None, 1), (1, None)],
                                   "doc_id bigint, toxic int")
    docs = docs_of([*clean, *toxic, *[(9000 + (i or 0), t) for i, t in ODD]])
    model = toxicity.train_model(docs, labels, "doc_id", "text", "toxic")
    assert list(model.thresholds) == sorted(model.thresholds) and "vermin*" in model.terms
    got = {r.doc_id: r for r in toxicity.score(docs, "text", ["doc_id"], model).collect()}
    assert all(got[i].toxic for i, _ in toxic) and not any(got[i].toxic for i, _ in clean)
    assert not got[9002].toxic and 0 <= got[9002].severity < 0.5
    one, many = toxicity.Model.severity(model, "a verminous b")[0], toxicity.Model.severity(model, "vermin verminous scumbag " * 4)[0]
    assert one < many <= 3
    probabilities = [g.toxic_probability for g in got.values()]
    assert all(0 <= p <= 1 for p in probabilities)


def test_toxicity_without_classes(spark, docs_of):
    labels = spark.createDataFrame([(4, 0)], "doc_id bigint, toxic int")
    model = toxicity.train_model(docs_of(ODD), labels, "doc_id", "text", "toxic")
    assert model is None
    df = toxicity.score(docs_of(ODD), "text", docs_of(ODD).columns, model, prefix="_pipeline_")
    assert df.count() == len(ODD) and df.columns[:8] == docs_of([]).columns
    assert not any(r._pipeline_toxic for r in df.collect())
    assert toxicity.score(docs_of([]), "text", ["doc_id"], None).count() == 0
    assert DOCS.startswith("doc_id")


def test_ordinal_gradient_matches_differences(spark):
    draw = np.random.default_rng(1)
    rows = [([int(draw.integers(3))], [float(draw.uniform(0.5, 2))], int(draw.integers(4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "at array<int>, value array<double>, grade int")
    at = np.array([0.3, -0.2, 0.5, 0.1, 0.2, -0.3])
    value, slope = toxicity._loss(df, 3, at, 0.01)
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-5
        up, down = toxicity._loss(df, 3, at + step, 0.01)[0], toxicity._loss(df, 3, at - step, 0.01)[0]
        assert abs((up - down) / 2e-5 - slope[i]) < 1e-6
