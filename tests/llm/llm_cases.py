"""Texts and schemas shared by the tests of this folder."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, _text string, size int"
def rows(texts, source="s"):
    """Documents with columns whose names the operators use inside."""
    return [(i, t, "en", source, len(t or ""), "x", "y", 7) for i, t in texts]
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from".split()


def prose(seed, n):
    import random
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "ing", "ed", "er", "ly"]) + str(draw.randrange(40)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "x" * 200_000), (7, "a b\n" * 30_000),
       (8, "same text here"), (8, "same text here"), (9, "é漢字😀 \x85\xa0​ \x1c b"), (None, "no id at all")]
