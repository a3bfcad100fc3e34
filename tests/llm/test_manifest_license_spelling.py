"""Merkle manifest, license scan and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import DOCS, ODD, prose

from vidtrend.llm import license_scan, merkle_manifest, spelling_variants

LONG = [(6, "x" * 200_000), (7, "a b\n" * 30_000)]

# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fanout):
    """The levels of a tree over digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, place, fanout):
    out = []
    for level in levels[:-1]:
        run = place // fanout * fanout
        out.append(("".join(level[run:place]), "".join(level[place + 1:run + fanout])))
        place //= fanout
    return out


def manifest_by_hand(rows, fanout=3):
    groups = defaultdict(list)
    for doc, text, lang, source, chars, *_ in rows:
        broken = text if text is None or doc is None or zlib.crc32(str(doc).encode()) % 2 else text.replace("\n", "")
        own, copy = (sha(*map(field, (doc, source, lang, chars, t))) for t in (text, broken))
        groups[source].append((doc is not None, doc or 0, own, copy, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = climb([g[2] for g in groups[name]], fanout)
    upper = climb([trees[name][-1][0] for name in names], fanout)
    out = []
    for at, name in enumerate(names):
        for place, (_, _, leaf, copy, doc) in enumerate(groups[name]):
            path = siblings(trees[name], place, fanout) + siblings(upper, at, fanout)
            node = copy
            for left, right in path:
                node = sha(left, node, right)
            out.append((doc, leaf, trees[name][-1][0], upper[-1][0], sha("".join(a + b for a, b in path)), node, node == upper[-1][0]))
    return out


def manifest_rows(sources, counts):
    draw = random.Random(3)
    rows = []
    for source, count in zip(sources, counts):
        for i in range(len(rows), len(rows) + count):
            rows.append((i * 7 % 1009 + 1, prose(i, 4) + draw.choice(["", "\n", "\nx\n"]), draw.choice(["en", None, "dé"]), source,
                         draw.choice([None, 5, -3]), "x", "y", 7))
    return rows


@pytest.mark.parametrize("counts", [(1,), (28, 2, 82), (300, 4, 9, 1, 1, 1, 1, 1, 1, 1, 1)])
def test_manifest_equals_the_tree_by_hand(spark, counts):
    sources = [None, "", "b", "é", "z", "Z", "zz", "😀", "0", "-", "="]
    rows = manifest_rows(sources[:len(counts)] if len(counts) > 3 else ["hot", None, "c"], counts)
    got = merkle_manifest.tampered_report(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(manifest_by_hand(rows))
    assert {r.verified for r in got} == {True, False} or len(rows) < 5


def test_manifest_of_odd_rows(spark):
    rows = [(i, t, None, None, None, "x", "y", 7) for i, t in ODD] + [(None, None, None, "s", 1, "x", "y", 7)] * 2
    got = merkle_manifest.tampered_report(spark.createDataFrame(rows, DOCS)).collect()
    want = manifest_by_hand(rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.verified) for r in got) == Counter((w[0], w[1], w[2], w[3], w[6]) for w in want)
    assert len({r.proof_sha256 for r in got}) > 3
    assert merkle_manifest.tampered_report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("fanout, levels", [(2, 1), (4, 2)])
def test_manifest_of_other_shapes(spark, fanout, levels):
    rows = manifest_rows(["a", "b"], (37, 5))
    made = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS), "source", "doc_id", ["doc_id", "text"], fanout=fanout, levels=levels)
    made = made.withColumn("end", merkle_manifest.folded(made["leaf"], made["proof"])).collect()
    assert len(made) == 42 and all(r.end == r.root for r in made)
    tree = climb([sha(field(r[0]), field(r[1])) for r in sorted((r for r in rows if r[3] == "a"), key=lambda r: r[0])], fanout)
    assert {r.subroot for r in made if r.doc_id in {x[0] for x in rows if x[3] == "a"}} == {tree[-1][0]}


# ---------------------------------------------------------------- licenses


def scan_by_hand(text, known, slack=license_scan.SLACK, share=license_scan.SHARE):
    words = license_scan.words_of(text or "")
    base, labels, score = [], set(), 0.0
    for _, label, phrase, k, own in known:
        grams = [tuple(own[t:t + k]) for t in range(len(own) - k + 1)]
        lines = defaultdict(list)
        for p in range(len(words) - k + 1):
            for t, gram in enumerate(grams):
                if tuple(words[p:p + k]) == gram:
                    lines[p - t].append((p, t))
        islands, last = [], None
        for d in sorted(lines):
            if last is None or phrase or d - last > slack:
                islands.append([])
            islands[-1] += lines[d]
            last = d
        for hits in islands:
            cover = len({t for _, t in hits}) / len(grams)
            if phrase:
                if cover == 1:
                    base.append((min(p for p, _ in hits), label))
                continue
            score = max(score, cover)
            spread = max(p for p, _ in hits) - min(p for p, _ in hits)
            if cover >= share and spread <= 2 * len(own):
                labels.add(label)
    starts = [p for p, _ in base]
    base_labels = {label for _, label in base}
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | labels)), 1.0 if base else score)


def license_rows():
    draw = random.Random(4)
    known = license_scan.templates()
    notices = [" ".join(t[4]) for t in known]
    texts = [prose(i, 30) for i in range(20)]
    for i in range(60):  # notices inside prose, with words left out, put in or changed
        words = draw.choice(notices).split()
        for _ in range(draw.randrange(12)):
            at = draw.randrange(len(words))
            draw.choice([lambda: words.insert(at, "extra"), lambda: words.__setitem__(at, "other"), lambda: len(words) > 1 and words.pop(at)])()  # noqa: B023
        texts.append(prose(100 + i, draw.randrange(20)) + " " + " ".join(words) + " " + prose(200 + i, draw.randrange(20)))
    texts += ["MIT License", "the MIT license, MIT-License mit  license", "Apache\nLicense apache Licenseé", "general public license " * 50,
              "mit licenses", "mit é license", "mit_license", "general public", "x MIT", "ﬁ MIT\x00LICENSE", notices[3] * 2,
              " ".join(notices[4].split()[:8]), "mit license " * 5000]
    return [(i, t) for i, t in enumerate(texts)]


def test_license_scan_equals_the_loop_by_hand(spark, docs_of):
    rows = license_rows() + [(9000 + (i or 0), t) for i, t in ODD]
    known = license_scan.templates()
    got = license_scan.scan(docs_of(rows).repartition(3), "text", ["doc_id", "ids"]).collect()
    assert Counter(tuple(r)[:1] + tuple(r)[2:] for r in got) == Counter((i, *scan_by_hand(t, known)) for i, t in rows)
    assert {label for r in got for label in r.labels.split(",")} >= {"mit", "apache", "gpl", "bsd", "isc", "mpl", "cc-by-nc"}
    clean = [r for r in got if r.doc_id < 20]
    assert all(r.labels == "" and r.score < 0.2 for r in clean)


def test_license_scan_takes_other_templates_and_nothing(spark, docs_of):
    known = license_scan.templates([("own", "house rules")], [("long", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen")])
    got = license_scan.scan(docs_of([(1, "House Rules one two three four five six seven eight nine ten eleven twelve"), (2, None)]), "text", ["doc_id"], known)
    assert [(r.doc_id, r.labels, r.n_base) for r in got.orderBy("doc_id").collect()] == [(1, "long,own", 1), (2, "", 0)]
    assert license_scan.scan(docs_of([]), "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        license_scan.templates([("one", "single")])


# ---------------------------------------------------------------- spelling


def words_by_hand(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms_by_hand(words, ratio=10):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w in words}


def spelling_rows(seed, alphabet="abé", vocabulary=60):
    """Words over few letters, many of them one or two edits apart, with steep counts."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice(alphabet) for _ in range(draw.choice([7, 7, 8, 9, 10, 11, 15, 16, 40]))) for _ in range(vocabulary)]
    rows = []
    for i, stem in enumerate(stems):
        near = []
        for _ in range(6):
            at, letter = draw.randrange(len(stem)), draw.choice(alphabet + "z")
            near.append(draw.choice([stem[:at] + letter + stem[at:], stem[:at] + letter + stem[at + 1:], stem[:at] + stem[at + 1:]]))
        rows.append((i, " ".join([stem] * draw.choice([2, 30, 300]) + near * draw.choice([1, 2, 20]) + ["Short", "ÀÉ×÷ß"])))
    return rows + [(900 + i, "linkedword " * 100 + "linkedwordx " * 6 + "linkedwordxy " * (i < 2)) for i in range(5)]


@pytest.mark.parametrize("longest_list, most", [(64, 200_000), (2, 200_000), (1, 3), (64, 1)])
def test_spelling_equals_all_pairs_by_hand(spark, docs_of, longest_list, most):
    rows = spelling_rows(longest_list) + ODD + LONG + [(5, None), (11, "seventy-SEVENTY seventy"), (11, "seventy-SEVENTY seventy")]
    got = spelling_variants.variants(docs_of(rows), "doc_id", "text", longest_list=longest_list, most_grams=most).collect()
    want = forms_by_hand(words_by_hand(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form for r in got) and any(r.root not in (r.word, r.form) for r in got)


def test_affected_grams_bound_holds_for_random_edits():
    draw = random.Random(5)
    for _ in range(4000):
        word = "".join(draw.choice("ab") for _ in range(draw.randrange(7, 18)))
        at, letter = draw.randrange(len(word)), draw.choice("abc")
        other = draw.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:], word[:at] + word[at + 1:]])
        if other == word or len(other) < 7:
            continue
        frequent = {"".join(draw.choice("ab") for _ in range(draw.randrange(2, 6))): draw.randrange(1, 9) for _ in range(30)}
        frequent = {g: n for g, n in frequent.items() if all(g[:q] in frequent for q in range(2, len(g)))}
        shared = [b for b, (low, high, _) in enumerate(spelling_variants.bands(7)) if all(low <= len(w) <= high + 1 for w in (word, other))]
        assert shared
        for band in shared:
            qmax = spelling_variants.bands(7)[band][2]
            assert set(spelling_variants.list_keys(word, frequent, band, qmax)) & set(spelling_variants.list_keys(other, frequent, band, qmax)), (word, other)
            grams = spelling_variants.decompose(word, frequent, qmax)
            assert spelling_variants.affected(grams, qmax) < len(grams)


def test_spelling_of_nothing_and_of_ties(spark, docs_of):
    assert spelling_variants.variants(docs_of([]), "doc_id", "text").count() == 0
    assert spelling_variants.variants(docs_of([(1, None), (2, "few words")]), "doc_id", "text").count() == 0
    rows = [(i, "planetsa " * 20 + "planetsb " * 20 + "planets planets") for i in (1, 2)]
    by = {r.word: r for r in spelling_variants.variants(docs_of(rows), "doc_id", "text").collect()}
    want = {w[0]: w for w in forms_by_hand(words_by_hand(rows))}
    assert {w: tuple(r) for w, r in by.items()} == want and by["planets"].form == "planetsa"
