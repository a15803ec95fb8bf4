"""Spelling variants against a plain version, and the cases that the operator defines."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessella.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, key long, half int, root string"


def plain(rows, lead=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        p = 0
        while p < len(a) and a[p] == b[p]:
            p += 1
        return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[p:] == b[p + 1 :])

    others = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= lead * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(others[w]), words[form[w]] if w in form else None))
    return out


def result(df):
    rows = df.collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "word", 5, 6, 7, "r") for i, t in rows], SCHEMA)
    return result(variants.variants(variants.vocabulary(frame)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcÀéÿz") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(base[: rng.randint(1, 25)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randint(0, len(w))
                w = rng.choice([w[:at] + rng.choice("abz×é") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÿ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((rng.choice([i, None, 3]), rng.choice([" ", "1", ", "]).join(words)))
    want = plain(rows)
    assert run(spark, rows) == want
    assert sum(w[1] is not None for w in want) > 20


def test_chains_and_ties(spark):
    """A chain of three forms, equally frequent forms, anagrams that are no variants, and edits at either end and in runs of a letter."""
    words = {"aaaabbbb": 2000, "aaaabbb": 200, "aaaabb": 99, "aaaabbc": 20, "aaaaccc": 2, "aaaabcc": 2, "xylophone": 30, "xylophonf": 30, "xylophon": 3, "phonexylo": 3, "ylophone": 2, "xxylophone": 2}
    # One word a document, with ids of which none falls to the deletion.
    rows, i = [], 0
    for w, n in words.items():
        left = n
        while left:
            i += 1
            if zlib.crc32(f"{i}:{w}".encode()) % 31:
                rows.append((i, w))
                left -= 1
    got = run(spark, rows)
    assert got == plain(rows)
    by = {g[0]: g for g in got}
    assert by["aaaabbc"][1:3] == ("aaaabbb", "aaaabbbb") and by["aaaabcc"][2] == "aaaabbbb"
    assert by["xylophon"][1] == "xylophone" and by["phonexylo"][1] is None and by["ylophone"][1] == "xylophone"


def test_many_variants_of_one_word(spark):
    """One word has every variant there is; nothing is cut off."""
    word = "mountain"
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    near = {word[:i] + c + word[i:] for i in range(9) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(8) for c in letters} | {word[:i] + word[i + 1 :] for i in range(8)}
    near = {w for w in near if w != word}
    words = spark.createDataFrame([(word, 1000)] + [(w, 2) for w in near], "word string, n long")
    got = {r.word: r for r in variants.variants(words).collect()}
    assert got[word].n_near == len(near) and all(got[w].form == word and got[w].root == word for w in near)


def test_empty_null_and_long(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (None, None), (2, ""), (3, "short words only")]) == set()
    long_ = "ab" * 4000
    rows = [(i, f"{long_} {long_}c {'x' * 3000}" + " filling" * 20_000) for i in (1, 2, 3)]
    assert run(spark, rows) == plain(rows)
