"""Language profiles against a plain version, held-out accuracy, and the cases that the operator defines."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "su"], "bb": ["sch", "ein", "ung", "ver", "ik"], "cc": ["ció", "ado", "ñe", "lla", "mi"], "dd": ["ка", "но", "ст", "ие"]}


def plain_grams(text):
    counts = Counter()
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in words:
        counts.update(w)
        counts.update(f" {w} "[i : i + 2] for i in range(len(w) + 1))
        counts.update(f" {w} "[i : i + 3] for i in range(len(w)))
    return counts


def plain_profile(counts, size):
    number = lambda g: [0] * (3 - len(g)) + [ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def plain(rows, size):
    totals = {}
    for _, lang, text in rows:
        if lang is not None:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {k: {g: i for i, g in enumerate(plain_profile(c, size))} for k, c in totals.items()}
    out = []
    for _, _, text in rows:
        own = plain_profile(plain_grams(text), size)
        far = {k: sum(min(size, abs(p[g] - i)) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items() if p}
        out.append((min(sorted(far), key=far.get), far) if own and far else ("und", far))
    return out


def make(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        rows.append((i, lang, text.title() + rng.choice(["", " 12", "\n\n--"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "row", 1.0, "xx") for r in rows], "doc_id long, lang string, text string, row string, score double, lang_pred string")


@pytest.mark.parametrize("size", [20, 400])
def test_equals_plain(spark, size):
    rng = random.Random(size)
    rows = make(rng, 60) + [(100, None, "kalo mine"), (101, "aa", None), (102, "bb", "123 !!"), (103, "cc", ""), (None, "dd", "каст"), (104, "ee", "Ⅷ日本 한국어 ǅ"), (5, "aa", "su " * 20_000), (5, "aa", "su " * 20_000)]
    df = frame(spark, rows).repartition(3)
    places = langid.collected(langid.learned(df, size), size)
    for (_, _, text), (want, far) in zip(rows, plain(rows, size), strict=True):
        own = langid.profile(text, size)
        if len(own):
            assert dict(zip(places.names, places.distances(own).tolist(), strict=True)) == far
        assert places.predict(text)[0] == want and 0 <= places.predict(text)[1] <= 1
    got = Counter((r.row.doc_id, r.row.text, r.row.lang_pred, r.lang_pred) for r in langid.identified(df, places).collect())
    assert got == Counter((i, t, "xx", w) for (i, _, t), (w, _) in zip(rows, plain(rows, size), strict=True))


def test_held_out_accuracy(spark, tmp_path):
    rows = make(random.Random(3), 300)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op12_language_id(spark, str(tmp_path)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i, r in got.items() if r.held_out) == held
    assert sum(got[i].lang_pred == rows[i][1] for i in held) >= 0.95 * len(held)


def test_held_out_rows_teach_nothing(spark, tmp_path):
    """A language that only held-out rows have is never predicted."""
    rows = make(random.Random(4), 60)
    rows = [(i, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, t) for i, lang, t in rows]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert "zz" not in {r.lang_pred for r in langid.op12_language_id(spark, str(tmp_path)).collect()}


def test_nothing_learned_and_empty(spark):
    df = frame(spark, [(1, None, "kalo")])
    places = langid.collected(langid.learned(df))
    assert [(r.lang_pred, r.score) for r in langid.identified(df, places).collect()] == [("und", 0.0)]
    assert langid.identified(frame(spark, []), places).collect() == []


def test_counts_are_whole_where_tasks_hand_them_on(spark, monkeypatch):
    """With next to no room, counts leave a task in pieces; their sums are the same."""
    rows = make(random.Random(6), 40)
    df = frame(spark, rows).coalesce(1)
    want = {(r.lang, r.gram): r.n for r in langid.counted(df).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()}
    monkeypatch.setattr(langid, "HELD", 150)
    pieces = langid.counted(df).collect()
    got = Counter()
    for r in pieces:
        got[(r.lang, r.gram)] += r.n
    assert len(pieces) > len(want) and got == want


def test_too_many_languages(spark):
    df = frame(spark, [(i, f"l{i}", "kalo") for i in range(6)])
    with pytest.raises(ValueError, match="languages"):
        langid.collected(langid.learned(df), most=5)
