"""The classifier's numbers, step by step, against plain versions: statistics, sums, weights, calibration."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality


def plain_statistics(text):
    """The same numbers, counted character by character of the UTF-8 text."""
    raw = list((text or "").encode())
    n = len(raw)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    sizes = [len(w.encode()) for w in words]
    count = lambda f: sum(1 for b in raw if f(b))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    digit, blank, plain = count(lambda b: 48 <= b <= 57), count(lambda b: b in (9, 10, 13, 32)), count(lambda b: b in (44, 46))
    high = count(lambda b: b >= 128)
    marks = n - upper - lower - digit - blank - plain - high
    part = lambda a, b: a / b if b else 0.0
    mean = part(sum(sizes), len(sizes))
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    w, seen = len(words), Counter(words)
    pairs = {(a, b) for a, b in zip(words, words[1:], strict=False)}
    return [
        math.log1p(n), math.log1p(w), mean, math.sqrt(part(sum((s - mean) ** 2 for s in sizes), len(sizes))), max(sizes, default=0),
        part(upper, upper + lower), part(digit, n), part(blank, n), part(plain, n), part(marks, n), part(high, n),
        -sum(c / n * math.log2(c / n) for c in Counter(raw).values()), part(math.log1p(len(seen)), math.log1p(w)), part(max(seen.values(), default=0), w),
        part(len(pairs), max(w - 1, 1)), part(sum(s <= 3 for s in sizes), w), part(len(set(lines)), len(lines)),
        math.log1p(part(sum(map(len, lines)), len(lines))) if lines else 0.0, math.log1p(len(lines)),
        part(sum(x.rstrip()[-1:] in (b".", b"?") for x in lines), len(lines)), part(raw.count(124), w), part(raw.count(33), w),
        part((text or "").encode().count(b". "), w), part(marks, w),
    ]


TEXTS = [None, "", "  \n ", "One two. Two three?\nLine | two!!", "é Ünïcode ABC abc 123, 4.5", "x" * 5000, "a b " * 30_000, "same\nsame\nsame", "日本語 text"]


def test_statistics():
    for t in TEXTS:
        assert np.allclose(quality.statistics(t.encode() if t is not None else None), plain_statistics(t), rtol=1e-12, atol=1e-12)


def test_sums_of_partitions_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 6)), rng.integers(0, 2, 500).astype(float)
    rows = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    got = quality.summed(rows, lambda a, b: [a.T @ a, a.T @ b, np.array([len(a), b.sum()])])
    assert np.allclose(got[0].reshape(6, 6), x.T @ x) and np.allclose(got[1], x.T @ y) and got[2].tolist() == [500, y.sum()]
    assert quality.summed(rows.filter("y > 5"), lambda a, b: [a]) == []


def plain_isotonic(shares, counts):
    """Isotonic regression by its definition: the largest mean that an interval from the left, smallest to the right, has."""
    w, v = np.array(counts, float), np.array(shares, float)
    mean = lambda a, b: (w[a : b + 1] * v[a : b + 1]).sum() / w[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]


@pytest.mark.parametrize("seed", range(6))
def test_calibration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    at, shares, counts = np.sort(rng.random(n)).tolist(), rng.random(n).round(2).tolist(), rng.integers(1, 9, n).astype(float).tolist()
    places, values = quality.pooled(at, shares, counts)
    want = plain_isotonic(shares, counts)
    assert values == sorted(values) and np.allclose(sorted({round(v, 9) for v in want}), sorted({round(v, 9) for v in values}))
    # A pool stands at the mean place of its members.
    for p, v in zip(places, values, strict=True):
        own = [i for i in range(n) if abs(want[i] - v) < 1e-9]
        assert abs(p - np.average(np.array(at)[own], weights=np.array(counts)[own])) < 1e-9


def test_fit_equals_ridge_on_the_whole_matrix(spark):
    """Scaling, features, weights and calibration of a fit, worked out anew from all training rows at once."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60)))
        rows.append((i, text.capitalize() + "." if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good) if rng.random() < 0.95 else int(not good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks, features=48)
    known = quality.training_rows(docs, marks, quality.MAX_ROWS).collect()
    text, label = dict(rows), dict(labels)
    ids = spark.createDataFrame(labels, "doc_id long, quality int").select("doc_id", (quality.remainder(F.col("doc_id")) != 1).alias("own"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).alias("kept"))
    own = [(r.doc_id, r.kept) for r in ids.filter("own").collect()]
    assert len(known) == len(own) and sum(r.kept for r in known) == sum(k for _, k in own)
    x = np.array([plain_statistics(text[i]) for i, _ in own])
    y, kept = np.array([label[i] for i, _ in own], float), np.array([k for _, k in own])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6, atol=1e-8)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    z = np.hstack([np.sqrt(2 / 48) * np.cos(z @ model.waves + model.phases), np.ones((len(x), 1))])
    a = z[~kept]
    penalty = quality.PENALTY * len(x) * np.diag([1.0] * 48 + [0.0])
    weights = np.linalg.solve(a.T @ a + penalty, a.T @ y[~kept])
    assert np.allclose(model.weights, weights, atol=1e-6)
    at = np.clip(np.rint((z[kept] @ weights + 0.5) * quality.BUCKETS / 2), 0, quality.BUCKETS).astype(int)
    some = sorted(set(at.tolist()))
    counts = [float((at == k).sum()) for k in some]
    want = plain_isotonic([float(y[kept][at == k].mean()) for k in some], counts)
    assert np.allclose(sorted({round(v, 9) for v in want}), sorted({round(v, 9) for v in model.steps[1]}))
    got = {r.row.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for i, _ in own[:50]:
        assert abs(got[i] - model.score(np.array([plain_statistics(text[i])]))[0]) < 1e-6


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_000_000), (3, None)], "doc_id long, text string")
    model = quality.Model()
    assert [r.score for r in quality.scored(docs, model).collect()] == [0.5] * 3
    assert [len(r.x) for r in quality.measured(docs).collect()] == [24] * 3
