"""Disclosing terms against a brute-force count of all pairs, and texts with very many values."""

import random
import time
from math import log2

import pytest
import regex

from tessella.llm import pii
from test_spans import PII, brute

HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
WORD = regex.compile(rf"[{HAN}]{{2}}|(?:(?![{HAN}])[\p{{L}}\p{{M}}\p{{N}}]){{2,}}+", regex.V0)


def entities(text):
    return {k + ":" + ("".join(c for c in text[s:e] if c.isdigit()) if k in ("card", "phone") else text[s:e].lower()) for k, s, e in brute(text, PII)}


def plain(texts):
    """Spans of the terms of each text, by counting every entity with every term."""
    texts = [t or "" for t in texts]
    holds, has = [entities(t) for t in texts], [{w.lower() for w in WORD.findall(t)} for t in texts]
    n, a, out = len(texts), pii.SMOOTH, []

    def share(t, e):
        n_e, n_t = sum(e in h for h in holds), sum(t in h for h in has)
        n_te = sum(e in h and t in w for h, w in zip(holds, has, strict=True))
        return log2(n * n_te / ((n_t + a) * (n_e + a))) / log2(n / n_e) if n_e < n else 0.0

    known = {}
    for text, es, ts in zip(texts, holds, has, strict=True):
        base, spans = brute(text, PII), []
        for m in WORD.finditer(text):
            w = m[0].lower()
            if es and w in ts and not any(s < m.end() and m.start() < e for _, s, e in base):
                top = max(known.setdefault((w, e), share(w, e)) for e in es)
                if top >= pii.GENERALISE - 1e-9:
                    spans.append(("gone" if top >= pii.REMOVE - 1e-9 else "term", m.start(), m.end()))
        out.append(sorted(spans, key=lambda x: x[1]))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [some(rng.randint(5, 25)) for _ in range(150)]
    out += [f"{some(4)} rareterm{i} {some(30)} user{i}@mail.org é" for i in range(40)]  # one entity and one name each, far apart
    out += [f"Bertholdine Li {some(3)} bert@home.org and 田中太郎 {some(20)}" for _ in range(6)]
    out += [f"{some(8)} both@x.yz bert@home.org {some(3)} 10.0.0.{i % 3} shared{i % 2}" for i in range(8)]
    out += [out[-1]] * 9 + [out[160]] * 3  # copies
    out += ["", None, "éa@b.co x9", "call +1 (988) 555-2485 Zoë", "CALL +1 988 555 2485 zoë", "a@b.c_d@e.f-word"]
    return out


def test_terms_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, weight int, key string").repartition(5)
    found = pii.find_private(docs)
    got = {r["row"]["doc_id"]: r for r in pii.sanitise(found).collect()}
    want = plain(texts)
    kinds = set()
    for i, t in enumerate(texts):
        spans = [(x["kind"], x["start"], x["end"]) for x in got[i]["spans"]]
        assert [x for x in spans if x[0] in ("term", "gone")] == want[i], t
        assert sorted(x for x in spans if x[0] not in ("term", "gone")) == sorted(brute(t, PII))
        kinds |= {x[0] for x in spans}
        hidden = {t[s:e].lower() for _, s, e in want[i]}
        assert not hidden & {w.lower() for w in WORD.findall((got[i]["sanitised"] or "").replace("[word]", " "))}
        assert (got[i]["sanitised"] is None) == (t is None) and "@" not in (got[i]["sanitised"] or "")
    assert {"term", "gone"} <= kinds and sum(any(x[0] != "email" for x in want[i]) for i in range(150, 190)) == 40
    assert all(any(texts[i][s:e] == f"rareterm{i - 150}" for _, s, e in want[i]) for i in range(150, 190))


@pytest.mark.parametrize("piece, n", [("12 x 1.2.3.4 ", 40_000), ("a@b.cc, ", 60_000)])
def test_many_matches_in_one_text(spark, piece, n):
    docs = spark.createDataFrame([(0, piece * n), (1, "plain words"), (2, "other words")], "doc_id long, text string")
    began = time.time()
    r = pii.sanitise(pii.find_private(docs)).filter("row.doc_id = 0").first()
    assert len(r["base"]) == n and r["base"][-1]["end"] == len(piece) * (n - 1) + len(piece.rstrip(", ")) and "@" not in r["sanitised"]
    assert time.time() - began < 120
