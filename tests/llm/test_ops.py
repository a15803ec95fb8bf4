"""Each operator against brute force, and the cases that every operator defines: nulls, empty and long texts, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, decontam, jaccard, licenses, linededup, pii, quality, secrets, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, raw string, x int, t string, key string, found int, score double, base int, clean int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(s):
    return WORD.findall((s or "").translate({c: c + 32 for c in range(65, 91)}))


def doc(i, text, source="s1"):
    return (i, text, "en", source, len(text or ""), "r", "w", 1, "t", "k", 2, 0.5, 3, 4)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [doc(i, "\n".join(["Common header line here."] * (i % 3 > 0) + [line(rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]), f"s{i % 9}") for i in range(60)]
    long_ = line(3000)
    rows += [doc(100, None), doc(101, ""), doc(102, "   \n\n "), doc(None, line(20)), doc(103, "one two"), doc(104, "one  TWO!"), doc(105, long_), doc(106, long_ + " tail"), (107, *[None] * 13)]
    base = line(60).split()
    for i in range(12):
        w = list(base)
        w[i * 3] = f"changed{i}"
        rows.append(doc(200 + i, " ".join(w), f"s{i}"))
    rows += [rows[0], rows[0], rows[65]]
    bench = [(1, " ".join(base[5:30])), (2, line(12)), (3, "one two"), (4, None), (5, ""), (None, line(11)), (2, line(14)), (6, long_[500:700])]
    return rows, bench


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], SCHEMA)


def test_every_operator_takes_an_empty_table(spark, docs, corpus, tmp_path):
    none, bench = docs.limit(0), spark.createDataFrame(corpus[1], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pii.find_private(none).count() == secrets.scan_secrets(none).count() == 0
    assert bpe.encode(none, *bpe.vocabulary()).count() == licenses.scan_licenses(none).count() == 0
    assert decontam.match_documents(none, bench).count() == 0 == quality.scored(none, quality.fit(none, labels)).count()
    assert linededup.remove_boilerplate(none).count() == jaccard.near_duplicates(none).count() == 0 == jaccard.keep_one(none).count()


def test_bpe_is_what_tiktoken_gives(spark, docs):
    path, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    more = ["a" * 3000, "  \t\n x", "don't 'S 12٣Ⅷ \U0001d54f\U0001f600 \x1c\x85 é", "<|endoftext|>"]
    rows = docs.unionByName(spark.createDataFrame([doc(300 + i, x) for i, x in enumerate(more)], SCHEMA))
    out = bpe.encode(rows, path, pattern)
    back = bpe.decode(out, path).collect()
    assert len(back) == rows.count()
    for r in back:
        text = r["row"]["text"] or ""
        ids = enc.encode_ordinary(text)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_perfect_hash_knows_its_keys_and_no_others():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert [h.get(k) for k in keys] == list(range(5000)) and None not in h.keys
    assert all(h.get(f"x{i}".encode()) == -1 for i in range(5000)) and bpe.PerfectHash([], []).get(b"a") == -1


@pytest.mark.parametrize("block_chars", [10**6, 150])
def test_decontamination(spark, docs, corpus, block_chars):
    bench = spark.createDataFrame(corpus[1], "item_id long, text string")
    windows = []
    for item, text in corpus[1]:
        w = words(text)
        if item is not None and w:
            windows += [(str(item), w[i : i + 10]) for i in range(max(1, len(w) - 9))]
    out = decontam.match_documents(docs, bench, block_chars=block_chars).collect()
    assert len(out) == len(corpus[0])
    some = 0
    for r in out:
        w, hit, items = words(r["row"]["text"]), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= {*range(i, i + len(win))}
                    items.add(item)
        f = r["found"]
        assert f["n_words"] == len(w) and {j for x in f["hits"] for j in range(x["start"], x["end"])} == hit and f["items"] == sorted(items)
        some += bool(hit)
    assert some >= 12


def test_proximity_finds_shuffled_terms(spark):
    bench = spark.createDataFrame([(1, "quartz the veldt of jumbo nymphs and sphinx a the of and a")], "item_id long, text string")
    rows = [doc(1, "sphinx saw nymphs near jumbo and the veldt"), doc(2, "the of and a " * 30), doc(3, "sphinx " + "the " * 60 + "nymphs jumbo veldt")]
    found = {r["row"]["doc_id"]: r["found"]["near"] for r in decontam.match_documents(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert found == {1: [], 2: [], 3: []}  # `quartz` is the rarest term, and stands nowhere
    rows.append(doc(4, "quartz sphinx veldt jumbo nymphs in any order"))
    found = {r["row"]["doc_id"]: r["found"]["near"] for r in decontam.match_documents(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert found == {1: [], 2: [], 3: [], 4: ["1"]}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95


def test_quality_edge_cases(spark, docs):
    rng = random.Random(1)
    rows = [doc(i, " ".join(("word" if i % 2 else "W!!") + str(rng.randint(0, 99)) for _ in range(30))) for i in range(200)]
    train = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (5, 0), (7, 1)], "doc_id long, quality int")
    model = quality.fit(train, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    mine = quality.scored(train, model).select("row.doc_id", "score").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in mine]) > 0.95
    only = quality.fit(train, labels.filter("quality = 1 AND doc_id <> 5"))
    assert {r["score"] for r in quality.scored(docs, only).collect()} == {1.0}
    assert {r["score"] for r in quality.scored(docs, quality.fit(train, labels.limit(0))).collect()} == {0.5}


def test_isotonic_is_monotone():
    x, y = quality.pooled([0.0, 1.0, 2.0, 3.0], [0.1, 0.5, 0.3, 0.9], [1.0, 1.0, 1.0, 1.0])
    assert y == sorted(y) and len(x) == 3 and y[1] == pytest.approx(0.4)


def test_line_dedup(spark, docs, corpus):
    fold = lambda s: re.sub(r"\s+", " ", s).strip(" ").lower()
    sites, first = {}, {}
    for r in corpus[0]:
        for i, s in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            if fold(s):
                sites.setdefault(fold(s), set()).add(r[3])
                at = (r[0] is not None, r[0] or 0, r[1], i)
                first[fold(s)] = min(first.get(fold(s), at), at, key=lambda a: (a[0], a[1], a[3]))
    n = 0
    for r in linededup.remove_boilerplate(docs, min_sites=4).collect():
        d, text = r["row"]["doc_id"], r["row"]["text"]
        if text is None:
            assert r["clean"] is None and r["n_lines"] == 0 == r["n_removed"]
            continue
        gone = {i for i, s in enumerate(text.split("\n")) if fold(s) and len(sites[fold(s)]) >= 4 and first[fold(s)] != (d is not None, d or 0, text, i)}
        assert r["n_removed"] == len(gone) and r["clean"] == "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)
        n += len(gone)
    assert n > 20


def test_sketches_leave_no_case_open():
    for n in range(2, 9):
        filled = n - 1
        assert linededup.sure_above(n) >= round(32 * np.log(32 / (32 - filled))) - 0
    assert linededup.sure_above(30) > 10**6


def brute_links(texts):
    sets = {}
    for i, t in texts:
        w = words(t)
        if w:
            sets.setdefault(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))), []).append(i)
    keys = list(sets)
    links = [(a, b) for a, b in combinations(range(len(keys)), 2) if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b])]
    root = list(range(len(keys)))
    for _ in keys:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return keys, sets, links, root


def test_near_duplicates(spark, docs, corpus):
    keys, sets, links, root = brute_links([((r[0], r[1]), r[1]) for r in corpus[0]])
    low = {}
    for k, r in zip(keys, root, strict=True):
        ids = [i for i, _ in sets[k] if i is not None]
        low[r] = min([*ids, *([low[r]] if low.get(r) is not None else [])], default=None)
    want = {}
    for n, k in enumerate(keys):
        for i, t in sets[k]:
            want.setdefault((i, t), (low[root[n]], sum(n in e for e in links), len(sets[k]) - 1))
    got = jaccard.near_duplicates(docs).join(docs.select("doc_id", jaccard.row_key(F.col("text")).alias("t"), "text").distinct(), ["doc_id", "t"], "left").collect()
    assert len(got) == len(corpus[0]) and len(links) >= 10
    for r in got:
        if r["text"] is not None and words(r["text"]) and r["doc_id"] is not None:
            assert (r["class_id"], r["n_links"], r["n_copies"]) == want[r["doc_id"], r["text"]]
    kept = jaccard.keep_one(docs).collect()
    classes = len({root[n] for n in range(len(keys))})
    assert len(kept) == classes + sum(not words(r[1]) for r in corpus[0]) and kept[0].asDict().keys() == docs.first().asDict().keys()


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        for i in range(70):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = f"x{rng.randint(0, 10**6)}"
            rows.append((g * 100 + i, " ".join(w)))
    for name, value in (("LIMIT", 16), ("GRID_SETS", 20), ("BLOCK_SETS", 25), ("DENSE", 0.9), ("DEPTH", 2)):
        monkeypatch.setattr(jaccard, name, value)
    keys, sets, links, root = brute_links(rows)
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, k in enumerate(keys):
        for i in sets[k]:
            assert got[i].n_links == sum(n in e for e in links) and got[i].n_copies == len(sets[k]) - 1
            assert got[i].class_id == min(j for m, r in enumerate(root) if r == root[n] for j in sets[keys[m]])


def test_licenses(spark, docs):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under CC BY-NC 4.0.", "CC by cc BY. All Rights\nReserved",
        "licensed under the GNU General Public License, version 3.", "licensed under the gnu big general public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "Copyright (c) 2024 Some People. All rights reserved.", "released under the MIT License", "cc bye",
    ]
    rows = docs.unionByName(spark.createDataFrame([doc(400 + i, x) for i, x in enumerate(texts)], SCHEMA))
    got = licenses.scan_licenses(rows).collect()
    for r in got:
        w, at, labels = words(r["row"]["text"]), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        f = r["found"]
        assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert f["base_labels"] == sorted(labels) and {*f["labels"]} >= labels and 0 <= f["score"] <= 1
    own = {r["row"]["doc_id"]: r["found"]["labels"] for r in got}
    assert own[400] == ["apache-2.0-notice"] and "cc-by-notice" in own[401] and own[402] == ["cc-by", "reserved"] and "gpl-notice" in own[403]
    assert own[404] == ["gpl"] and own[405] == ["mit-grant"] and own[406] == ["reserved", "reserved-notice"] and own[407] == ["mit-notice"] and own[408] == []


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "b" * 100000, "é\r\n\r\nWARC/1.1", "<p>a</p>", "c"]
    rows = [(i if i != 7 else None, f"http://x/{i}\n", h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    back = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    first = {}
    for i, h in enumerate(html[:7]):
        raw = (h or "").encode()
        r = back[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == warc.base32_digest(raw)
        if raw in first:
            assert r.record_type == "revisit" and r.refers_to == f"<urn:page:{first[raw]}>" and r.payload is None
        else:
            first[raw] = i
            assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to is None
    assert back[None].record_type == "response" and len(back) == 8
    some = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit' AND page_id IN (1, 3)")
    assert {r.page_id for r in some.collect()} == {1, 3}
    reader = warc.WarcReader(path, some.schema, False)
    left = [*reader.pushFilters([warc.ds.EqualTo(("record_type",), "revisit"), warc.ds.In(("page_id",), (1, 3)), warc.ds.GreaterThan(("page_id",), 2)])]
    assert [type(x) for x in left] == [warc.ds.GreaterThan] and reader.equal == [("record_type", {"revisit"}), ("page_id", {1, 3})]
    assert reader.wanted({"record_type": "revisit", "page_id": 3}) and not reader.wanted({"record_type": "response", "page_id": 3})
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    warc.write_warc(pages, str(tmp_path / "large"), min_bytes=1)
    assert warc.read_warc(spark, str(tmp_path / "large")).filter("record_type = 'revisit'").count() == 2


def test_warc_reads_members_without_lengths(tmp_path):
    import gzip
    import io

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nX-Page-Id: %d\r\nContent-Length: 11\r\n\r\nHTTP\r\n\r\nabc\r\n\r\n"
    f = io.BytesIO(b"".join(gzip.compress(record % (i, i)) for i in range(3)))
    assert [(r["page_id"], r["payload"]) for r in warc.records(f, lambda r: r["page_id"] != 1, True)] == [(0, b"abc"), (2, b"abc")]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 24)).astype(np.float32)
    m[50] = m[100] = m[150]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(m)] + [(500, None, ""), (550, [0.0] * 24, ""), (600, [float("nan")] + [1.0] * 23, ""), (650, [1.0, 2.0], ""), (None, m[0].tolist(), ""), (700, [], "")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = v.filter("vec_id % 50 = 0")
    x = m.astype(float)
    cos = lambda a: (x * x[a]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[a] ** 2).sum()))
    want = {a: sorted((-s, i) for i, s in enumerate(cos(a)) if i != a)[:5] for a in range(0, 400, 50)}
    for block, asked in ((10**6, 10**6), (2000, 60)):
        got = {}
        for r in ann.nearest(v.drop("score").withColumn("score", F.lit(1)), q, block_values=block, query_values=asked).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
        assert {*got} == {*want}
        for a in want:
            assert [got[a][k][1] for k in range(1, 6)] == [i for _, i in want[a]]
            assert np.allclose([got[a][k][0] for k in range(1, 6)], [s for s, _ in want[a]], atol=1e-12)
    few = ann.nearest(v.filter("vec_id < 3"), v.filter("vec_id = 0")).collect()
    assert len(few) == 2 and public_tokenizers.PATTERN
    assert ann.nearest(v.limit(0), q).count() == 0 == ann.nearest(v, q.limit(0)).count()


def test_nearest_of_tiny_and_huge_vectors(spark):
    rows = [(0, [2.0**-700, 2.0**-699]), (1, [2.0**-600, 2.0**-599]), (2, [3e200, -1e200]), (3, [1.0, 0.0]), (4, [2.0**-900, 2.0**-899])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id = 0"), k=4).collect()
    assert [r.vec_id for r in got] == [1, 4, 3, 2] and [round(r.score, 6) for r in got] == [1.0, 1.0, 0.447214, 0.141421]
