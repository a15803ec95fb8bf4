"""Whole results on fixtures larger than what an earlier cut let through, against brute force."""

from collections import Counter

import numpy as np
import pandas as pd

from tessella.operators import cluster
from tessella.plans import catalogue


def embeddings(path, m, label=None):
    n = len(m)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(m.astype(np.float32)), "label": np.arange(n) % 10 if label is None else label}).to_parquet(path / "embeddings.parquet")
    return str(path)


def unit(rng, n, d=64):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def roots(n, edges):
    own = list(range(n))

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        own[b] = a
    return [top(i) for i in range(n)]


def test_products_of_every_vector(spark, tmp_path):
    got = catalogue.queries()["product_groups"](spark, embeddings(tmp_path, unit(np.random.default_rng(1), 200))).collect()
    assert sorted(r.id for r in got) == list(range(600)) and all(len({(r.label, r.product) for r in got if r.id // 3 == i}) == 1 for i in range(200))


def test_linked_groups_beyond_500_rows(spark, tmp_path):
    m = unit(np.random.default_rng(2), 720).astype(np.float32).astype(float)
    sf = embeddings(tmp_path, m)
    a, b = np.nonzero(np.triu(m @ m.T >= 0.4, 1))
    same = [(i, i + 100) for i in range(1, 620, 50)]
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *same]
    root = dict(enumerate(roots(720, edges)))
    linked = {x for e in edges for x in e}
    got = catalogue.queries()["linked_groups_kept_names"](spark, sf).collect()
    assert {r.root: r.n for r in got} == Counter(root[i] for i in linked)
    votes = Counter((root[i], f"name {i % 30}") for i in linked if i % 4 == 1)
    name = {r: min((-n, x) for (q, x), n in votes.items() if q == r)[1] for r, _ in votes}
    got = catalogue.queries()["linked_groups_named"](spark, sf).collect()
    assert {r.id: (r.root, r.name) for r in got} == {i: (root[i], name.get(root[i])) for i in linked} and name


def test_names_tie_to_the_smaller(spark):
    new = spark.createDataFrame([(i, i // 2) for i in range(40)], "id long, root long")
    old = spark.createDataFrame([(i, f"{'ab'[i % 2]}{i // 2}") for i in range(40)], "id long, name string")
    assert {r.root: r.name for r in cluster.kept_names(new, old).collect()} == {k: f"a{k}" for k in range(20)}
