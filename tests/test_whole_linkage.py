"""Whole results on fixtures larger than what an earlier cut let through, against brute force."""

from collections import Counter

import numpy as np

from tessella.operators import cluster, products


def unit(rng, n, d=64):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_linkage_without_a_cap(spark):
    rng = np.random.default_rng(4)
    for cut in (0.3, 0.7, 0.9):
        m = unit(rng, 150, 8)
        assert list(cluster.cosine_linkage(m, cut)) == list(cluster.average_linkage(1 - m @ m.T, cut))
    m, wide = unit(rng, 4300, 16), []
    for k in range(2):  # 2,150 and more than one block a label
        wide += [(k, 2 * i + k, m[2 * i + k].tolist()) for i in range(2150)]
    got = cluster.linkage_groups(spark.createDataFrame(wide, "label int, id long, vector array<double>"), "label", 0.25).collect()
    want = {}
    for k in range(2):
        own = m[k::2]
        want |= {(k, 2 * i + k): g for i, g in enumerate(cluster.cosine_linkage(own, 0.25))}
    assert {(r.label, r.id): r.group for r in got} == want
    same = spark.createDataFrame([(0, i, [1.0, i * 1e-5, 0.0]) for i in range(4001)], "label int, id long, vector array<double>")
    assert {r.group for r in cluster.linkage_groups(same, "label", 0.1).collect()} == {0}


def test_products_of_a_shoot_over_the_old_cap(spark):
    items = [("s", i, [float(np.cos(i // 3)), float(np.sin(i // 3)), float(i // 3)], [float(i % 3 // 2 * 90), 0.0, 0.0]) for i in range(150)]
    got = products.find(spark.createDataFrame(items, "shoot string, id long, vector array<double>, colour array<double>")).collect()
    want = products.group(np.array([x[2] for x in items]), [x[3] for x in items])
    assert {r.id: (r.product, r.variant, r.view) for r in got} == {i: w for i, w in enumerate(want) if w[0] >= 0}
    many = [("s", i, [1.0, 0.0], [float(i % 2 * 90), 0.0, 0.0]) for i in range(4002)]
    got = products.find(spark.createDataFrame(many, "shoot string, id long, vector array<double>, colour array<double>")).collect()
    assert len(got) == 4002 and Counter((r.product, r.variant, r.view) for r in got) == {(0, 0, 0): 2001, (0, 1, 0): 2001}
