"""Components and links of the grid: long paths, tables over the local limit, and single against double precision."""

import numpy as np
import pytest

from tessella.operators import cluster, index


def edge_table(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(8)


@pytest.mark.parametrize("local", [500_000, 300])
def test_paths_of_any_length(spark, monkeypatch, local):
    """A path in order, one at random, a star and a vertex by itself; fifty rounds of neighbours did not reach its ends."""
    monkeypatch.setattr(cluster, "LOCAL", local)
    turned = np.random.default_rng(1).permutation(1500) + 5000
    pairs = [(i, i + 1) for i in range(1500)] + list(zip(turned[:-1], turned[1:], strict=True)) + [(9000, 9000 + i) for i in range(1, 400)] + [(20000, 20000)]
    got = {r.id: r.root for r in cluster.components(edge_table(spark, pairs)).collect()}
    want = {i: 0 for i in range(1501)} | {i: 5000 for i in range(5000, 6500)} | {9000 + i: 9000 for i in range(400)} | {20000: 20000}
    assert got == want


def test_no_edges(spark):
    assert cluster.components(edge_table(spark, [])).collect() == []


def roots(edges):
    return {r.id: r.root for r in cluster.components(edges).collect()}


def test_links_connect_what_all_pairs_do(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(700, 24))
    rows = [(i * 3, i % 2, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame([*rows, (5000, 0, None)], "id long, key int, vector array<double>")
    whole = df.filter("vector IS NOT NULL")
    want = {at: roots(cluster.eps_edges(whole, at)) for at in (0.5, 0.6, 0.7)}
    monkeypatch.setattr(cluster, "BLOCK", 100)
    monkeypatch.setattr(cluster, "TILE", 5000)
    for at, all_ in want.items():
        assert roots(cluster.eps_links(df, at)) == all_ and len(all_) > 0
    own = {}
    for k in (0, 1):
        own |= roots(cluster.eps_edges(whole.filter(f"key = {k}"), 0.6))
    assert roots(cluster.grid_links(df, "key", 0.6, block=100)) == own
    known = df.join(cluster.components(cluster.eps_edges(whole, 0.6)), "id", "left").selectExpr("id", "vector", "coalesce(root, id) AS root")
    assert cluster.grid_links(known, None, 0.6, "root").collect() == []
    assert roots(cluster.eps_edges(whole, 0.6).select("a", "b").unionByName(cluster.grid_links(known, None, 0.5, "root"))) == want[0.5]


def test_a_threshold_is_met_in_double_precision(spark):
    """Pairs a hundred-millionth beyond and below the threshold, which single precision cannot tell apart."""
    rows, at = [], 0.6
    for k in range(40):
        sim = at + (1e-8 if k % 2 else -1e-8)
        a, b = np.zeros(80), np.zeros(80)
        a[2 * k], b[2 * k], b[2 * k + 1] = 1, sim, np.sqrt(1 - sim * sim)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    got = roots(cluster.eps_links(spark.createDataFrame(rows, "id long, vector array<double>"), at))
    assert got == {i: 2 * (i // 2) for i in range(80) if i // 2 % 2}


def test_an_index_that_misses_pairs_still_gives_whole_groups(spark, monkeypatch):
    """linked_groups_indexed: with cells that lose most pairs, groups are those of all pairs."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(900, 12))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>")
    unit = index.unit_rows(m)
    bad = index.Cells(index.learned_centres(unit, 40), 1, 0.6)
    monkeypatch.setattr(index, "fit_cells", lambda *a, **k: bad)
    want = roots(cluster.eps_edges(df, 0.6))
    assert roots(index.near(df, 0.6, links=True)) != want
    assert roots(index.near_links(df, 0.6)) == want


def test_linkage_of_a_long_path(spark):
    """avg_linkage_groups: a component whose rows are a path of hundreds of steps."""
    m = [[float(np.cos(i * 0.01)), float(np.sin(i * 0.01))] for i in range(1, 300)]
    got = cluster.linkage_groups(spark.createDataFrame([(0, i, v) for i, v in enumerate(m)], "label int, id long, vector array<double>"), "label", 0.00006).collect()
    want = cluster.cosine_linkage(index.unit_rows(np.array(m)), 0.00006)
    assert {r.id: r.group for r in got} == dict(enumerate(want.tolist()))
