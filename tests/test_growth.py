"""What made time or shuffled bytes grow faster than the input: passes over the input, calls for each small group, wide vectors."""

import numpy as np
import pandas as pd

from tessella.operators import changes, index, products, sequence


def test_pairs_take_one_pass_over_the_files(spark):
    """pair_raw_jpeg: the files were worked out anew for each scope and side."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(f"a/b{i % 5}/IMG_{i // 2}{'.dng' if i % 2 else '.jpg'}", i % 2 == 1, False) for i in range(100)]
    rows += [("x/raw/u1.dng", True, False), ("x/jpg/U1.jpg", False, False), ("y/w.dng", True, False), ("z/q/w.jpg", False, False), ("z/q/w.mov", False, True), ("v.dng", True, False)]
    files = spark.createDataFrame(rows, "rel string, is_raw boolean, is_video boolean").mapInPandas(count, "rel string, is_raw boolean, is_video boolean")
    got = {r.rel: r.sibling for r in changes.pair_raw(files).collect()}
    assert seen.value == len(rows)
    want = {f"a/b{i % 5}/IMG_{i // 2}.jpg": f"a/b{(i + 1) % 5}/IMG_{i // 2}.dng" for i in range(0, 100, 2)}
    assert got == want | {"x/jpg/U1.jpg": "x/raw/u1.dng", "z/q/w.jpg": "y/w.dng", "z/q/w.mov": None, "v.dng": None}


def test_chains_in_batches_of_any_size():
    """bracket_runs: many chains go through one task, some longer than a batch, with folders that are null."""
    rng, rows = np.random.default_rng(2), []
    for chain in range(60):
        for k in range(int(rng.integers(2, 12))):
            rows.append((None if chain % 7 == 0 else f"d{chain % 3}", chain, len(rows), float(rng.integers(0, 6)), 2 if k % 2 else None))
    df = pd.DataFrame(rows, columns=["dir", "chain", "id", "bright", "exp_mode"])
    want = {}
    for _, own in df.groupby("chain"):
        starts = sequence.run_starts(own["bright"].to_numpy())
        want |= dict(zip(own["id"], own["id"].to_numpy()[starts], strict=True))
    for size in (1, 3, 7, 50, 1000):
        got = pd.concat(sequence.chain_runs(df[i : i + size].reset_index(drop=True) for i in range(0, len(df), size)))
        assert dict(zip(got["id"], got["first"], strict=True)) == want and len(got) == len(df)


def test_the_index_sends_vectors_as_they_are(spark):
    """index_recall: vectors in single precision were sent in double."""
    m = np.random.default_rng(1).normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<float>")
    cells = index.fit_cells(df, 0.5, cell_rows=30)
    assert index.assigned(df, cells).schema["v"].dataType.simpleString() == "array<float>"
    unit = index.unit_rows(m.astype(np.float64))
    for r in index.near(df, 0.5, cells).collect():
        assert abs(r.similarity - unit[r.a] @ unit[r.b]) < 1e-12


def test_many_small_products(spark):
    """product_groups: thousands of components in a task."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 32))
    rows = [("s", 2 * i + j, [float(x) + 1e-3 * j for x in v], [float(j * 90), 0.0, 0.0] if i % 2 else None) for i, v in enumerate(m) for j in (0, 1)]
    got = {r.id: (r.product, r.variant, r.view) for r in products.find(spark.createDataFrame(rows, "shoot string, id long, vector array<double>, colour array<double>")).collect()}
    assert got == {2 * i + j: (i, j if i % 2 else 0, 0) for i in range(1500) for j in (0, 1)}
