"""Whole results on fixtures larger than what an earlier cut let through, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import select


@pytest.mark.parametrize("n", [2, 5, 12])
def test_picks_of_large_products(spark, n):
    rng = np.random.default_rng(n)
    sizes = {0: 60, 1: 300, 2: 90, 3: 200}
    rows = pd.DataFrame([("p", v, i % 3) for v, k in sizes.items() for i in range(k)], columns=["product", "variant", "angle"])
    rows["id"], rows["score"] = np.arange(len(rows)), rng.integers(0, 50, len(rows)) / 50
    got = select.pick_each(spark.createDataFrame(rows[["product", "id", "variant", "angle", "score"]]), n)
    assert sorted(r.id for r in got.collect()) == sorted(select.coverage_pick(rows, n))
