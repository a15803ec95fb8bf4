"""Whole results on fixtures larger than what an earlier cut let through, against brute force."""

import numpy as np
import pandas as pd

from tessella.plans import catalogue


def test_every_order_is_paired(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"l_orderkey": rng.integers(1, 300, 800), "l_suppkey": rng.integers(1, 12, 800), "l_linenumber": rng.integers(1, 8, 800).astype("int32")})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    files = {(f"d{r.l_orderkey % 97}", f"img_{r.l_suppkey}_{r.l_orderkey % 13}", r.l_linenumber % 2 == 0) for r in rows.itertuples()}
    rel = lambda d, s, raw: f"{d}/{s.replace('img', 'IMG')}{'.dng' if raw else '.jpg'}"
    want, left = {}, set(files)
    for d, s, raw in files:
        if not raw and (d, s, True) in files:
            want[rel(d, s, False)] = rel(d, s, True)
            left -= {(d, s, True), (d, s, False)}
    for s in {x[1] for x in left}:
        std, raw = ([x for x in left if x[1] == s and x[2] == k] for k in (False, True))
        if len(std) == len(raw) == 1:
            want[rel(*std[0])] = rel(*raw[0])
    want |= {rel(*x): None for x in files if rel(*x) not in want and rel(*x) not in want.values()}
    got = catalogue.queries()["pair_raw_jpeg"](spark, str(tmp_path)).collect()
    assert {r.rel: r.sibling for r in got} == want and len(got) == len(want)
