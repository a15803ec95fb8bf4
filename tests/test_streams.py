"""Streams whose state goes from batch to batch, against plain versions over all rows in order."""

import numpy as np
import pandas as pd

from tessella.plans import catalogue


def test_leaders_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    m = np.array([centres[rng.integers(0, 6)] + rng.normal(size=8) * 0.3 for _ in range(120)]).astype(np.float32)
    labels = rng.integers(0, 3, 120)
    pd.DataFrame({"vec_id": np.arange(120), "embedding": list(m), "label": labels}).to_parquet(tmp_path / "embeddings.parquet")
    want, sums = {}, {}
    for i, (v, k) in enumerate(zip(m.astype(float), labels.tolist(), strict=True)):
        v, own, soft = v / np.linalg.norm(v), sums.setdefault(k, []), i % 9 == 0
        sims = [s @ v / np.linalg.norm(s) for s in own]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or (sims[best] < 0.3 and not soft):
            own.append(v)
            want[i] = (str(k), len(own) - 1, True)
        else:
            own[best] = own[best] if soft else own[best] + v
            want[i] = (str(k), best, False)
    got = catalogue.queries()["stream_centroids"](spark, str(tmp_path)).collect()
    assert {r.seq: (r.product, r.leader, r.opened) for r in got} == want and max(x[1] for x in want.values()) >= 2
