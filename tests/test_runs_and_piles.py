"""Brackets and piles against plain loops over random rows."""

import numpy as np

from tessella.operators import geo, sequence


def plain_runs(levels, alike):
    runs = []
    for i, x in enumerate(levels):
        if runs and all(abs(x - levels[j]) >= 0.3 for j in runs[-1]) and alike(i, runs[-1]):
            runs[-1].append(i)
        else:
            runs.append([i])
    return [r[0] for r in runs for _ in r]


def test_runs_of_random_levels():
    rng = np.random.default_rng(11)
    for _ in range(300):
        levels = np.round(rng.normal(size=int(rng.integers(1, 40))) * rng.choice([0.3, 1, 4]), int(rng.integers(0, 4)))
        assert sequence.run_starts(levels).tolist() == plain_runs(levels, lambda i, run: True)


def test_runs_of_random_fields():
    rng = np.random.default_rng(12)
    scenes = [rng.normal(size=(8, 8)) for _ in range(2)]
    for _ in range(30):
        n = int(rng.integers(1, 20))
        levels = rng.normal(size=n) * 4
        fields = [None if rng.random() < 0.2 else scenes[rng.integers(0, 2)] + rng.normal(size=(8, 8)) * 0.2 for _ in range(n)]

        def alike(i, run, fields=fields):
            if fields[i] is None or any(fields[j] is None for j in run):
                return True
            return any(sequence.framing_similarity(fields[i], fields[j]) >= 0.6 for j in run)

        assert sequence.run_starts(levels, fields).tolist() == plain_runs(levels, alike)


def test_flagged_pairs_and_middle(spark):
    row = lambda i, ev, mode: (i, f"d/{i:03d}.jpg", "d", i, float(i), f"{i:05d}", ev, "A", mode, None, None, None, None)
    schema = "id long, rel string, dir string, frame_no long, t double, taken_at string, ev_bias double, camera string, exp_mode int, kind string, fnumber double, exposure_s double, iso long"
    shots = spark.createDataFrame([row(1, 0.0, 2), row(2, 0.5, 2), row(4, 0.0, None), row(5, 0.5, 2), row(7, -1.0, None), row(8, 0.0, None), row(9, 1.0, None)], schema)
    got = sequence.bracket_runs(shots)
    assert {r.id: (r.bracket_id, r.ev) for r in got.collect()} == {1: (1, -0.5), 2: (1, 0.0), 7: (7, -1.0), 8: (7, 0.0), 9: (7, 1.0)}
    assert sorted((r.bracket_id, r.n, r.middle) for r in sequence.middle_of_sets(got, "bracket_id").collect()) == [(1, 2, 2), (7, 3, 8)]
    assert sequence.bracket_runs(shots.limit(0)).count() == 0


def test_piles_of_random_cells(spark):
    rng = np.random.default_rng(13)
    cells = [(None if rng.random() < 0.1 else "pq"[rng.integers(0, 2)], "c", int(rng.integers(1, 9)), float(rng.normal()), float(rng.normal())) for _ in range(80)]
    want = [(n, c, k, lat, lon) for n, c, k, lat, lon in cells if n is None]
    for name in "pq":
        piles = []
        for _, _, k, lat, lon in sorted((x for x in cells if x[0] == name), key=lambda x: (-x[2], x[3], x[4])):
            for q in piles:
                if geo.km_between(np.array(q[1]), np.array(q[2]), lat, lon) <= 50:
                    q[:] = q[0] + k, (q[1] * q[0] + lat * k) / (q[0] + k), (q[2] * q[0] + lon * k) / (q[0] + k)
                    break
            else:
                piles.append([k, lat, lon])
        want += [(name, "c", *q) for q in piles]
    got = geo.merged_piles(spark.createDataFrame(cells, "name string, country string, n long, lat double, lon double"))
    got, want = (sorted((str(n), k, lat, lon) for n, _, k, lat, lon in rows) for rows in (map(tuple, got.collect()), want))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-5)
