"""Models opened, joined and waited for, against a plain loop over the same batches, with a restart."""

import datetime

import numpy as np

from tessella.plans import catalogue
from tessella.streaming import live, models

SCHEMA = "shoot string, seq long, id long, at timestamp, typed string, face array<double>, soft boolean"
START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
WAIT, LATE = 300, 60


def plain(batches):
    """(shoot, id) -> (model's name or None, how) of batches of rows."""
    people, waiting, out, newest, shown = {}, {}, {}, None, {}

    def unit(v):
        return np.array(v) / np.linalg.norm(v)

    def best(shoot, face):
        own = [(k, face @ s / np.linalg.norm(s)) for k, (_, s) in people.setdefault(shoot, {}).items() if np.linalg.norm(s)]
        return max(own, key=lambda x: x[1], default=(None, -1.0))

    def take(shoot, i, k, face, soft, how):
        out[shoot, i] = (k, how)
        if not soft and face is not None:
            name, s = people[shoot][k]
            people[shoot][k] = (name, s + face)

    def new(shoot, name=None):
        own = people.setdefault(shoot, {})
        k = shown[shoot] = shown.get(shoot, 0) + 1
        if name is None:
            n = 1 + sum(x.startswith("model ") for x, _ in own.values())
            while f"model {n}" in {x for x, _ in own.values()}:
                n += 1
            name = f"model {n}"
        own[k] = (name, np.zeros(16))
        return k

    for batch in [*batches, []]:
        watermark = None if newest is None else newest - datetime.timedelta(seconds=LATE)
        for shoot in sorted({r[0] for r in batch}):
            own = people.setdefault(shoot, {})
            for _, seq, i, at, typed, face, soft in sorted((r for r in batch if r[0] == shoot), key=lambda r: r[1]):
                face = None if face is None else unit(face)
                k, sim = best(shoot, face) if face is not None else (None, -1.0)
                if typed:
                    named = next((n for n, (x, _) in own.items() if x == typed), None)
                    empty = named is None or not np.linalg.norm(own[named][1])
                    if empty and face is not None and not soft and sim >= 0.55 and own[k][0].startswith("model "):
                        if named is None:
                            named = k
                            own[k] = (typed, own[k][1])
                        else:
                            own[named] = (typed, own.pop(k)[1])
                            for x, v in out.items():
                                if x[0] == shoot and v[0] == k:
                                    out[x] = (named, v[1])
                    elif named is None:
                        named = new(shoot, typed)
                    take(shoot, i, named, face, soft, "arrived")
                elif face is None:
                    out[shoot, i] = (None, "never")
                elif sim >= 0.55:
                    take(shoot, i, k, face, soft, "arrived")
                elif soft or sim >= 0.40:
                    waiting[shoot, seq, i] = (face, soft, at + datetime.timedelta(seconds=WAIT))
                else:
                    take(shoot, i, new(shoot), face, soft, "arrived")
            moved = True
            while moved:
                moved = False
                for own_ in sorted(x for x in waiting if x[0] == shoot):
                    face, soft, _ = waiting[own_]
                    k, sim = best(shoot, face)
                    if sim >= 0.55:
                        del waiting[own_]
                        take(shoot, own_[2], k, face, soft, "later")
                        moved |= not soft
        if watermark is not None:
            for own_ in [x for x, v in waiting.items() if v[2] <= watermark]:
                del waiting[own_]
                out[own_[0], own_[2]] = (None, "never")
        newest = max([r[3] for r in batch] + ([newest] if newest else []), default=None)
    return {k: (people[k[0]][m][0] if m is not None else None, how) for k, (m, how) in out.items()}, len(waiting)


def make(rng, n):
    centres = [v / np.linalg.norm(v) for v in rng.normal(size=(5, 16))]
    rows = []
    for i in range(n):
        shoot, who = rng.choice(["a", "b"]), rng.integers(5)
        v = centres[who] + rng.normal(size=16) * rng.choice([0.1, 0.25, 0.3])
        typed = f"P{who}" if rng.random() < 0.04 else None
        face = None if rng.random() < 0.05 else [float(x) for x in v]
        rows.append((str(shoot), i, 1000 + i, START + datetime.timedelta(seconds=15 * i + 1), typed, face, bool(rng.random() < 0.15)))
    return rows


def result(rows):
    told = {(r.shoot, r.id): r.name for r in models.told(rows).collect()}
    how = {(r.shoot, r.id): r.how for r in rows.filter("id IS NOT NULL").collect()}
    return {k: (told.get(k), h) for k, h in how.items()}


def test_batches_and_a_restart(spark, tmp_path):
    rows = make(np.random.default_rng(11), 160)
    batches = [rows[a : a + 40] for a in range(0, 160, 40)]
    base = str(tmp_path)

    def run():
        with live.rich_state(spark):
            return live.drained(models.cast(live.file_stream(spark, f"{base}/in", SCHEMA), wait_s=WAIT, late=f"{LATE} seconds"), f"{base}/out", f"{base}/state")

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if k % 2:
            got = result(run())
    want, left = plain([*batches[:2], [], *batches[2:]])
    assert got == want
    assert len(got) == len(rows) - left
    assert {h for _, h in got.values()} == {"arrived", "later", "never"} and {"P0", "P1"} & {n for n, _ in got.values()}


def test_rules():
    """Two names for one face: the first typed name takes over the model that has none; one made without a face folds it in."""
    s, e = models.Set(), np.eye(3)
    assert s.arrive(1, 1, None, e[0], True, 9) == [] and s.arrive(2, 2, None, e[0], False, 9)[-1][2] == 1
    assert s.settle() == [(1, 1, 1, None, None, "later")] and s.models[1].n == 1
    assert s.arrive(3, 3, "Ann", None, False, 9)[0][3] == "Ann"
    assert [r[5] for r in s.arrive(4, 4, "Ann", e[0], False, 9)] == ["merged", "arrived"] and list(s.models) == [2] and s.models[2].n == 2
    assert [r[5] for r in s.arrive(5, 5, "Bo", e[0], False, 9)] == ["named", "arrived"]
    between = np.array([0.5, 0.0, 0.75**0.5])
    assert s.arrive(6, 6, None, between, False, 9) == [] and s.let_go(8) == [] and s.let_go(9) == [(6, 6, None, None, None, "never")]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)], int(i % 3)) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["stream_models"](spark, str(tmp_path)).collect()
    assert {r.id for r in got} <= set(range(60)) and len({(r.shoot, r.id) for r in got}) == len(got) > 20
