"""Bursts and brackets over a live window against a plain loop, over several batches and a restart."""

import random

import pytest

from tessella.plans import catalogue
from tessella.streaming import live, runs

FIELDS = [[float((7 * i * k) % 11) for i in range(64)] for k in (1, 3)]
SCHEMA = f"shoot string, seq long, {runs.FRAME}"


def plain(frames):
    """All frames of one shoot, in order of arrival: what each is in at the end. Sets are lists that nothing is forgotten of."""
    shots, sets = {}, {}

    def leave(kind, i):
        members = sets[kind, shots[i][kind]]
        members.remove(i)
        if len(members) == 1:
            del sets[kind, shots[i][kind]]
            shots[members[0]][kind] = None
        shots[i][kind] = None

    order = []
    for f in frames:
        order.append(f)
        shots[f["id"]] = {"burst": None, "bracket": None, "stops": None}
        window = [x for x in order[-runs.WINDOW :] if x["kind"] != "video" and x["t"] is not None and x["frame_no"] is not None]
        window.sort(key=lambda x: (x["dir"], x["t"], x["rel"]))
        found = runs.brackets(window)
        in_bracket = {x["id"] for run in found for x, _ in run}
        for kind, groups in (("bracket", [[x for x, _ in run] for run in found]), ("burst", runs.bursts(window, in_bracket))):
            for group in groups:
                ids = [x["id"] for x in group]
                have = [shots[i][kind] for i in ids if shots[i][kind] is not None]
                own = min(have or ids)
                for i in ids:
                    if shots[i][kind] != own:
                        if shots[i][kind] is not None:
                            leave(kind, i)
                        shots[i][kind] = own
                        sets.setdefault((kind, own), []).append(i)
        for run in found:
            for x, stops in run:
                shots[x["id"]]["stops"] = stops
                if shots[x["id"]]["burst"] is not None:
                    leave("burst", x["id"])
    return {i: (s["burst"], s["bracket"], s["stops"] if s["bracket"] is not None else None) for i, s in shots.items() if s["burst"] is not None or s["bracket"] is not None}


def make(rng, shoot, n, base):
    """Bursts, brackets and single frames of two bodies; some arrive after later ones."""
    out, t, no = [], 0.0, rng.choice([1, 500])
    while len(out) < n:
        what = rng.choice(["burst", "bracket", "bracket", "alone"]) if out else "long"
        size = {"burst": rng.randint(2, 9), "bracket": rng.choice([2, 3, 5]), "alone": 1, "long": 60}[what]
        t += rng.choice([0.5, 3, 9])
        for k in range(size):
            no, t = no + (what == "long" or rng.random() > 0.01), t + rng.choice([0.1, 0.4])
            bright = [0.0, -2.0, 2.0, -4.0, 4.0][k] if what == "bracket" else 0.0 if what == "long" else rng.choice([0.0, 0.3, None])
            i, plainly = base + len(out), what == "long"
            vector = None if what == "long" else rng.choice([None, [1.0, 0.1 * rng.random()], [1.0, 0.1 * rng.random()], [0.2, 1.0]])
            field = rng.choice([None, FIELDS[0], FIELDS[0], FIELDS[1]]) if what == "bracket" else None
            out.append({
                "id": i, "dir": f"{shoot}/{i % 97 > 90}" if not plainly else shoot, "rel": f"{i:05d}.jpg", "kind": "photo" if plainly else rng.choice(["photo"] * 40 + ["video"]), "t": t if plainly else rng.choice([t] * 60 + [None]), "camera": "A" if plainly else rng.choice(["A"] * 60 + [None]),
                "frame_no": no, "ev": bright, "bright": bright, "exposure_s": 0.01, "exp_mode": 2 if what == "bracket" else 0, "vector": vector, "field": field,
            })
    for _ in range(n // 10):
        a = rng.randrange(len(out) - 6)
        b = a + rng.randint(1, 5)
        out[a], out[b] = out[b], out[a]
    return out


def test_is_worth_something():
    """What is made has bursts beyond the window, and brackets."""
    got = plain(make(random.Random(9), "a", 150, 0))
    assert len({v[1] for v in got.values()}) > 4
    assert max(sum(v[0] == b for v in got.values()) for b in {v[0] for v in got.values()} - {None}) > runs.WINDOW


def result(changes):
    return {(r.shoot, r.id): (r.burst, r.bracket, r.stops) for r in runs.settled(changes).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_alone(seed):
    """The bounded state gives what the plain loop gives, after every frame."""
    rng = random.Random(seed)
    frames, shoot, now = make(rng, "s", 400, 0), runs.Shoot([], {}), {}
    for k, f in enumerate(frames):
        for i, kind, own, stops in shoot.add(dict(f)):
            now[i, kind] = (own, stops)
        if k % 23 == 0 or k == len(frames) - 1:
            got = {}
            for (i, kind), (own, stops) in now.items():
                if own is not None:
                    b = got.get(i, (None, None, None))
                    got[i] = (own, b[1], b[2]) if kind == "burst" else (b[0], own, stops)
            assert got == plain(frames[: k + 1])
        assert len(shoot.frames) <= runs.WINDOW and len(shoot.outside) <= 2 * runs.WINDOW
    assert len({v[0] for v in got.values()}) > 10 and len({v[1] for v in got.values()}) > 10


def test_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(9)
    shoots = {s: make(rng, s, 150, 1000 * n) for n, s in enumerate("ab")}
    rows = [(s, k, *[f[c] for c in runs.NAMES]) for s, frames in shoots.items() for k, f in enumerate(frames)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def land(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        with live.rich_state(spark):
            return live.drained(runs.live_runs(live.file_stream(spark, source, SCHEMA)), out, state)

    for low, high in ((0, 40), (40, 70)):
        land([r for r in rows if low <= r[1] < high])
    run()
    # The query has ended; a new one goes on from its checkpoint, with the ids of before.
    land([r for r in rows if r[1] >= 70])
    got = result(run())
    assert got == {(s, i): v for s, frames in shoots.items() for i, v in plain(frames).items()}
    longest = max(sum(v[0] == b for v in got.values()) for b in {v[0] for v in got.values()} - {None})
    assert longest > runs.WINDOW
    assert result(run()) == got


def test_query_equals_plain(spark, tmp_path):
    rng = random.Random(5)
    events = [(i, rng.randint(0, 5), f"2026-01-{1 + i // 60:02d} 00:{i % 60:02d}:00", rng.choice(["view", "click"]), rng.random() * 100, f'{{"k": {rng.randint(0, 99)}}}') for i in range(400)]
    spark.createDataFrame(events, "event_id long, user_id int, ts string, event_type string, value double, props string").selectExpr(
        "event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    from tessella.functions import scalars as S
    from tessella.plans.items import items
    from pyspark.sql import functions as F

    rows = items(spark, str(tmp_path)).withColumn("ev", S.ev100(F.col("fnumber"), F.col("exposure_s"), F.col("iso"))).withColumn(
        "bright", S.brightness(F.col("fnumber"), F.col("exposure_s"), F.col("iso"), F.col("ev_bias"))).collect()
    shoots = {}
    for r in sorted(rows, key=lambda r: r.frame_no):
        shoots.setdefault(r.dir, []).append({c: r[c] for c in runs.NAMES if c in r} | {"kind": r.kind or "photo", "t": r.t / 40000.0, "exp_mode": None, "vector": None, "field": None})
    got = {(r.shoot, r.id): (r.burst, r.bracket, r.stops) for r in catalogue.queries()["stream_runs"](spark, str(tmp_path)).collect()}
    want = {(s, i): v for s, frames in shoots.items() for i, v in plain(frames).items()}
    assert got == want and want


def test_a_rule_looks_at_neighbours_once(monkeypatch):
    """Two frames are compared when they become neighbours, not with each arrival after that; frames that are gone are let go."""
    calls, real = [0], runs.neighbours

    def counted(a, b):
        calls[0] += 1
        return real(a, b)

    monkeypatch.setattr(runs, "neighbours", counted)
    shoot = runs.Shoot([], {})
    frame = dict.fromkeys(runs.NAMES) | {"dir": "d", "kind": "photo", "camera": "c"}
    for i in range(300):
        shoot.add(frame | {"id": i, "rel": f"{i:04}", "t": i * 0.3, "frame_no": i})
    assert calls[0] <= 2 * 300 and len({f["burst"] for f in shoot.frames}) == 1
    first = shoot.frames[0][runs.repeats][0]
    assert runs.repeats not in first and runs.steps not in first


def test_a_call_for_many_shoots(spark, tmp_path, monkeypatch):
    """Shoots share lanes, whose state is read and written by chunks: far fewer calls than shoots, and the same result over triggers."""
    rng = random.Random(11)
    shoots = {f"s{n}": make(rng, f"s{n}", 70, 1000 * n) for n in range(40)}
    rows = [(s, k, *[f[c] for c in runs.NAMES]) for s, frames in shoots.items() for k, f in enumerate(frames)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 33), (33, 50), (50, 100)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    with live.rich_state(spark):
        changes = live.drained(runs.live_runs(live.file_stream(spark, source, SCHEMA), lanes=3), out, state)
    assert result(changes) == {(s, i): v for s, frames in shoots.items() for i, v in plain(frames).items()}

    class State(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def getValue(self, key):  # noqa: N802
            State.calls += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            State.calls += 1
            self[key] = value

    import pandas as pd

    own, table = runs.Runs(), pd.DataFrame(rows, columns=["shoot", "seq", *runs.NAMES])
    own.chunks, got = State(), []
    for low, high in ((0, 33), (33, 50), (50, 100)):
        got += own.handleInputRows((0,), iter([table[(table.seq >= low) & (table.seq < high)]]), None)
    assert State.calls <= 3 * 2 * runs.CHUNKS and len(pd.concat(got)) == changes.count()


@pytest.mark.parametrize("seed", [4, 5])
def test_only_what_is_next_to_a_change_is_done_again(seed, monkeypatch):
    """Single frames in order are looked at once, however many are in the window; shoots come back from the state as they went."""
    looked, real = [0], runs.brackets
    monkeypatch.setattr(runs, "brackets", lambda stills: (looked.__setitem__(0, looked[0] + len(stills)), real(stills))[1])
    shoot = runs.Shoot([], {})
    frame = dict.fromkeys(runs.NAMES) | {"dir": "d", "kind": "photo", "camera": "c"}
    for i in range(200):
        shoot.add(frame | {"id": i, "rel": f"{i:04}", "t": i * 60.0, "frame_no": i})
    assert looked[0] <= 2 * 200
    monkeypatch.setattr(runs, "brackets", real)
    frames, one, two = make(random.Random(seed), "s", 300, 0), runs.Shoot([], {}), runs.Shoot([], {})
    for k, f in enumerate(frames):
        assert one.add(dict(f)) == two.add(dict(f))
        if k % 3 == 0:
            two = runs.unpacked(runs.packed(two))
