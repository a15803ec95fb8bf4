"""As-of tags of frames whose files and tags are late, against all events in the order of their time."""

import datetime
import random

from tessella.streaming import live, tags

FRAMES = "shoot string, at timestamp, dir string, stem string, rel string, is_raw boolean, id long"
TAGS = "shoot string, at timestamp, seq long, product string"
START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def when(minute):
    return START + datetime.timedelta(minutes=minute)


def plain(frames, tag_rows):
    out = {}
    for shoot, at, dir_, stem, rel, is_raw, i in frames:
        out.setdefault((shoot, dir_, stem), []).append((at, i, rel, is_raw))
    result = {}
    for own, files in out.items():
        at, first, *_ = min(files)
        std, raw = (next((r for _, _, r, is_raw in sorted(files) if is_raw == want), None) for want in (False, True))
        before = [t for t in tag_rows if t[0] == own[0] and t[1] <= at]
        product = max(before, key=lambda t: t[1:3])[3] if before else None
        result[own] = (first, std or raw, raw if std else None, product)
    return result


def result(df):
    rows = tags.latest(df).collect()
    got = {(r.shoot, r.dir, r.stem): (r.id, r.rel, r.sibling, r.product) for r in rows}
    assert len(got) == len(rows)
    return got


def streams(spark, base):
    return live.file_stream(spark, f"{base}/frames", FRAMES), live.file_stream(spark, f"{base}/tags", TAGS)


def run(spark, base, **options):
    with live.rich_state(spark):
        return live.delivered(tags.tagged(*streams(spark, base), **options), f"{base}/out", f"{base}/state")


def land(spark, base, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")


def test_late_tags_and_late_files(spark, tmp_path):
    rng = random.Random(3)
    frames, tag_rows = [], []
    for i in range(240):
        shoot, stem = rng.choice("ab"), f"s{rng.randrange(110)}"
        raw = rng.random() < 0.5
        frames.append((shoot, when(rng.randrange(600)), "d", stem, f"{stem}{'.arw' if raw else '.jpg'}", raw, i))
    for i in range(30):
        tag_rows.append((rng.choice("ab"), when(rng.randrange(600)), i, rng.choice(["dress", "coat", None])))
    base, held = str(tmp_path), len(frames) // 3
    # Three batches in no order of time; the tags of a batch are not those of its frames.
    for k in range(2):
        land(spark, base, "frames", frames[k * held : (k + 1) * held], FRAMES)
        land(spark, base, "tags", tag_rows[k * 10 : (k + 1) * 10], TAGS)
    first = result(run(spark, base, late="30 days", lanes=3))
    assert first == plain(frames[: 2 * held], tag_rows[:20])
    # A new query goes on from the checkpoint: rows of before get new versions.
    land(spark, base, "frames", frames[2 * held :], FRAMES)
    land(spark, base, "tags", tag_rows[20:], TAGS)
    versions = run(spark, base, late="30 days", lanes=3)
    assert result(versions) == plain(frames, tag_rows) != first
    assert versions.filter("version >= 2").count() > 0
    assert result(run(spark, base, late="30 days", lanes=3)) == plain(frames, tag_rows)


def test_a_late_standard_file_takes_over_the_row(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, "tags", [("a", when(0), 1, "dress")], TAGS)
    land(spark, base, "frames", [("a", when(1), "d", "s", "s.arw", True, 7)], FRAMES)
    assert result(run(spark, base)) == {("a", "d", "s"): (7, "s.arw", None, "dress")}
    land(spark, base, "frames", [("a", when(2), "d", "s", "s.jpg", False, 8)], FRAMES)
    land(spark, base, "tags", [("a", when(2), 2, "coat")], TAGS)
    assert result(run(spark, base)) == {("a", "d", "s"): (7, "s.jpg", "s.arw", "dress")}


def test_state_goes_when_it_is_old(spark, tmp_path):
    """Two days on, the row of before is no longer known: the other file makes a row of its own."""
    base = str(tmp_path)
    land(spark, base, "tags", [("a", when(0), 1, "dress")], TAGS)
    land(spark, base, "frames", [("a", when(1), "d", "s", "s.arw", True, 7)], FRAMES)
    run(spark, base, lanes=1)
    land(spark, base, "frames", [("a", when(3000), "d", "t", "t.jpg", False, 8)], FRAMES)
    run(spark, base, lanes=1)
    land(spark, base, "frames", [("a", when(3001), "d", "s", "s.jpg", False, 9)], FRAMES)
    rows = run(spark, base, lanes=1).filter("stem = 's'").collect()
    assert sorted((r.version, r.id, r.rel, r.product) for r in rows) == [(0, 7, "s.arw", "dress"), (0, 9, "s.jpg", "dress")]


class Held:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: bool(self.data), "get": lambda: self.data[()], "update": lambda v: self.data.update({(): v}), "getValue": lambda k: self.data[k],
            "containsKey": lambda k: k in self.data, "updateValue": lambda k, v: self.data.update({k: v}), "removeKey": lambda k: self.data.pop(k),
        }[name]


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getListState = getMapState

    def registerTimer(self, at):
        pass


def test_many_late_tags_and_many_rows():
    """The pass over the rows is one however many tags are late, with a bounded number of calls to the state."""
    import pandas as pd

    handle, rng = Handle(), random.Random(1)
    step = tags.Tagging(10**15)
    step.init(handle)
    frames = [(rng.randrange(1, 10**9), 0, False, None, "d", str(i), f"{i}.arw", True, i) for i in range(8000)]
    late = [(rng.randrange(1, 10**9), 10**6 + i, True, rng.choice(["dress", "coat", None]), None, None, None, False, 0) for i in range(6000)]
    columns = ["at_us", "seq", "is_tag", "product", "dir", "stem", "rel", "is_raw", "id"]
    got = {}
    for part in (frames[:4000] + late[:10], frames[4000:] + late[10:3000], late[3000:]):
        for out in step.handleInputRows(("s",), iter([pd.DataFrame(part, columns=columns).astype({"product": object})]), None):
            got |= {r.stem: r.product for r in out.itertuples(index=False)}
    in_order = sorted(t[:2] + t[3:4] for t in late)
    assert got == {f[5]: tags.asof(in_order, f[0]) for f in frames}
    assert sum(s.calls for s in handle.states.values()) < 2000
