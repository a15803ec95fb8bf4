"""State of a shoot, logs and disks: branches that the tables don't reach, with nulls, ties and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import filters as flt
from tessella.operators import status
from tessella.sources import files
from tessella.streaming import live

ITEMS = "rel string, status string, vector int, n_faces int"


def health(spark, items, jobs, here):
    return status.scan_health(spark.createDataFrame(items, ITEMS), spark.createDataFrame(jobs, "id int, kind string, state string"), spark.createDataFrame([(x,) for x in here], "rel string")).first()


@pytest.mark.parametrize(
    ("items", "jobs", "here", "want"),
    [
        ([], [], [], (None, None)),
        ([("a", "ok", 1, 0)], [], ["a"], (None, None)),
        ([("a", "ok", 1, None)], [], ["a"], (None, "faces")),
        ([("a", "ok", 1, None)], [], ["a", "b"], (None, "rescan")),
        ([("a", "ok", 1, 0)], [(1, "focus", "interrupted"), (2, "scan", "interrupted")], ["b"], ("focus", "focus")),
        ([("a", "ok", 1, 0)], [(1, "focus", "interrupted"), (3, "focus", "done")], ["a"], (None, None)),
        ([("a", "pending", None, None)], [(1, "focus", "interrupted"), (2, "scan", "interrupted")], ["a"], ("scan", "continue")),
        ([("a", "ok", None, None)], [(5, "focus", "interrupted"), (2, "scan", "interrupted")], ["a"], ("focus", "continue")),
    ],
)
def test_what_closes_the_gap(spark, items, jobs, here, want):
    r = health(spark, items, jobs, here)
    assert (r.interrupted, r.fix) == want


def test_reading_on_from_a_place(spark):
    log = spark.createDataFrame([(k, f"e{k}") for k in range(1, 11)], "seq int, ev string")
    got = lambda after, log=log: [(r.seq, r.reset) for r in status.events_since(log, after, 4).orderBy("seq").collect()]
    assert got(8) == [(9, False), (10, False)] and got(10) == [] and got(6) == [(k, False) for k in range(7, 11)]
    assert got(5) == got(11) == [(None, True)]
    assert got(0, log.limit(0)) == [] and got(1, log.limit(0)) == [(None, True)]


def test_counts_of_an_empty_search(spark):
    rows = spark.createDataFrame([(1, "photo", 7), (2, "photo", 7), (3, None, None), (4, "video", 7)], "id long, kind string, burst_id int")
    assert status.result_size(rows, flt.Filters(kind="photos"), ["burst_id"]).first()[:] == (3, 2)
    assert status.result_size(rows.limit(0), flt.Filters(), ["burst_id"]).first()[:] == (0, 0)


def test_sessions_meet_at_the_gap(spark):
    at = [("a", 0), ("a", 10), ("a", 21), ("b", 5), ("b", 5), ("c", None)]
    rows = spark.createDataFrame(at, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = sorted((r.k, r.n) for r in status.sessions(rows, "k", "at", "10 seconds").collect())
    assert got == [("a", 1), ("a", 2), ("b", 2)]


def test_batches_arrive_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
        got = live.delivered(stream, out, state)
        assert sorted(r.id for r in got.collect()) == list(range(k * 10 + 10))
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the run had ended before it was noted
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted(r.id for r in live.delivered(stream, out, state).collect()) == list(range(30))


def test_disk_clips_and_cities(spark, tmp_path):
    disk = tmp_path / "disk"
    stream = bytearray(200)
    stream[4] = stream[196] = 0x47
    for rel, data in {
        "Users/a/x.jpg": b"1", "Users/a/Library/y.jpg": b"1", "System/z.jpg": b"1", "Users/a/P.photoslibrary/originals/o.jpg": b"1", "Users/a/P.photoslibrary/resources/r.jpg": b"1",
        "Users/a/clip.MTS": bytes(stream), "Users/a/types.d.mts": b"export {}",
    }.items():
        (disk / rel).parent.mkdir(parents=True, exist_ok=True)
        (disk / rel).write_bytes(data)
    own, skipped = files.scan(spark, str(disk), disk=True)
    assert sorted(r.rel for r in own.collect()) == ["Users/a/P.photoslibrary/originals/o.jpg", "Users/a/clip.MTS", "Users/a/x.jpg"]
    assert {r.why: r.n for r in skipped.collect()} == {"not looked into": 3, "not a clip": 1}
    plain, _ = files.scan(spark, str(disk))
    assert sorted(r.rel for r in plain.collect()) == ["System/z.jpg", "Users/a/Library/y.jpg", "Users/a/clip.MTS", "Users/a/x.jpg"]
    (tmp_path / "c.json").write_text(json.dumps({"scale": 100, "places": [["Ahmedabad", "IN", 2303, 7258], ["Odd", "XX", "n", None]]}))
    assert [r[:] for r in files.cities(spark, str(tmp_path / "c.json")).collect()] == [("Ahmedabad", "IN", 23.03, 72.58)]


def test_folders_of_the_last_minute(spark):
    rows = [("a/1.jpg", 100.0, 1), ("a/2.arw", 104.0, 1), ("b/3.jpg", 90.0, 1), ("b/c.txt", 100.0, 1), ("c/4.jpg", 20.0, 1), ("d/e/f/g/5.jpg", 99.0, 1), ("d/e/f/g/h/6.jpg", 99.0, 1), ("z/7.jpg", 106.0, 1), ("y/8.jpg", 100.0, 0)]
    df = spark.createDataFrame(rows, "rel string, mtime double, size long")
    assert [(r.dir, r.n) for r in files.recent_folders(df, 100.0, n=9).collect()] == [("a", 2), ("d/e/f/g", 1), ("b", 1)]
    assert files.recent_folders(df, 100.0, n=1, last="b").first().dir == "b"
    assert files.photo_count(spark.createDataFrame([("a/X.jpg",), ("a/x.ARW",), ("b/x.jpg",), ("a/x.txt",)], "rel string")).first().n == 2
