"""Zip archives as source and sink: round trips, hostile members, two-step commits."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import archives


def rows_of(df):
    return sorted((r.name, bytes(r.payload)) for r in df.collect())


def test_round_trip(spark, tmp_path):
    want = [(f"thumbs/{i % 3}/é {i}.{'jpg' if i % 2 else 'json'}", bytes([i % 256]) * (i * 37 % 5000)) for i in range(300)]
    path = str(tmp_path / "out")
    archives.write_zipped(spark.createDataFrame(want, "name string, payload binary").repartition(4), path)
    for part_bytes in (archives.PART_BYTES, 2000):
        got = archives.read_zipped(spark, path, part_bytes=part_bytes)
        assert rows_of(got) == sorted(want) and got.filter(F.length("payload") != F.col("size")).count() == 0
    assert archives.read_zipped(spark, path, part_bytes=2000).rdd.getNumPartitions() > archives.read_zipped(spark, path).rdd.getNumPartitions() == 4
    bare = archives.read_zipped(spark, path, payload=False).collect()
    assert all(r.payload is None for r in bare) and sum(r.size for r in bare) == sum(len(p) for _, p in want)
    # Any other program opens them.
    names = [n for f in (tmp_path / "out").glob("*.zip") for n in zipfile.ZipFile(f).namelist()]
    assert sorted(names) == sorted(n for n, _ in want)


def test_append_overwrite_and_what_is_not_noted(spark, tmp_path):
    path = str(tmp_path / "out")
    one = lambda n: spark.createDataFrame([(n, b"x")], "name string, payload binary")
    archives.write_zipped(one("a"), path)
    archives.write_zipped(one("b"), path)
    assert rows_of(archives.read_zipped(spark, path)) == [("a", b"x"), ("b", b"x")]
    # What a task has left that was never committed is not seen.
    with zipfile.ZipFile(tmp_path / "out" / "part-lost.zip", "w") as z:
        z.writestr("lost", b"y")
    assert rows_of(archives.read_zipped(spark, path)) == [("a", b"x"), ("b", b"x")]
    archives.write_zipped(one("c"), path, "overwrite")
    assert rows_of(archives.read_zipped(spark, path)) == [("c", b"x")]


def test_empty_and_null(spark, tmp_path):
    path = str(tmp_path / "out")
    archives.write_zipped(spark.createDataFrame([], "name string, payload binary"), path)
    assert archives.read_zipped(spark, path).collect() == [] and not list((tmp_path / "out").glob("*.zip"))
    archives.write_zipped(spark.createDataFrame([("n", None)], "name string, payload binary"), path)
    assert rows_of(archives.read_zipped(spark, path)) == [("n", b"")]
    with pytest.raises(Exception, match="no name for a member"):
        archives.write_zipped(spark.createDataFrame([(None, b"")], "name string, payload binary"), path)
    assert rows_of(archives.read_zipped(spark, path)) == [("n", b"")]
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert archives.read_zipped(spark, str(tmp_path / "none.zip")).collect() == []


@pytest.mark.parametrize("name", ["../up", "a/../../up", "/etc/x", "C:/x", "a\\..\\b", "a//b", "./a"])
def test_hostile_members(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("good", b"1")
        z.writestr(name, b"2")
    for part_bytes in (archives.PART_BYTES, 10):
        with pytest.raises(Exception, match="refused for its member"):
            archives.read_zipped(spark, str(tmp_path / "bad.zip"), part_bytes=part_bytes).collect()


def test_links_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "link.zip", "w") as z:
        info = zipfile.ZipInfo("link")
        info.external_attr = 0o120777 << 16
        z.writestr(info, "/etc/passwd")
    with pytest.raises(Exception, match="refused for its member"):
        archives.read_zipped(spark, str(tmp_path / "link.zip")).collect()


def test_report(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "REPORT_LINES", 40)
    events = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("ev"))
    path = str(tmp_path / "report")
    archives.write_zipped(archives.report_members(events, events.groupBy("ev").count(), ["seq"]), path)
    got = dict(rows_of(archives.read_zipped(spark, path)))
    assert sorted(got) == ["events-00000.jsonl", "events-00001.jsonl", "events-00002.jsonl", "summary.jsonl"]
    lines = [json.loads(x) for k in sorted(got)[:3] for x in got[k].decode().splitlines()]
    assert [x["seq"] for x in lines] == list(range(100)) and len(got["summary.jsonl"].splitlines()) == 3
