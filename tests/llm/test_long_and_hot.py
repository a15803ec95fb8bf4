"""Very long texts, and keys that very many rows share."""

import time

from tessella.llm import _common, linededup, warc


def test_many_lines_of_one_document(spark):
    n = 60_000
    rows = [(i, "\n".join(f"line {k}" for k in range(i, i + n)), f"s{i}") for i in range(6)]
    began = time.time()
    got = {r["row"]["doc_id"]: r for r in linededup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert time.time() - began < 120
    # Lines 4 to n stand on five sites or more; line n is first in document 1, the others in document 0.
    assert [got[i]["n_removed"] for i in (0, 1, 4, 5)] == [0, n - 4, n - 3, n - 4]
    assert got[5]["clean"].split("\n") == [x for x in rows[5][1].split("\n") if int(x[5:]) > n]


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(300)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k int, w string")
    hot = spark.createDataFrame([(1,)], "k int")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, ["k"], how).select("k", "v", "w").collect()))
        assert sorted(map(repr, _common.salted_join(left, right, ["k"], hot, how).select("k", "v", "w").collect())) == want


def test_equal_pages_without_broadcast(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "" if i % 3 else f"p{i % 5}") for i in range(4000)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).toPandas()
    assert len(got) == 4000 and (got.record_type == "response").sum() == 6 and got[got.page_id == 3999].refers_to.notna().all()
