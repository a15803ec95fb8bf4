"""Names, folders, picks and small matrices against plain Python, with nulls, ties and empty tables."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import changes, people, products, rollups, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def numbered(names):
    """Folders of names in the order in which they were saved, one after the other."""
    taken, out = set(), {}
    for name in dict.fromkeys(names):
        first = "".join("_" if c in "\\/:" else c for c in name).strip(" .") or "export"
        folder, i = first, 2
        while folder in taken:
            folder, i = f"{first}_{i}", i + 1
        taken.add(folder)
        out[name] = folder
    return out


def test_folders_that_meet_a_number_of_another_name(spark):
    names = ["Ann_2", "Ann", "Ann.", " Ann", "Bo/x", "Bo:x", "Bo_x_2", "Bo_x", "Ann", "...", "export"]
    got = people.numbered_folders(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, seq long"))
    assert {r.name: r.folder for r in got.collect()} == numbered(names)
    assert people.numbered_folders(spark.createDataFrame([], "name string, seq long")).count() == 0


def test_similarities_of_vectors_that_do_not_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)] + [(40, None), (41, [1.0]), (42, [1.0, None, 2.0]), (43, [])]
    others = [(k % 4, [float(x) for x in rng.normal(size=3)]) for k in range(9)] + [(2, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got, groups = vectors.with_similarities(df, spark.createDataFrame(others, "g long, vector array<double>"), "g")
    assert groups == [(0,), (1,), (2,), (3,)]
    for r in got.collect():
        if r.id >= 40:
            assert r.sims is None
        else:
            want = [max(float(np.dot(rows[r.id][1], v)) for g, v in others if g == k and v) for k in range(4)]
            assert np.allclose(r.sims, want)
    none, groups = vectors.with_similarities(df, spark.createDataFrame([], "g long, vector array<double>"), "g")
    assert groups == [] and none.count() == len(rows)


def test_words_need_a_lead(spark):
    groups = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [0.01, 0.0]), (4, None)], "id long, vector array<double>")
    words = spark.createDataFrame([("shirt", [1.0, 0.0]), ("shoe", [0.0, 1.0])], "word string, vector array<double>")
    assert {r.id: r.word for r in vectors.best_words(groups, words).collect()} == {1: "shirt", 2: None, 3: None, 4: None}


def test_names_of_a_photo(spark):
    faces = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 12), (3, None), (4, 10)], "photo_id long, person_id long")
    persons = spark.createDataFrame([(10, " Bo "), (11, "Al"), (12, "  "), (13, None)], "id long, name string")
    items = spark.createDataFrame([(1, "ok", 3), (2, "ok", 1), (3, "ok", None), (4, "missing", 1)], "id long, status string, n_faces long")
    matches = spark.createDataFrame([(2, "Cy"), (1, "Bo"), (4, "Di")], "photo_id long, name string")
    assert {r.photo_id: r.names for r in people.photo_names(faces, persons, items, matches).collect()} == {1: ["Al", "Bo"], 2: ["Cy"]}
    folders = sorted((r.folder, r.photo_id) for r in people.person_folders(faces, persons, items).collect())
    assert folders == [("groups", 1), ("people/Al", 1), ("people/Bo", 1), ("people/Bo", 4), ("people/export", 2), ("solo", 2)]


def test_links_sizes_and_json(spark):
    links = {
        "https://drive.google.com/drive/u/0/folders/1AbC_-9?usp=sharing": "1AbC_-9", "https://drive.google.com/open?id=xyz": "xyz", " 0123456789 ": "0123456789",
        "https://docs.google.com/document/d/abc": None, "https://drive.google.com/file/d/abc/folders/x": None, "https://example.org/folders/abc": None, "short": None, "": None,
    }
    for link, want in links.items():
        assert one(spark, S.folder_id(F.lit(link)))[0] == want, link
    for n, want in ((0, "0 MB"), (499_999, "0 MB"), (500_000, "0 MB"), (1_500_000, "2 MB"), (999_999_999, "1000 MB"), (1_250_000_000, "1.2 GB"), (None, None)):
        assert one(spark, S.byte_size(F.lit(n).cast("long")))[0] == want
    for text, want in (('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}), ("[1]", {}), ("{", {}), ("", {}), (None, {})):
        assert one(spark, S.json_map(F.lit(text).cast("string")))[0] == want
    assert one(spark, S.unnamed_group(F.lit("group 12")), S.unnamed_group(F.lit("group x")), S.unnamed_group(F.lit(None).cast("string")))[:] == (True, False, False)


def test_empty_tables_give_totals(spark):
    cull = spark.createDataFrame([], "id long, product int, variant int, angle int, pick boolean, reason string")
    assert sorted((r.what, r.key, r.n) for r in rollups.cull_counts(cull).collect()) == [("photos", "all", 0), ("picked", "all", 0), ("products", "all", 0)]
    items = spark.createDataFrame([], "id long, status string, kind string, size long, lat double, lon double")
    assert rollups.pile_summary(spark.createDataFrame([], "id long, seq long"), items).first()[:] == (0, 0, 0, 0)
    assert rollups.bounds(items).first()[:] == (None, None, None, None, 0, 0)


def test_a_reading_fills_only_nulls_of_ok_rows(spark):
    target = spark.createDataFrame([(1, "ok", None, "a"), (2, "ok", 5, None), (3, "missing", None, None), (4, None, None, None)], "id long, status string, fps long, gamma string")
    read = spark.createDataFrame([(1, 9, "z"), (2, 9, "z"), (2, 9, "z"), (3, 9, "z"), (4, 9, "z"), (7, 9, "z")], "id long, fps long, gamma string")
    got = sorted(changes.fill_missing(target, read).select("id", "fps", "gamma").collect())
    assert [r[:] for r in got] == [(1, 9, "a"), (2, 5, "z"), (3, None, None), (4, None, None)]


def test_sums_follow_moved_frames(spark):
    models = spark.createDataFrame([("a", 2, [3.0, 1.0]), ("b", 1, [1.0, 1.0])], "id string, n long, total array<double>")
    moves = spark.createDataFrame([("a", "c", [1.0, 0.5]), ("b", "a", [1.0, 1.0]), (None, "c", [2.0, 2.0])], "old string, new string, vector array<double>")
    assert {r.id: (r.n, r.total) for r in vectors.moved_sums(models, moves).collect()} == {"a": (2, [3.0, 1.5]), "c": (2, [3.0, 2.5])}


def test_strays_move_by_the_bunch(spark):
    home = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, None)], "product int, vector array<double>")
    strays = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.6, 0.8]), ("b", [0.7, 0.7]), ("c", [0.0, 0.9]), ("d", None)], "bunch string, vector array<double>")
    got = {r.bunch: (r.product, round(r.score, 6)) for r in products.attached(strays, home).collect()}
    assert got == {"a": (1, 0.8), "b": (None, 0.7), "c": (2, 0.9)}
    assert products.attached(strays, home.limit(0)).count() == 0
