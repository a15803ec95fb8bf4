"""The pipeline's stages against plain versions of them, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_support import near_classes, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    base = str(tmp_path_factory.mktemp("sf"))
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(240):
        good = i % 6 != 0
        text = "\n".join([line(rng.randint(10, 30)) for _ in range(rng.randint(2, 5))])
        text = text if good else text.upper().replace(" ", "!! ")
        rows.append([i, text + ("\nFooter that all the sites share." if i % 4 == 0 and good else ""), "en", f"s{i % 11}"])
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(i, 0, 0) for i in range(0, 240, 6)]
    bench = [(k, line(14)) for k in range(4)]
    rows[10][1] += "\n" + bench[2][1]
    rows[20][1] = rows[21][1] = rows[23][1]
    w = rows[25][1].split(" ")
    rows[26][1] = " ".join([*w[:-1], "otherwise"])
    rows += [[None, line(30), None, None], [900, None, "en", "s1"], [901, "", "en", "s1"], [1, rows[1][1], "en", "s1"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert after.columns == columns
        seen.append((name, docs.collect(), after.collect()))
        docs = after
    before, after = seen[0][1:]
    ids = {r.doc_id for r in after}
    assert not ids & {*range(0, 240, 6)} and {i for i in range(240) if i % 6} <= ids
    before, after = seen[1][1:]
    text = {r.doc_id: r.text for r in after}
    sharing = [i for i in text if i is not None and i < 240 and i % 4 == 0]
    assert [i for i in sharing if "Footer" in text[i]] == [min(sharing)] and all(r.n_chars == len(r.text) for r in after if r.text is not None)
    before, after = seen[2][1:]
    classes = near_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after if words(r.text) and r.doc_id is not None) == sorted(min(c) for c in classes)
    before, after = seen[3][1:]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10}
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {*final} == {r.doc_id for r in after} and all(r.n_tokens == len(r.token_ids) for r in final.values())
    assert F.lit(1) is not None
