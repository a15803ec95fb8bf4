"""Queries over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.scalars import dot
from tessella.operators import cluster, subject, vectors
from tessella.plans.catalogue import query

V_SQL = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"
CENTROIDS_SQL = """parts AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v) GROUP BY 1, 2),
z AS (SELECT label, sqrt(sum(x * x)) AS norm FROM parts GROUP BY 1),
c AS (SELECT label, list(x / norm ORDER BY pos) AS centroid FROM parts JOIN z USING (label) GROUP BY 1),
g AS (SELECT c.label AS id, n, centroid FROM c JOIN (SELECT label, count(*) AS n FROM v GROUP BY 1) USING (label))"""


def vecs(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def one(spark, sf, i: int) -> list[float]:
    return vecs(spark, sf).filter(F.col("id") == i).first().vector


@query("topk_cosine", f"{V_SQL}, q AS (SELECT vector AS w FROM v WHERE id = 3) SELECT id, round(list_inner_product(vector, w), 6) AS score FROM v, q QUALIFY row_number() OVER (ORDER BY list_inner_product(vector, w) DESC, id) <= 20")
def topk_cosine(spark, sf):
    return vectors.top_k(vecs(spark, sf), "vector", one(spark, sf, 3), 20).select("id", F.round("score", 6).alias("score"))


@query("group_centroids", f"{V_SQL}, {CENTROIDS_SQL} SELECT id AS label, n, round(list_inner_product(centroid, centroid), 6) AS norm, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last FROM g")
def group_centroids(spark, sf):
    c = F.col("centroid")
    return vectors.centroids(vecs(spark, sf), "label", "vector").select("label", "n", F.round(dot(c, c), 6).alias("norm"), F.round(c[0], 6).alias("first"), F.round(c[63], 6).alias("last"))


@query("suggest_pairs", f"""{V_SQL}, {CENTROIDS_SQL} SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, round(list_inner_product(a.centroid, b.centroid), 6) AS similarity
FROM g a JOIN g b ON a.id < b.id WHERE list_inner_product(a.centroid, b.centroid) >= 0.05 AND greatest(a.n, b.n) >= 3""")
def suggest_pairs(spark, sf):
    groups = vectors.centroids(vecs(spark, sf), "label", "vector").withColumnRenamed("label", "id")
    return vectors.suggest_pairs(groups, 0.05).select("a", "b", "n_a", "n_b", F.round("similarity", 6).alias("similarity"))


@query("match_references", f"""{V_SQL}, r AS (SELECT 'ref' || CAST(label AS VARCHAR) AS name, vector AS w FROM v WHERE id < 12),
m AS (SELECT name, label AS photo_id, max(list_inner_product(vector, w)) AS s FROM v, r WHERE id >= 12 GROUP BY 1, 2)
SELECT name, photo_id, round(s, 6) AS similarity, s >= 0.3 AS sure FROM m WHERE s >= 0.3""")
def match_references(spark, sf):
    v = vecs(spark, sf)
    refs = v.filter("id < 12").select(F.concat(F.lit("ref"), F.col("label").cast("string")).alias("name"), "vector")
    faces = v.filter("id >= 12").select(F.col("label").alias("photo_id"), "vector")
    return vectors.match_references(faces, refs, 0.3).select("name", "photo_id", F.round("similarity", 6).alias("similarity"), "sure")


@query("best_face_per_photo", f"""{V_SQL}, q AS (SELECT vector AS w FROM v WHERE id = 5), s AS (SELECT label AS photo_id, id, list_inner_product(vector, w) AS s FROM v, q)
SELECT photo_id, id AS face_id, round(s, 6) AS similarity FROM s WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY s DESC, id) = 1""")
def best_face_per_photo(spark, sf):
    faces = vecs(spark, sf).select(F.col("label").alias("photo_id"), F.col("id").alias("face_id"), "vector")
    return vectors.best_per_photo(faces, one(spark, sf, 5), 0.1).withColumn("similarity", F.round("similarity", 6))


ZERO_SQL = f"""{V_SQL}, {CENTROIDS_SQL},
o AS (SELECT CASE WHEN id = 9 THEN '__other__' ELSE 'cat' || CAST(id AS VARCHAR) END AS owner, id % 4 AS family, centroid FROM g),
s AS (SELECT v.id, owner, family, max(list_inner_product(vector, centroid)) AS cos FROM v, o GROUP BY 1, 2, 3),
e AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY id)) * 20) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY cos DESC, owner) AS r FROM e),
b AS (SELECT * FROM p WHERE r = 1),
f AS (SELECT b.*, coalesce((SELECT max(x.p) FROM p x WHERE x.id = b.id AND x.family <> b.family), 0) AS p2, (SELECT arg_min(y.owner, y.r) FROM p y WHERE y.id = b.id AND y.owner <> '__other__') AS guess FROM b)
SELECT id, CASE WHEN owner <> '__other__' AND cos >= 0.02 AND p >= 0.2 AND p - p2 >= 0.05 THEN owner ELSE 'other' END AS category, guess, round(p, 6) AS p_best, round(p - p2, 6) AS margin FROM f"""


@query("zero_shot_softmax", ZERO_SQL)
def zero_shot_softmax(spark, sf):
    v = vecs(spark, sf)
    c = vectors.centroids(v, "label", "vector")
    owner = F.when(F.col("label") == 9, "__other__").otherwise(F.concat(F.lit("cat"), F.col("label").cast("string")))
    prompts = c.select(owner.alias("owner"), (F.col("label") % 4).alias("family"), F.col("centroid").alias("vector"))
    out = vectors.zero_shot(v, prompts, temperature=20.0, min_prob=0.2, margin=0.05)
    return out.select("id", "category", "guess", F.round("p_best", 6).alias("p_best"), F.round("margin", 6).alias("margin"))


@query("aerial_gap", f"{V_SQL} SELECT a.id, round(max(CASE WHEN p.id < 3 THEN list_inner_product(a.vector, p.vector) END) - max(CASE WHEN p.id >= 3 THEN list_inner_product(a.vector, p.vector) END), 6) AS gap FROM v a, v p WHERE p.id < 6 GROUP BY 1")
def aerial_gap(spark, sf):
    v = vecs(spark, sf)
    return vectors.aerial_gap(v, v.filter("id < 3"), v.filter("id >= 3 AND id < 6")).select("id", F.round("gap", 6).alias("gap"))


@query("eps_components", f"""{V_SQL}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_inner_product(a.vector, b.vector) >= 0.38),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS root FROM r GROUP BY 1) SELECT id, root FROM r""")
def eps_components(spark, sf):
    return cluster.linked_groups(vecs(spark, sf), 0.38)


def _same(v):
    """Decisions (a, b) over all ids, where both are in the table."""
    pairs = v.filter("id % 50 = 1").select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"))
    return pairs.join(v.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


@query("linked_groups_kept_names", f"""{V_SQL}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_inner_product(a.vector, b.vector) >= 0.4
  UNION SELECT a.id, b.id FROM v a JOIN v b ON b.id = a.id + 100 WHERE a.id % 50 = 1 UNION SELECT b.id, a.id FROM v a JOIN v b ON b.id = a.id + 100 WHERE a.id % 50 = 1),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS root FROM r GROUP BY 1)
SELECT root, count(*) AS n FROM r GROUP BY 1""")
def linked_groups(spark, sf):
    v = vecs(spark, sf)
    return cluster.linked_groups(v, 0.4, _same(v)).groupBy("root").agg(F.count("*").alias("n"))


@query("linked_groups_named")
def linked_groups_named(spark, sf):
    v = vecs(spark, sf)
    old = v.filter("id % 4 = 1").select("id", F.concat(F.lit("name "), (F.col("id") % 30).cast("string")).alias("name"))
    groups = cluster.linked_groups(v, 0.4, _same(v))
    return groups.join(cluster.kept_names(groups, old), "root", "left").select("id", "root", "name")


@query("kmeans_named")
def kmeans_named(spark, sf):
    words = np.eye(64)[:12]
    return cluster.named_clusters(vecs(spark, sf), [f"word {i}" for i in range(12)], words)


@query("avg_linkage_groups")
def avg_linkage_groups(spark, sf):
    return cluster.linkage_groups(vecs(spark, sf), "label", 0.7)


PEOPLE_SQL = f"""{V_SQL}, q AS (SELECT * FROM v WHERE id % 7 <> 0), e AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.id <> b.id WHERE list_inner_product(a.vector, b.vector) >= 0.38),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS root FROM r GROUP BY 1)
SELECT root, count(DISTINCT id // 3) AS n, count(*) AS faces, arg_max(id, (id * 37 % 101) * 1000 - id) AS cover FROM r GROUP BY 1"""


@query("people_listing", PEOPLE_SQL)
def people_listing(spark, sf):
    from tessella.operators import people

    v = vecs(spark, sf)
    faces = v.select("id", "vector", F.floor(F.col("id") / 3).alias("photo_id"), ((F.col("id") * 37) % 101).alias("score"), F.when(F.col("id") % 7 == 0, 8).otherwise(20).alias("w"), F.lit(20).alias("h"), F.lit(50.0).alias("eye_sharp"))
    return people.listing(people.grouped(faces, 0.62), faces).select("root", "n", "faces", "cover")


@query("product_groups")
def product_groups(spark, sf):
    from tessella.operators import products

    v = vecs(spark, sf)
    colour = F.when(F.col("id") % 5 != 0, F.array((F.col("id") % 3 * 30.0), F.lit(0.0), F.lit(0.0)))
    # Three nearly equal rows for every vector: products of three.
    near = F.transform("vector", lambda x, i: x.cast("double") + F.when(i == F.col("j"), 0.05).otherwise(0.0))
    rows = v.withColumn("j", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select("label", (F.col("id") * 3 + F.col("j")).alias("id"), near.alias("vector"), colour.alias("colour"))
    return products.find(rows, "label")


@query("subject_masks")
def subject_masks(spark, sf):
    """Every vector as a picture of 8 x 8 pixels: how many are the subject's, and in how many parts."""
    found = subject.subject_masks(vecs(spark, sf).select("id", F.transform("vector", lambda x: x.cast("double") * 100).alias("p")), "p", 8, 8)
    return found.select("row.id", F.size(F.filter("mask", lambda m: m)).alias("pixels"), "parts", "box", F.round("share", 9).alias("share"))
