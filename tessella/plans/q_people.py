"""Queries over people, picks, saved names and the rest of a shoot's tables.

Orders stand for pictures, their lines for faces, suppliers for people; a line is a frame of a shoot's cull too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import changes, people, products, rollups, vectors
from tessella.plans.catalogue import query
from tessella.plans.items import table
from tessella.plans.q_vectors import V_SQL, one, vecs

PICTURES_SQL = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'ok' END AS status, o_custkey % 5 AS n_faces,
  CASE WHEN o_orderkey % 4 = 0 THEN 'video' WHEN o_orderkey % 9 <> 0 THEN 'photo' END AS kind, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"""
FACES_SQL = f"""{PICTURES_SQL}, f AS (SELECT l_orderkey AS photo_id, CASE WHEN l_partkey % 9 <> 0 THEN l_suppkey END AS person_id FROM lineitem),
w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 1 THEN ' ' || n_name || ' ' WHEN s_suppkey % 6 = 2 THEN '' WHEN s_suppkey % 6 > 0 THEN n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
CULL_SQL = """c AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 40 AS INTEGER) AS product, CAST(l_partkey % 3 AS INTEGER) AS variant, CAST(l_linenumber % 4 AS INTEGER) AS angle, l_returnflag = 'R' AS pick,
  CASE WHEN l_partkey % 5 = 0 THEN 'blown' WHEN l_partkey % 5 = 1 THEN 'cut' END AS reason FROM lineitem)"""


def pictures(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "P", "missing").otherwise("ok").alias("status"), (F.col("o_custkey") % 5).alias("n_faces"),
        F.when(k % 4 == 0, "video").when(k % 9 != 0, "photo").alias("kind"), F.floor("o_totalprice").alias("size"),
    )


def faces(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_suppkey")).alias("person_id"))


def persons(spark, sf):
    k, n = F.col("s_suppkey") % 6, F.col("n_name")
    name = F.when(k == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 2, "").when(k > 0, n)
    both = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select(F.col("s_suppkey").alias("id"), name.alias("name"))


def cull(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 40).cast("int").alias("product"), (F.col("l_partkey") % 3).cast("int").alias("variant"),
        (F.col("l_linenumber") % 4).cast("int").alias("angle"), (F.col("l_returnflag") == "R").alias("pick"), F.when(F.col("l_partkey") % 5 == 0, "blown").when(F.col("l_partkey") % 5 == 1, "cut").alias("reason"),
    )


@query("photo_names", f"""WITH {FACES_SQL} SELECT photo_id, list_sort(list(DISTINCT trim(name))) AS names FROM f JOIN w ON f.person_id = w.id JOIN p ON p.id = f.photo_id WHERE p.status = 'ok' AND trim(name) <> '' GROUP BY 1""")
def photo_names(spark, sf):
    return people.photo_names(faces(spark, sf), persons(spark, sf), pictures(spark, sf))


@query("person_folders", f"""WITH {FACES_SQL} SELECT 'people/' || trim(coalesce(nullif(name, ''), 'person_' || CASE WHEN w.id < 10 THEN '0' ELSE '' END || CAST(w.id AS VARCHAR))) AS folder, photo_id
FROM (SELECT DISTINCT person_id, photo_id FROM f) f JOIN w ON f.person_id = w.id UNION ALL SELECT 'groups', id FROM p WHERE status = 'ok' AND n_faces >= 3 UNION ALL SELECT 'solo', id FROM p WHERE status = 'ok' AND n_faces = 1""")
def person_folders(spark, sf):
    return people.person_folders(faces(spark, sf), persons(spark, sf), pictures(spark, sf))


@query("numbered_folders", """WITH s AS (SELECT 'n' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ':' WHEN p_partkey % 3 = 1 THEN '/' ELSE '_' END || substr(p_brand, 7) AS name, p_partkey AS seq FROM part),
o AS (SELECT name, min(seq) AS seq, regexp_replace(name, '[:/]', '_') AS folder FROM s GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS r FROM o)
SELECT name, folder || CASE WHEN r > 1 THEN '_' || CAST(r AS VARCHAR) ELSE '' END AS folder FROM n""")
def numbered_folders(spark, sf):
    k = F.col("p_partkey") % 3
    name = F.concat(F.lit("n"), F.col("p_size").cast("string"), F.when(k == 0, ":").when(k == 1, "/").otherwise("_"), F.substring("p_brand", 7, 100))
    return people.numbered_folders(table(spark, sf, "part").select(name.alias("name"), F.col("p_partkey").alias("seq")))


@query("filter_person_and_pile", f"WITH {FACES_SQL} SELECT id FROM p WHERE id IN (SELECT photo_id FROM f WHERE person_id = 3) AND status = 'ok' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def filter_person_and_pile(spark, sf):
    pile = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id")).distinct()
    return people.with_people(pictures(spark, sf), faces=faces(spark, sf), person_id=3, pile=pile).select("id")


@query("pile_summary", f"WITH {PICTURES_SQL} SELECT count(*) AS n, count(*) - count(*) FILTER (kind = 'video') AS photos, count(*) FILTER (kind = 'video') AS videos, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM p WHERE status = 'ok' AND id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def pile_summary(spark, sf):
    pile = table(spark, sf, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seq"))
    return rollups.pile_summary(pile, pictures(spark, sf))


@query("cull_counts", f"""WITH {CULL_SQL} SELECT 'photos' AS what, 'all' AS key, count(*) AS n FROM c UNION ALL SELECT 'picked', 'all', count(*) FILTER (pick) FROM c
UNION ALL SELECT 'products', 'all', count(DISTINCT product) FROM c UNION ALL SELECT 'rejected', reason, count(*) FROM c WHERE reason IS NOT NULL AND NOT pick GROUP BY reason""")
def cull_counts(spark, sf):
    return rollups.cull_counts(cull(spark, sf))


@query("cull_products", f"""WITH {CULL_SQL} SELECT product, count(*) AS n, count(*) FILTER (pick) AS picked, count(*) FILTER (NOT pick AND reason IS NOT NULL) AS rejected, count(*) FILTER (NOT pick AND reason IS NULL) AS spare,
first(id ORDER BY variant, angle, id) AS cover FROM c GROUP BY 1""")
def cull_products(spark, sf):
    return rollups.cull_products(cull(spark, sf))


@query("cull_plan", f"""WITH {CULL_SQL}, x AS (SELECT *, CASE WHEN product = 0 THEN 'not matched to a product' WHEN product % 2 = 0 THEN 'Shirt ' || CAST(product AS VARCHAR) ELSE 'product ' || CAST(product AS VARCHAR) END AS name,
CASE WHEN product = 0 THEN '' WHEN variant = 1 THEN 'red' ELSE 'colour ' || CAST(variant AS VARCHAR) END AS colour FROM c)
SELECT id, CASE WHEN pick THEN name || '/' || CASE WHEN colour = '' THEN 'export' ELSE colour END END AS folder, name, colour, CASE WHEN angle = 0 THEN '' ELSE 'angle ' || CAST(angle AS VARCHAR) END AS angle,
CASE WHEN pick THEN 'picked' ELSE 'left out' END AS status, CASE WHEN pick THEN '' WHEN reason = 'blown' THEN 'too bright' WHEN reason = 'cut' THEN 'cut off' ELSE 'not needed for the target' END AS why FROM x""")
def cull_plan(spark, sf):
    keys = cull(spark, sf).select("product", "variant").distinct()
    names = keys.select("product").distinct().filter("product % 2 = 0 AND product > 0").withColumn("name", F.concat(F.lit("Shirt "), F.col("product").cast("string")))
    return rollups.cull_plan(cull(spark, sf), names, keys.filter("variant = 1").withColumn("colour", F.lit("red")), {"blown": "too bright", "cut": "cut off"})


@query("score_maps", """SELECT l_orderkey AS photo_id, list_sort(list(cat || '=' || CAST(CAST(best AS BIGINT) AS VARCHAR))) AS scores FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS cat, max(floor(l_quantity)) AS best FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def score_maps(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.concat("l_returnflag", "l_linestatus").alias("category"), F.floor("l_quantity").alias("score"))
    each = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rollups.score_maps(rows).select("photo_id", F.array_sort(each).alias("scores"))


@query("stale_vectors", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 7 > 0) + (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 1 AND (vec_id // 2) % 7 > 0 AND vec_id // 2 IN (SELECT vec_id FROM embeddings)) AS stale")
def stale_vectors(spark, sf):
    v = vecs(spark, sf)
    cut = lambda k: F.when(F.col("id") % k == 0, F.lit(None)).when(F.col("id") % k == 1, F.slice("vector", 1, 32)).otherwise(F.col("vector")).alias("vector")
    items = v.select("id", cut(3), F.when(F.col("id") % 7 > 0, "ok").otherwise("missing").alias("status"))
    return rollups.stale_vectors(items, v.select(F.floor(F.col("id") / 2).alias("photo_id"), cut(5)), 64)


@query("saved_names", f"""{V_SQL}, r AS (SELECT id, 'ref' || CAST(label AS VARCHAR) AS name, 'file ' || CAST(id AS VARCHAR) AS source, vector AS w FROM v WHERE id < 12),
m AS (SELECT name, count(DISTINCT v.id) AS n FROM v, r WHERE v.id >= 12 AND list_inner_product(vector, w) >= 0.3 GROUP BY 1)
SELECT name, list(id ORDER BY id) AS reference_ids, list(source ORDER BY id) AS sources, coalesce(any_value(m.n), 0) AS count FROM r LEFT JOIN m USING (name) GROUP BY name""")
def saved_names(spark, sf):
    v = vecs(spark, sf)
    refs = v.filter("id < 12").select("id", F.concat(F.lit("ref"), F.col("label").cast("string")).alias("name"), F.concat(F.lit("file "), F.col("id").cast("string")).alias("source"), "vector")
    return people.saved_names(refs, vectors.match_references(v.filter("id >= 12").select(F.col("id").alias("photo_id"), "vector"), refs, 0.3))


@query("best_words", f"""{V_SQL}, s AS (SELECT v.id, 'word ' || CAST(w.id AS VARCHAR) AS word, list_inner_product(v.vector, w.vector) AS s FROM v, v w WHERE w.id < 9),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, word) AS r FROM s) SELECT a.id, CASE WHEN a.s >= 0.05 AND a.s - b.s >= 0.01 THEN a.word END AS word FROM t a JOIN t b ON a.id = b.id AND a.r = 1 AND b.r = 2""")
def best_words(spark, sf):
    v = vecs(spark, sf)
    return vectors.best_words(v, v.filter("id < 9").select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("word"), "vector"))


@query("nearest_group", f"""{V_SQL}, parts AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v WHERE id % 4 > 0) GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY pos) AS m FROM parts GROUP BY 1), s AS (SELECT label AS id, list_inner_product(m, (SELECT vector FROM v WHERE id = 8)) / sqrt(list_inner_product(m, m)) AS s FROM c)
SELECT id, round(s, 6) AS similarity FROM s WHERE s > 0.1 ORDER BY s DESC, id LIMIT 1""")
def nearest_group(spark, sf):
    groups = vectors.centroids(vecs(spark, sf).filter("id % 4 > 0"), "label", "vector").withColumnRenamed("label", "id")
    return vectors.nearest_group(groups, one(spark, sf, 8), 0.1).select("id", F.round("similarity", 6).alias("similarity"))


@query("clip_vectors", f"""{V_SQL}, parts AS (SELECT id // 5 AS clip, pos, avg(x) AS x FROM (SELECT id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v) GROUP BY 1, 2)
SELECT clip, round(max(x) / sqrt(sum(x * x)), 6) AS largest, round(sum(x) / sqrt(sum(x * x)), 6) AS total FROM parts GROUP BY 1""")
def clip_vectors(spark, sf):
    frames = vecs(spark, sf).select(F.floor(F.col("id") / 5).alias("clip"), "vector")
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return vectors.centroids(frames, "clip", "vector").select("clip", F.round(F.array_max("centroid"), 6).alias("largest"), F.round(total, 6).alias("total"))


@query("retagged_sums", f"""{V_SQL}, t AS (SELECT CASE WHEN id % 10 = 3 THEN (label + 1) % 10 WHEN id % 10 <> 7 THEN label END AS id, vector FROM v),
x AS (SELECT id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM t WHERE id IS NOT NULL), s AS (SELECT id, pos, sum(x) AS x, count(*) AS n FROM x GROUP BY 1, 2)
SELECT id, max(n) AS n, round(sum(x) FILTER (pos = 1), 6) AS first, round(sum(x), 5) AS total FROM s GROUP BY 1""")
def retagged_sums(spark, sf):
    v, none = vecs(spark, sf), F.lit(None).cast("int").alias("id")
    models = vectors.moved_sums(v.select(none, F.lit(0).cast("long").alias("n"), F.col("vector").cast("array<double>").alias("total")).limit(0), v.select(none.alias("old"), F.col("label").alias("new"), "vector"))
    new = F.when(F.col("id") % 10 == 3, (F.col("label") + 1) % 10)
    moves = v.filter("id % 10 IN (3, 7)").select(F.col("label").alias("old"), new.alias("new"), "vector")
    total = F.aggregate("total", F.lit(0.0), lambda s, x: s + x)
    return vectors.moved_sums(models, moves).select("id", "n", F.round(F.col("total")[0], 6).alias("first"), F.round(total, 5).alias("total"))


@query("byte_sizes", """SELECT o_orderkey, CASE WHEN b >= 1000000000 THEN format('{:.1f} GB', b / 1e9) ELSE format('{:.0f} MB', b / 1e6) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 7919) AS BIGINT) AS b FROM orders)""")
def byte_sizes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.byte_size(F.floor(F.col("o_totalprice") * 7919)).alias("size"))


@query("json_maps", "SELECT event_id AS id, coalesce(json_extract_string(CASE WHEN event_id % 6 > 0 THEN props END, '$.k'), '') AS k, CASE WHEN event_id % 6 > 0 THEN len(json_keys(props)) ELSE 0 END AS n FROM events")
def json_maps(spark, sf):
    broken = F.when(F.col("event_id") % 6 > 0, F.col("props")).when(F.col("event_id") % 12 == 0, F.substring("props", 1, 3))
    return table(spark, sf, "events").withColumn("m", S.json_map(broken)).select(F.col("event_id").alias("id"), F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("")).alias("k"), F.size("m").cast("long").alias("n"))


@query("shot_folders", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 AND l_returnflag = 'A' AND l_linestatus = 'O' THEN 'product' WHEN l_partkey % 3 = 0 OR l_suppkey % 4 = 1 THEN 'model' ELSE 'product' END AS folder FROM lineitem")
def shot_folders(spark, sf):
    model, kind = F.when(F.col("l_partkey") % 3 == 0, "Ann").when(F.col("l_partkey") % 3 == 1, ""), F.when(F.col("l_suppkey") % 4 == 1, "model")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.shot_folder(kind, model, F.col("l_returnflag") == "A", F.col("l_linestatus") == "O").alias("folder"))


@query("rename_product", "SELECT s_suppkey AS product, CASE WHEN s_suppkey = 7 THEN 'Linen shirt' ELSE s_name END AS name, s_suppkey = 7 OR s_suppkey % 2 = 0 AS named FROM supplier")
def rename_product(spark, sf):
    sets = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("product"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("named"))
    return changes.renamed(sets, "product", 7, " Linen shirt ", named=True)


@query("fill_missing", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 25 WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN 50 END AS fps, CASE WHEN o_orderkey % 2 = 0 THEN 'log' WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN 'standard' END AS gamma FROM orders""")
def fill_missing(spark, sf):
    k, o = F.col("id"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "missing").otherwise("ok").alias("status"))
    known = o.select("id", "status", F.when(k % 3 == 0, 25).alias("fps"), F.when(k % 2 == 0, "log").alias("gamma"))
    return changes.fill_missing(known, o.filter("id % 5 > 0").select("id", F.lit(50).alias("fps"), F.lit("standard").alias("gamma"))).drop("status")


@query("seen_once", "SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1")
def seen_once(spark, sf):
    return changes.seen_once(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")), "id", "seq")


@query("located_bounds", "SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, count(lat) AS located, count(*) - count(lat) AS unlocated FROM (SELECT CASE WHEN k % 13 > 0 THEN CAST(user_id % 120 - 60 AS DOUBLE) END AS lat, CASE WHEN k % 13 > 0 THEN CAST((user_id * 7) % 360 - 180 AS DOUBLE) END AS lon FROM (SELECT user_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, event_type FROM events) WHERE event_type <> 'view')")
def located_bounds(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    at = lambda x: F.when(k % 13 > 0, x.cast("double"))
    rows = table(spark, sf, "events").select(at(F.col("user_id") % 120 - 60).alias("lat"), at(F.col("user_id") * 7 % 360 - 180).alias("lon"), F.when(F.col("event_type") == "view", "error").otherwise("ok").alias("status"))
    return rollups.bounds(rows)


@query("attached_strays", f"""{V_SQL}, s AS (SELECT a.id, a.id // 9 AS bunch, h.label AS product, max(list_inner_product(a.vector, h.vector)) AS s FROM v a, v h WHERE a.id % 3 > 0 AND h.id < 200 AND h.id % 3 = 0 GROUP BY 1, 2, 3),
m AS (SELECT bunch, product, avg(s) AS score FROM s GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY bunch ORDER BY score DESC, product) AS r FROM m)
SELECT bunch, CASE WHEN score >= 0.15 THEN product END AS product, round(score, 6) AS score FROM b WHERE r = 1""")
def attached_strays(spark, sf):
    v = vecs(spark, sf)
    home = v.filter("id % 3 = 0 AND id < 200").select(F.col("label").alias("product"), "vector")
    strays = v.filter("id % 3 > 0").select(F.floor(F.col("id") / 9).alias("bunch"), "vector")
    return products.attached(strays, home, 0.15).withColumn("score", F.round("score", 6))
