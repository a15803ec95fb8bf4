"""Queries over export plans and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import changes, labels, quotas, sequence
from tessella.plans.catalogue import query
from tessella.plans.items import ITEMS_SQL, items, table
from tessella.sources import archives, sinks
from tessella.sources.shared import shared_path

WITH = f"WITH {ITEMS_SQL}"


@query("export_destinations", f"""{WITH}, j AS (SELECT id, category AS folder, 'p' || CAST(frame_no % 40 AS VARCHAR) || '.jpg' AS name FROM items WHERE category IS NOT NULL AND status = 'ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY id) AS r FROM j)
SELECT id, folder || '/' || regexp_replace(name, '\\.jpg$', '') || CASE WHEN r > 1 THEN '_' || CAST(r AS VARCHAR) ELSE '' END || '.jpg' AS dest FROM n""")
def export_destinations(spark, sf):
    own = items(spark, sf).filter("category IS NOT NULL AND status = 'ok'")
    named = own.select("id", F.concat(F.lit("p"), (F.col("frame_no") % 40).cast("string"), F.lit(".jpg")).alias("rel"), "category")
    return sinks.destinations(sinks.export_jobs(named, F.col("category"))).select("id", "dest")


@query("export_reconcile", """WITH p AS (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS size FROM orders), e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS size FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CAST(p.o_orderkey AS VARCHAR) AS dest, CASE WHEN e.size IS NULL THEN 'missing' WHEN e.size = p.size THEN 'already' ELSE 'clash' END AS state FROM p LEFT JOIN e USING (o_orderkey)""")
def export_reconcile(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    plan = o.select(k.cast("string").alias("dest"), F.col("o_custkey").alias("size"), F.lit(10.0).alias("mtime"))
    there = o.filter(k % 3 != 0).select(k.cast("string").alias("dest"), F.when(k % 5 == 0, -1).otherwise(F.col("o_custkey")).alias("size"), F.lit(11.5).alias("mtime"))
    return sinks.reconcile(plan, there)


@query("store_plan", f"""{WITH} SELECT id, camera || '_' || lpad(CAST(row_number() OVER (PARTITION BY camera ORDER BY taken_at NULLS LAST, frame_no NULLS LAST, id) AS VARCHAR), greatest(3, length(CAST(row_number() OVER (PARTITION BY camera ORDER BY taken_at NULLS LAST, frame_no NULLS LAST, id) AS VARCHAR)))::INTEGER, '0') AS name FROM items WHERE camera IS NOT NULL""")
def store_plan(spark, sf):
    return sinks.store_plan(items(spark, sf).filter("camera IS NOT NULL").withColumn("product", F.col("camera"))).select("id", "name")


@query("move_plan", f"""{WITH} SELECT id, CASE WHEN aerial = 1 THEN 'aerial' WHEN kind = 'video' THEN 'videos' WHEN n_faces = 1 THEN 'p' || CAST(user_id AS VARCHAR) ELSE coalesce(nullif(category, 'other'), cluster, 'other') END AS folder FROM items""")
def move_plan(spark, sf):
    rows = items(spark, sf).withColumn("person", F.when(F.col("n_faces") == 1, F.concat(F.lit("p"), F.col("user_id").cast("string"))))
    return sinks.move_plan(rows).select("id", F.substring_index("dest", "/", 1).alias("folder"))


@query("segment_bytes", "SELECT o_orderkey AS id, CAST(trunc(least(60.0 / CAST(o_totalprice AS DOUBLE), 1) * o_custkey + least(30000.0 / CAST(o_totalprice AS DOUBLE), 1) * o_custkey + 1e-6) AS BIGINT) AS bytes FROM orders")
def segment_bytes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("size"), F.col("o_totalprice").cast("double").alias("duration"))
    spans = o.select("id", F.explode(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(60.0).alias("end")), F.struct(F.lit(60.0).alias("start"), F.lit(30060.0).alias("end")))).alias("s")).select("id", "s.*")
    return sinks.segment_bytes(o, spans)


@query("flicker_verdicts", """WITH r AS (SELECT o_custkey AS clip, o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'unknown' ELSE 'mains 50' END AS kind FROM orders),
c AS (SELECT clip, count(*) FILTER (WHERE kind <> 'unknown') AS u, count(*) FILTER (WHERE kind = 'mains 50') AS p FROM r GROUP BY 1)
SELECT clip, CASE WHEN u = 0 THEN 'unknown' WHEN p = 0 THEN 'none' WHEN p * 2 > u THEN 'mains 50' ELSE 'unknown' END AS kind FROM c""")
def flicker_verdicts(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "none").when(k % 4 == 1, "unknown").otherwise("mains 50")
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("clip"), k.alias("run"), kind.alias("kind"), F.when(k % 4 > 1, F.lit(4.0)).alias("hz"), F.lit(0.1).alias("strength"))
    return labels.combined_verdict(runs).select("clip", "kind")


@query("latest_jobs", "SELECT o_orderpriority AS kind, max(o_orderkey) AS id FROM orders GROUP BY 1")
def latest_jobs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"))
    return sequence.latest_per(o, "kind", F.desc("id"))


@query("replace_children", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1) OR l_linenumber = 1 GROUP BY 1")
def replace_children(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return changes.replace_children(rows, rows.filter("l_orderkey % 3 = 0 AND l_linenumber = 1"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("sidecar_cards", f"""{WITH} SELECT regexp_replace(rel, '\\.jpg$', '.xmp') AS path, CASE WHEN flag = 'reject' THEN -1 ELSE coalesce(rating, 0) END AS stars FROM items WHERE flag IS NOT NULL OR coalesce(rating, 0) > 0 OR label IS NOT NULL""")
def sidecar_cards(spark, sf):
    return sinks.sidecars(items(spark, sf)).select("path", F.regexp_extract("xml", 'Rating="(-?[0-9]+)"', 1).cast("long").alias("stars"))


RULES_SQL = f"""{WITH}, r AS (SELECT id, kind, coalesce(sharp, 0.0) / 100 AS people_p, (id % 50) / 60.0 AS interview_p, category, guess, duration * 10 AS duration, n_faces, category_score AS score, category_guess_score AS guess_score, scene, scene_p FROM (SELECT *, CASE WHEN category = 'view' THEN 'interview' ELSE category_guess END AS guess, 'beach' AS scene, (id % 100) / 300.0 AS scene_p FROM items)),
f AS (SELECT *, coalesce(kind = 'video' AND duration >= 600 AND (coalesce(category IN ('people', 'interview'), FALSE) OR coalesce(guess IN ('people', 'interview'), FALSE)), FALSE) AS talk FROM r),
g AS (SELECT *, coalesce(n_faces >= 1, FALSE) AS faces FROM f)
SELECT id, CASE WHEN faces THEN 'people' WHEN talk THEN 'interview' ELSE category END AS new_category, CASE WHEN faces THEN 1.0 WHEN talk THEN greatest(people_p, interview_p) ELSE score END AS new_score,
CASE WHEN NOT faces THEN CASE WHEN talk THEN 'interview' ELSE guess END WHEN NOT talk AND coalesce(category NOT IN ('people', 'interview', 'other'), FALSE) THEN category WHEN scene_p >= 0.15 THEN scene ELSE 'people' END AS new_guess FROM g"""


@query("classify_rules", RULES_SQL)
def classify_rules(spark, sf):
    from tessella.operators import rules

    guess = F.when(F.col("category") == "view", "interview").otherwise(F.col("category_guess"))
    rows = items(spark, sf).select(
        "id", "kind", (F.coalesce("sharp", F.lit(0.0)) / 100).alias("people_p"), ((F.col("id") % 50) / 60.0).alias("interview_p"), "category", guess.alias("guess"), (F.col("duration") * 10).alias("duration"), "n_faces", F.col("category_score").alias("score"),
        F.col("category_guess_score").alias("guess_score"), F.lit("beach").alias("scene"), ((F.col("id") % 100) / 300.0).alias("scene_p"),
    )
    return rules.classified(rows).select("id", "new_category", "new_score", "new_guess")


@query("lifecycle", """WITH k AS (SELECT o_orderkey AS rel, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'pending' WHEN 2 THEN 'missing' ELSE 'error' END AS status FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT o_orderkey AS rel, CASE WHEN o_orderkey % 9 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM (SELECT coalesce(k.rel, s.rel) AS rel, CASE WHEN outcome IS NOT NULL THEN outcome WHEN status = 'ok' THEN 'missing' WHEN status = 'pending' THEN NULL ELSE status END AS status FROM k FULL JOIN s ON k.rel = s.rel) WHERE status IS NOT NULL""")
def lifecycle(spark, sf):
    from tessella.operators import rules

    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    known = o.filter(k % 5 != 0).select(k.alias("rel"), F.when(k % 4 == 0, "ok").when(k % 4 == 1, "pending").when(k % 4 == 2, "missing").otherwise("error").alias("status"))
    return rules.lifecycle(known, o.filter(k % 3 == 0).select(k.alias("rel"), F.when(k % 9 == 0, "error").otherwise("ok").alias("outcome")))


@query("pick_quotas")
def pick_quotas(spark, sf):
    """A shop for each source, with picks for six in five of its documents, of which most take fewer than their share."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    products = docs.select(F.col("source").alias("shop"), F.col("doc_id").alias("product"), (F.col("doc_id") % 7 + 1).alias("weight"), (F.col("doc_id") % 4).alias("cap"))
    return quotas.apportioned(products, products.groupBy("shop").agg(F.floor(F.count("*") * 6 / 5).alias("total")))


@query("zip_round_trip", """SELECT 'p/' || CAST(page_id % 100 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.html' AS name, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS hash FROM pages""")
def zip_round_trip(spark, sf):
    """Every page as a member of archives in the shared folder, read back."""
    number = lambda c: c.cast("string")
    name = F.concat(F.lit("p/"), number(F.col("page_id") % 100), F.lit("/"), number(F.col("page_id")), F.lit(".html"))
    path = shared_path(spark, "zipped")
    archives.write_zipped(table(spark, sf, "pages").select(name.alias("name"), F.col("html").cast("binary").alias("payload")), path)
    return archives.read_zipped(spark, path).select("name", "size", F.sha2("payload", 256).alias("hash"))
