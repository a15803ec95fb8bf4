"""Queries over a shoot's state, its logs and what is on the disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import filters as flt
from tessella.operators import sequence, status
from tessella.plans.catalogue import query
from tessella.plans.items import ITEMS_SQL, items, table
from tessella.plans.q_rows import _files
from tessella.plans.q_vectors import V_SQL, vecs
from tessella.sources import files

JOBS_SQL = "j AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'focus' ELSE 'fps' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'interrupted' ELSE 'done' END AS state FROM orders)"


def jobs(spark, sf):
    k = F.col("o_custkey") % 3
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "scan").when(k == 1, "focus").otherwise("fps").alias("kind"), F.when(F.col("o_orderstatus") == "F", "interrupted").otherwise("done").alias("state"))


@query("shoot_stats", f"""WITH {ITEMS_SQL} SELECT count(*) FILTER (status = 'ok' AND coalesce(kind, 'photo') <> 'video') AS photos, count(*) FILTER (status = 'ok' AND kind = 'video') AS videos,
count(*) FILTER (status = 'error' OR (status = 'ok' AND label = 'red')) AS errors, count(*) FILTER (status = 'ok' AND n_faces IS NULL) AS faces_pending, count(*) FILTER (status = 'ok' AND focus = 'bad') AS bad,
count(*) FILTER (status = 'ok' AND focus = 'soft') AS soft, (SELECT count(*) FROM lineitem) AS faces, (SELECT count(*) FROM supplier) AS people FROM items""")
def shoot_stats(spark, sf):
    rows = items(spark, sf).withColumn("problem", F.when(F.col("label") == "red", "cut off"))
    return status.shoot_stats(rows, table(spark, sf, "lineitem"), table(spark, sf, "supplier"))


@query("scan_health", f"""WITH {ITEMS_SQL}, {JOBS_SQL}, h AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '/DSC' || lpad(CAST(event_id % 300 AS VARCHAR), 5, '0') || '.jpg' AS rel FROM events),
c AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ok' AND rating IS NULL) AS unembedded, count(*) FILTER (status = 'ok' AND n_faces IS NULL) AS faces_pending FROM items),
l AS (SELECT kind, max(id) AS id, arg_max(state, id) AS state FROM j WHERE kind IN ('scan', 'focus') GROUP BY 1), x AS (SELECT *, pending = 0 AND unembedded = 0 AS complete, (SELECT count(*) FROM h) AS on_disk, (SELECT count(*) FROM h ANTI JOIN items USING (rel)) AS new_on_disk FROM c),
y AS (SELECT x.*, (SELECT arg_max(kind, id) FROM l WHERE state = 'interrupted' AND NOT (kind = 'scan' AND complete)) AS interrupted FROM x)
SELECT *, CASE WHEN NOT complete OR interrupted = 'scan' THEN 'continue' WHEN interrupted = 'focus' THEN 'focus' WHEN new_on_disk > 0 THEN 'rescan' WHEN faces_pending > 0 THEN 'faces' END AS fix FROM y""")
def scan_health(spark, sf):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/DSC"), F.lpad((F.col("event_id") % 300).cast("string"), 5, "0"), F.lit(".jpg"))
    return status.scan_health(items(spark, sf).withColumn("vector", F.col("rating")), jobs(spark, sf), table(spark, sf, "events").select(name.alias("rel")))


@query("shoot_facts", f"""WITH {ITEMS_SQL}, f AS (SELECT dir AS shoot, count(*) FILTER (coalesce(kind, '') <> 'video') AS photos, count(*) FILTER (kind = 'video') AS videos FROM items WHERE status = 'ok' GROUP BY 1)
SELECT 'u' || CAST(c_custkey AS VARCHAR) AS shoot, coalesce(photos, 0) AS photos, coalesce(videos, 0) AS videos, coalesce(photos + videos, 0) AS items, coalesce(photos + videos, 0) > 0 AS indexed FROM customer LEFT JOIN f ON f.shoot = 'u' || CAST(c_custkey AS VARCHAR)""")
def shoot_facts(spark, sf):
    shoots = table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("shoot"))
    return status.shoot_facts(shoots, items(spark, sf).withColumnRenamed("dir", "shoot"))


@query("faces_beside_cover", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS photo_id, l_suppkey AS person_id, CASE WHEN l_partkey % 8 > 0 THEN l_extendedprice END AS score FROM lineitem),
c AS (SELECT person_id, max(id) AS cover FROM f GROUP BY 1), r AS (SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY score DESC NULLS LAST, id) AS pos FROM f ANTI JOIN c ON f.id = c.cover AND f.person_id = c.person_id WHERE photo_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 > 0))
SELECT * FROM r WHERE pos <= 6""")
def faces_beside_cover(spark, sf):
    f = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"), F.when(F.col("l_partkey") % 8 > 0, F.col("l_extendedprice")).alias("score"))
    there = table(spark, sf, "orders").filter("o_custkey % 4 > 0").select(F.col("o_orderkey").alias("id"))
    return status.faces_beside_cover(f, there, f.groupBy("person_id").agg(F.max("id").alias("cover")), 6)


@query("result_size", f"""WITH {ITEMS_SQL} SELECT count(*) AS total, count(DISTINCT CASE WHEN qhash < 'q4' THEN qhash WHEN cluster IS NOT NULL THEN 'c' || cluster ELSE 'id' || CAST(id AS VARCHAR) END) AS folded FROM items WHERE status = 'ok' AND kind = 'video'""")
def result_size(spark, sf):
    rows = items(spark, sf).withColumn("copies_id", F.when(F.col("qhash") < "q4", F.col("qhash"))).filter("status = 'ok'")
    return status.result_size(rows, flt.Filters(kind="videos"), ["copies_id", "cluster"])


@query("middle_of_brackets", """WITH l AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 7 > 0 THEN l_quantity % 9 - 4 ELSE 0 END AS ev FROM lineitem)
SELECT l_orderkey, count(*) AS n, first(id ORDER BY abs(ev), id) AS middle FROM l GROUP BY 1""")
def middle_of_brackets(spark, sf):
    level = F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity") % 9 - 4)
    return sequence.middle_of_sets(table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), level.alias("ev")), "l_orderkey")


@query("last_errors", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_errors(spark, sf):
    return status.newest(table(spark, sf, "events").filter("event_type <> 'view'"), 50, "ts", "event_id").select("event_id", "user_id", "event_type")


@query("events_since", "SELECT seq, user_id, FALSE AS reset FROM (SELECT event_id AS seq, user_id FROM events ORDER BY 1 DESC LIMIT 800) WHERE seq > 400 AND 400 >= (SELECT max(event_id) - 800 FROM events) UNION ALL SELECT NULL, NULL, TRUE FROM (SELECT max(event_id) AS last FROM events) WHERE 400 > last OR 400 < last - 800")
def events_since(spark, sf):
    return status.events_since(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id"), 400, 800)


@query("quarantined_rows", "SELECT event_id, CASE WHEN value IS NULL OR value > 150 THEN 'level' WHEN user_id % 10 = 3 THEN 'owner' WHEN props LIKE '%7%' THEN 'props' END AS reason FROM events")
def quarantined_rows(spark, sf):
    checks = {"level": F.col("value").isNull() | (F.col("value") > 150), "owner": F.col("user_id") % 10 == 3, "props": F.col("props").like("%7%")}
    return status.quarantined(table(spark, sf, "events"), checks).select("event_id", "reason")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY user_id, nth""")
def event_sessions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return status.sessions(rows, "user_id", "ts", "6 hours").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("photo_count", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey % 97, l_suppkey, l_orderkey % 13 FROM lineitem)")
def photo_count(spark, sf):
    return files.photo_count(_files(table(spark, sf, "lineitem")))


@query("clip_segment_vectors", f"{V_SQL} SELECT s.id, s.id // 2 AS photo_id, list_inner_product(s.vector, s.vector) > 0.5 AS unit FROM v s JOIN v p ON p.id = s.id // 2 WHERE p.id % 7 > 0 AND p.id % 4 = 0 AND s.id % 5 > 1")
def clip_segment_vectors(spark, sf):
    v = vecs(spark, sf)
    cut = F.when(F.col("id") % 5 == 1, F.slice("vector", 1, 32)).when(F.col("id") % 5 > 0, F.col("vector"))
    photos = v.select("id", F.when(F.col("id") % 7 > 0, "ok").otherwise("missing").alias("status"), F.when(F.col("id") % 4 == 0, "video").alias("kind"))
    rows = status.segment_vectors(v.select("id", F.floor(F.col("id") / 2).alias("photo_id"), cut.alias("vector")), photos, 64)
    return rows.select("id", "photo_id", (F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0.5).alias("unit"))
