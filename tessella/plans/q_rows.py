"""Queries over the relational tables, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import changes, labels, select, sequence
from tessella.plans.catalogue import query
from tessella.plans.items import table


@query("dup_sets_fold", """SELECT doc_id AS id, n AS members, first AS set_id FROM (SELECT doc_id, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1 AND doc_id = first""")
def dup_sets_fold(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("qhash"))
    sets = docs.groupBy("qhash").agg(F.min("id").alias("set_id"), F.count("*").alias("members")).filter("members > 1")
    return sets.select(F.col("set_id").alias("id"), "members", "set_id")


@query("even_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) WHERE n % greatest(1, CAST(ceil(total / 120.0) AS BIGINT)) = 0")
def even_sample(spark, sf):
    return sequence.even_sample(table(spark, sf, "orders"), "o_orderkey", 120).select("o_orderkey")


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey > 1000").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("lru_eviction", """SELECT o_orderkey AS id, sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) <= 500000 AS kept FROM orders""")
def lru_eviction(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("used"), F.bround("o_totalprice", 0).cast("long").alias("size"))
    return sequence.evicted(o, "o_custkey", 500000).select("id", "kept")


def _files(items):
    return items.select(
        F.concat(F.lit("d"), (F.col("l_orderkey") % 97).cast("string"), F.lit("/IMG_"), F.col("l_suppkey").cast("string"), F.lit("_"), (F.col("l_orderkey") % 13).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".dng").otherwise(".jpg")).alias("rel"),
        (F.col("l_linenumber") % 2 == 0).alias("is_raw"), F.lit(False).alias("is_video"),
    ).distinct()


PAIR_SQL = """WITH f AS (SELECT DISTINCT 'd' || CAST(l_orderkey % 97 AS VARCHAR) AS dir, 'img_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_orderkey % 13 AS VARCHAR) AS stem,
  'd' || CAST(l_orderkey % 97 AS VARCHAR) || '/IMG_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_orderkey % 13 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.dng' ELSE '.jpg' END AS rel, l_linenumber % 2 = 0 AS is_raw FROM lineitem),
p1 AS (SELECT s.rel, r.rel AS sibling FROM f s JOIN f r ON s.dir = r.dir AND s.stem = r.stem AND NOT s.is_raw AND r.is_raw),
rest AS (SELECT * FROM f ANTI JOIN (SELECT rel FROM p1 UNION ALL SELECT sibling FROM p1) USING (rel)),
u AS (SELECT stem, is_raw, min(rel) AS rel FROM rest GROUP BY 1, 2 HAVING count(*) = 1),
p2 AS (SELECT s.rel, r.rel AS sibling FROM u s JOIN u r ON s.stem = r.stem AND NOT s.is_raw AND r.is_raw)
SELECT f.rel, p.sibling FROM f LEFT JOIN (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p ON p.rel = f.rel ANTI JOIN (SELECT sibling AS rel FROM p1 UNION ALL SELECT sibling FROM p2) s ON s.rel = f.rel"""


@query("pair_raw_jpeg", PAIR_SQL)
def pair_raw_jpeg(spark, sf):
    return changes.pair_raw(_files(table(spark, sf, "lineitem"))).select("rel", "sibling")


KNOWN_SQL = """k AS (SELECT CAST(o_orderkey AS VARCHAR) AS rel, o_custkey AS size, CASE WHEN o_orderkey % 13 = 0 THEN 1e0 ELSE 0e0 END AS mtime, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 19 = 0 THEN 'pending' ELSE 'ok' END AS status FROM orders WHERE o_orderkey % 7 <> 0),
h AS (SELECT CAST(o_orderkey AS VARCHAR) AS rel, o_custkey AS size, 0e0 AS mtime FROM orders WHERE o_orderkey % 11 <> 0)"""


def _known(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when(k % 17 == 0, "missing").when(k % 19 == 0, "pending").otherwise("ok")
    known = o.filter(k % 7 != 0).select(k.cast("string").alias("rel"), F.col("o_custkey").alias("size"), F.when(k % 13 == 0, 1.0).otherwise(0.0).alias("mtime"), status.alias("status"))
    here = o.filter(k % 11 != 0).select(k.cast("string").alias("rel"), F.col("o_custkey").alias("size"), F.lit(0.0).alias("mtime"))
    return here, known


@query("change_detection", f"""WITH {KNOWN_SQL} SELECT coalesce(h.rel, k.rel) AS rel, CASE WHEN k.rel IS NULL THEN 'new' WHEN h.rel IS NULL AND status = 'pending' THEN 'deleted' WHEN h.rel IS NULL AND status = 'missing' THEN 'keep' WHEN h.rel IS NULL THEN 'missing'
  WHEN status = 'missing' AND h.mtime = k.mtime AND h.size = k.size THEN 'restore' WHEN status <> 'ok' OR h.mtime <> k.mtime OR h.size <> k.size THEN 'changed' ELSE 'keep' END AS action FROM h FULL JOIN k ON h.rel = k.rel""")
def change_detection(spark, sf):
    return changes.detect_changes(*_known(spark, sf))


@query("upsert_rows", f"WITH {KNOWN_SQL} SELECT coalesce(h.rel, k.rel) AS rel, coalesce(h.mtime, k.mtime) AS mtime, k.status AS status, CASE WHEN h.rel IS NULL THEN 'beach' END AS category FROM h FULL JOIN k ON h.rel = k.rel")
def upsert_rows(spark, sf):
    here, known = _known(spark, sf)
    return changes.upsert(known.select("rel", "mtime", "status", F.lit("beach").alias("category")), here.select("rel", "mtime"))


@query("semi_anti_person_pile", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def semi_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.filter("o_totalprice > 200000"), "c_custkey", "left_semi")
    return rows.join(o.filter("o_orderpriority LIKE '1%'"), "c_custkey", "left_anti").select("c_custkey")


@query("reconcile_marks", """WITH f AS (SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 1 THEN 'pick' END AS flag, CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id * 2 END AS seq FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT id, coalesce(flag = 'pick', FALSE) OR (seq IS NOT NULL AND coalesce(flag, '') <> 'reject') AS listed, CASE WHEN seq IS NOT NULL AND coalesce(flag, '') <> 'reject' THEN 'pick' ELSE flag END AS flag, coalesce(flag = 'pick', FALSE) AND seq IS NULL AS added, seq FROM f""")
def reconcile_marks(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    flag = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "pick")
    flags = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), flag.alias("flag"))
    listed = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("seq"))
    return changes.reconcile(listed, flags)


@query("set_marks", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 6 ELSE 1 END AS rating, lang AS label FROM documents")
def set_marks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("rating"), F.col("lang").alias("label"))
    return changes.set_columns(d, d.filter("id % 4 = 0").select("id", (F.col("id") % 6).alias("rating")))


@query("last_decisions", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS decision FROM lineitem GROUP BY 1, 2")
def last_decisions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("decision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return changes.last_decisions(rows)


@query("duration_buckets", """SELECT CASE WHEN s < 10 THEN 'lt10' WHEN s < 30 THEN '10to30' WHEN s < 120 THEN '30to120' ELSE 'gt120' END AS bucket, count(*) AS n FROM (SELECT o_totalprice / 1000 AS s FROM orders) GROUP BY 1""")
def duration_buckets(spark, sf):
    return table(spark, sf, "orders").groupBy(S.duration_bucket(F.col("o_totalprice") / 1000).alias("bucket")).agg(F.count("*").alias("n"))


@query("flicker_alias", "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS fps, round(abs(100 - round_even(100 / CAST(l_quantity AS DOUBLE), 0) * l_quantity), 6) AS alias_100, round(abs(120 - round_even(120 / CAST(l_quantity AS DOUBLE), 0) * l_quantity), 6) AS alias_120 FROM lineitem")
def flicker_alias(spark, sf):
    fps = F.col("l_quantity").cast("double")
    risk = labels.flicker_risk(fps)
    return table(spark, sf, "lineitem").select(fps.alias("fps"), F.round(risk[0]["alias_hz"], 6).alias("alias_100"), F.round(risk[1]["alias_hz"], 6).alias("alias_120")).distinct()


@query("segments_fixed_windows", """WITH o AS (SELECT o_orderkey, o_totalprice / 50 AS s, greatest(120.0, o_totalprice / 50 / 24) AS step FROM orders), n AS (SELECT *, greatest(1, CAST(floor((s - 1) / step + 1e-9) AS INTEGER) + 1) AS n FROM o)
SELECT o_orderkey, CAST(idx AS INTEGER) AS idx, round(idx * step, 6) AS start, round(CASE WHEN idx = n - 1 THEN s ELSE idx * step + step END, 6) AS "end" FROM (SELECT *, unnest(range(least(n, 24))) AS idx FROM (SELECT * REPLACE (least(n, 24) AS n) FROM n))""")
def segments_fixed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = labels.fixed_segments(o, F.col("o_totalprice") / 50)
    return out.select("o_orderkey", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("errors_by_folder", "SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS folder, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, folder LIMIT 20")
def errors_by_folder(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(20)


@query("top_queries", "SELECT lower(text) AS q, count(*) AS n FROM conversations GROUP BY 1 ORDER BY n DESC, q LIMIT 20")
def top_queries(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.lower("text").alias("q")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "q").limit(20)


@query("coverage_pick")
def coverage_pick(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_brand").alias("product"), F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("variant"), (F.col("p_partkey") % 5).alias("angle"), F.col("p_retailprice").alias("score"))
    return select.pick_each(rows, 12)


@query("scalar_functions", r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN regexp_matches(url, '^[=+@\t\r-]') THEN chr(39) || url ELSE url END AS guarded,
CASE WHEN length(url) > 20 THEN '...' || right(url, 17) ELSE url END AS elided FROM pages""")
def scalar_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.basename(u).alias("base"), S.formula_guard(u).alias("guarded"), S.elide_left(u, 20).alias("elided"))
