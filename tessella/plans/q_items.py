"""Queries over the item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import facets, geo, labels, rollups, search, sequence
from tessella.operators.filters import Filters, apply, category_match, with_confidence
from tessella.plans.catalogue import query
from tessella.plans.items import ITEMS_SQL, items

WITH = f"WITH {ITEMS_SQL}"
FACES_SQL = "CASE WHEN coalesce(kind, 'photo') = 'video' THEN people ELSE coalesce(n_faces, 0) END"
CLIP_SQL = "coalesce(kind, 'photo') = 'video'"
SPEED_SQL = f"CASE WHEN {CLIP_SQL} AND coalesce(fps, capture_fps) IS NOT NULL THEN CASE WHEN greatest(fps, capture_fps) >= 100 THEN 'slow' ELSE 'normal' END END"
LOOK_SQL = f"CASE WHEN {CLIP_SQL} AND gamma <> '' THEN CASE WHEN lower(gamma) LIKE 's-log%' THEN 'log' ELSE 'standard' END END"
DURATION_SQL = "CASE WHEN duration >= 0 AND duration < 10 THEN 'lt10' WHEN duration >= 10 AND duration < 30 THEN '10to30' WHEN duration >= 30 AND duration < 120 THEN '30to120' WHEN duration >= 120 THEN 'gt120' END"


def bucket_sql(axis: str) -> str:
    if axis == "flash":
        return "CASE WHEN flash IS NULL OR flash < 0 THEN 'unknown' WHEN flash & 1 = 1 THEN 'fired' ELSE 'none' END"
    # Written out here, so that the library's own table is tested.
    cases = {
        "focal_mm": "WHEN focal_mm <= 19.5 THEN 'lt20' WHEN focal_mm <= 35.5 THEN '20to35' WHEN focal_mm <= 70.5 THEN '36to70' WHEN focal_mm <= 135.5 THEN '71to135' ELSE 'gt135'",
        "iso": "WHEN iso <= 400 THEN 'le400' WHEN iso <= 1600 THEN 'to1600' WHEN iso <= 6400 THEN 'to6400' ELSE 'gt6400'",
        "exposure_s": "WHEN exposure_s <= 1.05e0 / 1000 THEN 'fast' WHEN exposure_s <= 1.05e0 / 250 THEN 'action' WHEN exposure_s <= 1.05e0 / 60 THEN 'normal' WHEN exposure_s <= 0.99 THEN 'slow' ELSE 'long'",
        "fnumber": "WHEN fnumber <= 2 THEN 'wide' WHEN fnumber <= 4 THEN 'mid' WHEN fnumber <= 8 THEN 'small' ELSE 'tiny'",
    }
    return f"CASE WHEN {axis} IS NULL OR {axis} = 0 THEN 'unknown' {cases[axis]} END"


# One small query for each field of the filter, and one for the conjunction of many.
FILTERS = {
    "faces_group": (Filters(faces="group"), f"{FACES_SQL} >= 3"),
    "faces_none": (Filters(faces="none"), f"{FACES_SQL} = 0"),
    "kind_photos": (Filters(kind="photos"), f"NOT {CLIP_SQL}"),
    "aerial": (Filters(aerial=True), "coalesce(aerial, 0) <> 0"),
    "shot_size": (Filters(shot_size="close"), "shot_size = 'close'"),
    "slowmo": (Filters(slowmo="slow"), f"{SPEED_SQL} = 'slow'"),
    "camera": (Filters(camera="CAM3"), "camera = 'CAM3'"),
    "look_log": (Filters(look="log"), f"{LOOK_SQL} = 'log'"),
    "look_standard": (Filters(look="standard"), f"{LOOK_SQL} = 'standard'"),
    "duration": (Filters(duration="10to30"), f"{CLIP_SQL} AND {DURATION_SQL} = '10to30'"),
    "hide_soft": (Filters(hide_soft=True), "coalesce(focus, '') NOT IN ('soft', 'bad')"),
    "category_other": (Filters(category="other"), "category = 'other'"),
    "unclassified": (Filters(category="unclassified"), "category IS NULL"),
    "cluster": (Filters(cluster="group 2"), "cluster = 'group 2'"),
    "taken_range": (Filters(taken_from="2024-01-10", taken_to="2024-02-01T12"), "coalesce(taken_at, '') >= '2024-01-10' AND coalesce(taken_at, '') <= '2024-02-01T12'"),
    "bbox": (Filters(bbox=(-20.0, -60.0, 40.0, 60.0)), "lat BETWEEN -20 AND 40 AND lon BETWEEN -60 AND 60"),
    "bbox_date_line": (Filters(bbox=(-50.0, 150.0, 50.0, -150.0)), "lat BETWEEN -50 AND 50 AND (lon >= 150 OR lon <= -150)"),
    "lens_unknown": (Filters(lens="unknown"), f"NOT {CLIP_SQL} AND coalesce(nullif(lens, ''), 'unknown') = 'unknown'"),
    "iso": (Filters(iso="to1600"), f"NOT {CLIP_SQL} AND iso > 400 AND iso <= 1600"),
    "shutter": (Filters(shutter="fast"), f"NOT {CLIP_SQL} AND exposure_s > 0 AND exposure_s <= 0.00105"),
    "aperture": (Filters(aperture="small"), f"NOT {CLIP_SQL} AND fnumber > 4 AND fnumber <= 8"),
    "flash": (Filters(flash="fired"), f"NOT {CLIP_SQL} AND {bucket_sql('flash')} = 'fired'"),
    "focal": (Filters(focal="36to70"), f"NOT {CLIP_SQL} AND focal_mm > 35.5 AND focal_mm <= 70.5"),
    "flicker": (Filters(flicker="pulsing"), f"{CLIP_SQL} AND flicker = 'pulsing'"),
    "day": (Filters(day="2024-01-20"), "substr(taken_at, 1, 10) = '2024-01-20'"),
    "flag_none": (Filters(flag="none"), "coalesce(flag, 'none') = 'none'"),
    "stars": (Filters(stars_min=3), "coalesce(rating, 0) >= 3"),
    "label": (Filters(label="red"), "coalesce(label, 'none') = 'red'"),
    "conjunction": (
        Filters(kind="photos", faces="one", hide_bad=True, stars_min=1, flag="none", taken_from="2024"),
        f"NOT {CLIP_SQL} AND {FACES_SQL} = 1 AND coalesce(focus, '') <> 'bad' AND coalesce(rating, 0) >= 1 AND coalesce(flag, 'none') = 'none' AND coalesce(taken_at, '') >= '2024'",
    ),
}
for _name, (_f, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"{WITH} SELECT id, rel FROM items WHERE {_sql}")(lambda spark, sf, f=_f: apply(items(spark, sf), f).select("id", "rel"))

MATCH_SQL = """CASE WHEN category = 'click' THEN CASE WHEN category_score IS NULL THEN 1.0 ELSE category_score END
  WHEN category = 'other' AND category_guess = 'click' THEN coalesce(category_guess_score, 0.0)
  WHEN category = 'people' AND category_guess = 'click' THEN coalesce(category_guess_score, 0.0) END"""
SURE_SQL = """CASE WHEN category = 'click' THEN coalesce(category_score >= 0.5, TRUE)
  WHEN category = 'other' AND category_guess = 'click' THEN FALSE
  WHEN category = 'people' AND category_guess = 'click' THEN coalesce(category_guess_score, 0.0) >= 0.5 END"""
RANKED_SQL = f"{WITH}, m AS (SELECT *, {SURE_SQL} AS sure, CAST(round_even({MATCH_SQL}, 4) AS DOUBLE) AS confidence FROM items WHERE {MATCH_SQL} IS NOT NULL)"


@query("category_confidence", f"{RANKED_SQL} SELECT id, sure, confidence FROM m")
def category_confidence(spark, sf):
    f = Filters(category="click")
    return with_confidence(apply(items(spark, sf), f), f).select("id", "sure", "confidence")


@query("search_page_sure_band", f"""{RANKED_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY sure DESC, CASE WHEN sure THEN 0.0 ELSE -confidence END, coalesce(taken_at, ''), rel) - 1 AS pos FROM m)
SELECT CAST(pos AS INTEGER) AS pos, id, rel, sure, confidence FROM o WHERE pos >= 40 AND pos < 140""")
def search_page(spark, sf):
    return search.page(items(spark, sf), Filters(category="click"), limit=100, offset=40).select("pos", "id", "rel", "sure", "confidence")


ORDERS = {
    "newest": "coalesce(taken_at, '') DESC, rel DESC", "oldest": "coalesce(taken_at, ''), rel", "biggest": "coalesce(size, 0) DESC, rel",
    "smallest": "coalesce(size, 0), rel", "name": "lower(rel), rel", "longest": "coalesce(duration, 0.0) DESC, rel",
}
for _s, _o in ORDERS.items():
    query(f"sort_{_s}", f"{WITH}, o AS (SELECT id, rel, row_number() OVER (ORDER BY {_o}) - 1 AS pos FROM items) SELECT CAST(pos AS INTEGER) AS pos, id, rel FROM o WHERE pos < 200")(
        lambda spark, sf, s=_s: search.page(items(spark, sf), Filters(), sort=s, limit=200).select("pos", "id", "rel")
    )


@query("sharp_percentile", f"{WITH} SELECT id, round((row_number() OVER (ORDER BY coalesce(sharp, 0), id) - 1) / greatest(count(*) OVER () - 1, 1) * 100, 6) AS sharp_pct FROM items")
def sharp_percentile(spark, sf):
    return search.sharp_percentile(items(spark, sf)).select("id", F.round("sharp_pct", 6).alias("sharp_pct"))


@query("filter_sharp_min", f"""{WITH}, s AS (SELECT id, rel, (row_number() OVER (ORDER BY coalesce(sharp, 0), id) - 1) / greatest(count(*) OVER () - 1, 1) * 100 AS pct FROM items)
SELECT id, rel FROM s WHERE pct >= 80""")
def filter_sharp_min(spark, sf):
    return apply(search.sharp_percentile(items(spark, sf)), Filters(sharp_min_pct=80)).select("id", "rel")


@query("filter_group_copies", f"{WITH} SELECT id, rel FROM items QUALIFY count(*) OVER (PARTITION BY qhash) > 1")
def filter_group_copies(spark, sf):
    return apply(sequence.duplicate_sets(items(spark, sf)), Filters(group="copies")).select("id", "rel")


@query("filter_product_variant", f"{WITH} SELECT id, rel FROM items WHERE id % 40 = 7 AND id % 3 = 1")
def filter_product_variant(spark, sf):
    rows = items(spark, sf).withColumns({"product": F.col("id") % 40, "variant": F.col("id") % 3})
    return apply(rows, Filters(product=7, variant=1)).select("id", "rel")


@query("filter_sure_only", f"{RANKED_SQL} SELECT id, confidence FROM m WHERE sure")
def filter_sure_only(spark, sf):
    f = Filters(category="click", sure_only=True)
    return with_confidence(apply(items(spark, sf), f), f).select("id", "confidence")


_AXES = {
    "kind": f"CASE WHEN {CLIP_SQL} THEN 'videos' ELSE 'photos' END", "faces": f"CASE {FACES_SQL} WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CASE WHEN {FACES_SQL} >= 3 THEN 'group' END END",
    "cameras": "nullif(camera, '')", "shot_size": "nullif(shot_size, '')", "slowmo": f"CASE WHEN {CLIP_SQL} THEN {SPEED_SQL} END",
    "look": f"CASE WHEN {CLIP_SQL} THEN {LOOK_SQL} END", "focal": f"CASE WHEN NOT {CLIP_SQL} THEN {bucket_sql('focal_mm')} END",
    "flicker": f"CASE WHEN {CLIP_SQL} AND flicker IN ('pulsing', 'banding', 'none') THEN flicker END", "groups": "CASE WHEN copies_id IS NOT NULL THEN 'copies' END", "duration": f"CASE WHEN {CLIP_SQL} THEN {DURATION_SQL} END",
    "lens": f"CASE WHEN NOT {CLIP_SQL} THEN coalesce(nullif(lens, ''), 'unknown') END", "iso": f"CASE WHEN NOT {CLIP_SQL} THEN {bucket_sql('iso')} END",
    "shutter": f"CASE WHEN NOT {CLIP_SQL} THEN {bucket_sql('exposure_s')} END", "aperture": f"CASE WHEN NOT {CLIP_SQL} THEN {bucket_sql('fnumber')} END",
    "flash": f"CASE WHEN NOT {CLIP_SQL} THEN {bucket_sql('flash')} END",
    "days": "substr(taken_at, 1, 10)", "drone": "CASE WHEN coalesce(aerial, 0) <> 0 THEN 'drone' END",
}
_FAILS = {"kind": CLIP_SQL, "cameras": "coalesce(camera = 'CAM3', FALSE)", "faces": f"coalesce({FACES_SQL} = 1, FALSE)"}


COPIES_SQL = ITEMS_SQL.replace("items AS (", "items AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qhash) > 1 THEN min(id) OVER (PARTITION BY qhash) END AS copies_id FROM (", 1) + ")"


def _facet_sql() -> str:
    passing = lambda but: " AND ".join(p for a, p in _FAILS.items() if a != but) or "TRUE"
    base = "coalesce(rating, 0) >= 1"
    parts = [f"SELECT '{a}' AS axis, {v} AS value FROM items WHERE {base} AND {passing(a)}" for a, v in _AXES.items()]
    for v in ("coalesce(category, 'unclassified')", "CASE WHEN category IN ('people', 'other') AND category_guess <> category THEN category_guess END"):
        parts.append(f"SELECT 'categories', {v} FROM items WHERE {base} AND {passing('')}")
    parts.append(f"SELECT 'total', 'all' FROM items WHERE {base} AND {passing('')}")
    return f"WITH {COPIES_SQL}, p AS ({' UNION ALL '.join(parts)}) SELECT axis, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2"


# stars_min belongs to no axis, so it bounds all of them.
@query("facet_counts", _facet_sql())
def facet_counts(spark, sf):
    return facets.facet_counts(sequence.duplicate_sets(items(spark, sf)), Filters(kind="videos", camera="CAM3", faces="one", stars_min=1))


@query("facet_group_sets", f"WITH {COPIES_SQL} SELECT 'copies' AS value, count(DISTINCT copies_id) AS n FROM items WHERE {CLIP_SQL} AND coalesce(rating, 0) >= 1 HAVING count(copies_id) > 0")
def facet_group_sets(spark, sf):
    return facets.group_sets(sequence.duplicate_sets(items(spark, sf)), Filters(kind="videos", group="copies", stars_min=1))


@query("days_rollup", f"{WITH} SELECT substr(taken_at, 1, 10) AS day, count(*) AS n, count(*) FILTER (WHERE {CLIP_SQL}) AS videos, CAST(sum(size) AS BIGINT) AS bytes FROM items GROUP BY 1")
def days_rollup(spark, sf):
    return rollups.days(items(spark, sf))


@query("category_counts_multi", f"""{WITH}, p AS (SELECT coalesce(category, 'unclassified') AS category FROM items WHERE status = 'ok'
UNION ALL SELECT category_guess FROM items WHERE status = 'ok' AND category = 'people' AND category_guess <> 'people') SELECT category, count(*) AS n FROM p WHERE category IS NOT NULL GROUP BY 1""")
def category_counts(spark, sf):
    return rollups.category_counts(items(spark, sf))


_OK = "status = 'ok'"
_COUNTS = {
    "total": "TRUE", "ok": _OK, "errors": "status = 'error'", "pending": "status = 'pending'", "photos": f"{_OK} AND NOT {CLIP_SQL}", "videos": f"{_OK} AND {CLIP_SQL}",
    "classified": f"{_OK} AND category IS NOT NULL", "clustered": f"{_OK} AND cluster IS NOT NULL", "focus_known": f"{_OK} AND focus IS NOT NULL", "located": f"{_OK} AND lat IS NOT NULL",
    "aerial": f"{_OK} AND coalesce(aerial, 0) <> 0", "faces_known": f"{_OK} AND n_faces IS NOT NULL", "slow": f"{_OK} AND {SPEED_SQL} = 'slow'", "normal": f"{_OK} AND {SPEED_SQL} = 'normal'",
    "speed_unknown": f"{_OK} AND {CLIP_SQL} AND ({SPEED_SQL}) IS NULL", "log": f"{_OK} AND {LOOK_SQL} = 'log'", "standard": f"{_OK} AND {LOOK_SQL} = 'standard'",
    "look_unknown": f"{_OK} AND {CLIP_SQL} AND ({LOOK_SQL}) IS NULL", **{f"duration_{n}": f"{_OK} AND {CLIP_SQL} AND {DURATION_SQL} = '{n}'" for n, _, _ in S.DURATIONS},
}


@query("scan_counts", f"{WITH} SELECT {', '.join(f'count(*) FILTER (WHERE {p}) AS {k}' for k, p in _COUNTS.items())} FROM items")
def scan_counts(spark, sf):
    return rollups.conditional_counts(items(spark, sf))


_MARKS = {"picks": "flag = 'pick'", "rejects": "flag = 'reject'", **{f"stars_{k}": f"coalesce(rating, 0) >= {k}" for k in range(1, 6)}, "red": "label = 'red'", "blue": "label = 'blue'", "marked": "flag IS NOT NULL OR coalesce(rating, 0) > 0 OR label IS NOT NULL"}


@query("mark_counts", f"{WITH} SELECT {', '.join(f'count(*) FILTER (WHERE {p}) AS {k}' for k, p in _MARKS.items())} FROM items")
def mark_counts(spark, sf):
    return rollups.mark_counts(items(spark, sf))


for _axis in ("iso", "fnumber", "exposure_s", "focal_mm", "flash"):
    query(f"bucket_{_axis}", f"{WITH} SELECT {bucket_sql(_axis)} AS value, count(*) AS n FROM items WHERE NOT {CLIP_SQL} GROUP BY 1")(
        lambda spark, sf, a=_axis: rollups.counts(items(spark, sf).filter(F.coalesce("kind", F.lit("photo")) != "video"), S.bucket(a, F.col(a)), "value")
    )
for _key in ("camera", "cluster"):
    query(f"counts_{_key}", f"{WITH} SELECT {_key} AS value, count(*) AS n FROM items GROUP BY 1")(lambda spark, sf, k=_key: rollups.counts(items(spark, sf), k, "value"))


@query("counts_kind", f"{WITH} SELECT coalesce(kind, 'photo') AS value, count(*) AS n FROM items WHERE status = 'ok' GROUP BY 1")
def counts_kind(spark, sf):
    return rollups.counts(items(spark, sf).filter("status = 'ok'"), F.coalesce("kind", F.lit("photo")), "value")


@query("counts_shot_size", f"{WITH} SELECT coalesce(shot_size, 'unscored') AS value, count(*) AS n, CAST(CASE coalesce(shot_size, 'unscored') WHEN 'close' THEN 1 WHEN 'medium' THEN 2 WHEN 'wide' THEN 3 WHEN 'unknown' THEN 4 WHEN 'unscored' THEN 5 ELSE 6 END AS INTEGER) AS pos FROM items WHERE status = 'ok' GROUP BY 1")
def counts_shot_size(spark, sf):
    return rollups.shot_sizes(items(spark, sf).filter("status = 'ok'"))


@query("ev_brightness", f"""{WITH} SELECT id, round(ev, 6) AS ev100, round(coalesce(-ev, ev_bias), 6) AS brightness FROM (SELECT *,
CASE WHEN coalesce(fnumber, 0) <> 0 AND coalesce(exposure_s, 0) <> 0 AND coalesce(iso, 0) <> 0 THEN log2(fnumber * fnumber / exposure_s) - log2(iso / 100.0) END AS ev FROM items)""")
def ev_brightness(spark, sf):
    c = F.col
    return items(spark, sf).select(
        "id", F.round(S.ev100(c("fnumber"), c("exposure_s"), c("iso")), 6).alias("ev100"),
        F.round(S.brightness(c("fnumber"), c("exposure_s"), c("iso"), c("ev_bias")), 6).alias("brightness"),
    )


@query("frame_numbers", f"{WITH} SELECT id, CAST(regexp_extract(rel, '(\\d+)\\.jpg$', 1) AS BIGINT) AS frame, dir AS folder FROM items")
def frame_numbers(spark, sf):
    return items(spark, sf).select("id", S.frame_number(F.col("rel")).alias("frame"), S.parent(F.col("rel")).alias("folder"))


@query("copies_fold", f"""{WITH} SELECT id, copies_id FROM (SELECT id, taken_at, rel, CASE WHEN count(*) OVER (PARTITION BY qhash) > 1 THEN min(id) OVER (PARTITION BY qhash) END AS copies_id FROM items)
QUALIFY row_number() OVER (PARTITION BY coalesce(copies_id, -1 - id) ORDER BY taken_at, rel) = 1""")
def copies_fold(spark, sf):
    rows = sequence.duplicate_sets(items(spark, sf))
    return sequence.fold(rows, ["copies_id"], [F.col("taken_at"), F.col("rel")]).select("id", "copies_id")


GAP = 20000.0
BURSTS_SQL = f"""{WITH}, s AS (SELECT id, dir, rel, taken_at, camera, frame_no, sharp, floor(t) AS t, CASE WHEN coalesce(fnumber, 0) <> 0 AND coalesce(exposure_s, 0) <> 0 AND coalesce(iso, 0) <> 0 THEN log2(fnumber * fnumber / exposure_s) - log2(iso / 100.0) END AS ev
  FROM items WHERE NOT {CLIP_SQL}),
l AS (SELECT *, CASE WHEN frame_no = lag(frame_no) OVER w + 1 AND camera IS NOT DISTINCT FROM lag(camera) OVER w AND t - lag(t) OVER w <= {GAP}
  AND NOT coalesce(abs(ev - lag(ev) OVER w) >= 1 - 1e-6, FALSE) THEN 0 ELSE 1 END AS cut FROM s WINDOW w AS (PARTITION BY dir ORDER BY taken_at, rel)),
r AS (SELECT *, dir || '#' || CAST(sum(cut) OVER (PARTITION BY dir ORDER BY taken_at, rel) AS BIGINT) AS run FROM l),
b AS (SELECT *, count(*) OVER (PARTITION BY run) AS size FROM r)"""


def bursts(spark, sf):
    return sequence.burst_runs(items(spark, sf), GAP)


@query("burst_runs", f"{BURSTS_SQL} SELECT id, run AS burst_id FROM b WHERE size > 1")
def burst_runs(spark, sf):
    return bursts(spark, sf).filter("burst_id IS NOT NULL").select("id", "burst_id")


@query("filter_group_burst", f"{BURSTS_SQL} SELECT id, rel FROM b WHERE size > 1")
def filter_group_burst(spark, sf):
    return apply(bursts(spark, sf), Filters(group="burst")).select("id", "rel")


@query("best_of_burst", f"{BURSTS_SQL} SELECT run AS burst_id, count(*) AS n, arg_max(id, coalesce(sharp, 0) * 1e6 - id / 1e9) AS sharpest FROM b WHERE size > 1 GROUP BY 1")
def best_of_burst(spark, sf):
    return sequence.best_of_sets(bursts(spark, sf), "burst_id")


@query("bracket_runs")
def bracket_runs(spark, sf):
    return sequence.bracket_runs(items(spark, sf).withColumn("t", F.col("frame_no") * 1.0))


@query("angles_best_per_camera", f"{WITH} SELECT camera, count(*) AS n, arg_max(id, coalesce(sharp, -1.0) * 1e6 - id / 1e9) AS best, max(coalesce(sharp, -1.0)) AS best_score FROM items WHERE coalesce(camera, '') <> '' GROUP BY 1")
def angles(spark, sf):
    return rollups.angles(items(spark, sf).withColumns({"score": F.coalesce("sharp", F.lit(-1.0)), "pos": F.col("id")}))


@query("same_moment", f"{WITH} SELECT i.id, i.camera, CAST(round_even(i.t - a.t, 1) AS DOUBLE) AS dt_s FROM items i, (SELECT * FROM items WHERE id = (SELECT min(id) FROM items WHERE camera IS NOT NULL AND id >= 100)) a WHERE abs(i.t - a.t) <= 20000 AND i.id <> a.id AND i.camera <> a.camera")
def same_moment(spark, sf):
    rows = items(spark, sf)
    anchor = rows.filter("camera IS NOT NULL AND id >= 100").agg(F.min("id").alias("a")).first().a
    return rollups.same_moment(rows, anchor, 20000.0)


@query("bounded_history", f"{WITH} SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, id DESC) AS r FROM items) WHERE r <= 5")
def bounded_history(spark, sf):
    return sequence.bounded_history(items(spark, sf), "user_id", 5, F.desc("t"), F.desc("id")).select("user_id", "id")


@query("latest_per_kind", f"{WITH} SELECT category, id FROM items QUALIFY row_number() OVER (PARTITION BY category ORDER BY t DESC, id DESC) = 1")
def latest_per_kind(spark, sf):
    return sequence.latest_per(items(spark, sf), "category", F.desc("t"), F.desc("id")).select("category", "id")


@query("swap_ring", f"{WITH} SELECT id, coalesce(lead(id) OVER (PARTITION BY dir ORDER BY coalesce(sharp, 0) DESC, id), first_value(id) OVER (PARTITION BY dir ORDER BY coalesce(sharp, 0) DESC, id)) AS next_id FROM items")
def swap_ring(spark, sf):
    from tessella.operators.select import swap_ring as ring

    return ring(items(spark, sf), "dir", F.coalesce("sharp", F.lit(0.0)).desc(), F.col("id")).select("id", "next_id")


@query("focus_labels", f"""{WITH}, s AS (SELECT id, coalesce(kind, 'photo') AS kind, coalesce(sharp, 0.0) AS score, coalesce(sharp, 0.0) * 2 AS max_tile, CASE WHEN n_faces > 2 THEN 70.0 END AS eye FROM items),
p AS (SELECT kind, quantile_cont(score, 0.05) AS p5, quantile_cont(score, 0.15) AS p15 FROM s GROUP BY 1)
SELECT id, CASE WHEN score < p5 AND score < 18 AND max_tile < 60 AND NOT coalesce(eye >= 60, FALSE) THEN 'bad' WHEN score < p15 THEN 'soft' ELSE 'ok' END AS label FROM s JOIN p USING (kind)""")
def focus_labels(spark, sf):
    s = F.coalesce("sharp", F.lit(0.0))
    rows = items(spark, sf).select("id", "kind", s.alias("score"), (s * 2).alias("max_tile"), F.when(F.col("n_faces") > 2, 70.0).alias("eye"))
    return labels.focus_labels(rows).select("id", "label")


@query("rolling_median_alert", f"""{WITH}, f AS (SELECT id, camera AS product, fnumber AS setting, id AS seq, coalesce(sharp, 0.0) / 100 AS level, n_faces = 2 AS strobe FROM items),
m AS (SELECT *, CASE WHEN count(level) OVER w >= 3 AND median(level) OVER w >= 0.02 THEN log2(median(level) OVER w / greatest(level, 1e-4)) END AS d FROM f WINDOW w AS (PARTITION BY product, setting ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))
SELECT id, round(d, 6) AS drop, CASE WHEN strobe AND d >= 1.5 THEN 'flash_miss' WHEN d >= 1 THEN 'dark' END AS alert FROM m""")
def rolling_median_alert(spark, sf):
    rows = items(spark, sf).select("id", F.col("camera").alias("product"), F.col("fnumber").alias("setting"), F.col("id").alias("seq"), (F.coalesce("sharp", F.lit(0.0)) / 100).alias("level"), (F.col("n_faces") == 2).alias("strobe"))
    return sequence.light_alerts(rows).select("id", F.round("drop", 6).alias("drop"), "alert")


@query("geo_grid", f"""{WITH} SELECT CAST(floor(lat / (25.0 / 111.0)) AS BIGINT) AS cell_y, CAST(floor(lon / (25.0 / 111.0)) AS BIGINT) AS cell_x, count(*) AS n, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon,
min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2""")
def geo_grid(spark, sf):
    return geo.grid_cells(items(spark, sf)).withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


CITIES_SQL = "c AS (SELECT 'city ' || n_name AS name, 'r' || CAST(n_regionkey AS VARCHAR) AS country, CAST((n_nationkey * 11) % 110 - 55 AS DOUBLE) AS clat, CAST((n_nationkey * 53) % 360 - 180 AS DOUBLE) AS clon FROM nation)"
KM_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))))"


def cities(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.selectExpr("concat('city ', n_name) AS name", "concat('r', n_regionkey) AS country", "CAST((n_nationkey * 11) % 110 - 55 AS DOUBLE) AS lat", "CAST((n_nationkey * 53) % 360 - 180 AS DOUBLE) AS lon")


@query("nearest_city", f"""{WITH}, {CITIES_SQL}, d AS (SELECT id, name, country, {KM_SQL} AS km FROM items, c WHERE lat IS NOT NULL),
b AS (SELECT id, name, country, km FROM d WHERE km <= 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, name) = 1)
SELECT i.id, b.name, b.country, round(b.km, 4) AS km FROM items i LEFT JOIN b USING (id) WHERE i.lat IS NOT NULL""")
def nearest_city(spark, sf):
    points = items(spark, sf).filter("lat IS NOT NULL").select("id", "lat", "lon")
    return geo.nearest_city(points, cities(spark, sf), 300.0).select("id", "name", "country", F.round("km", 4).alias("km"))


@query("grid_merge_names")
def grid_merge_names(spark, sf):
    cells = geo.grid_cells(items(spark, sf)).withColumn("id", F.xxhash64("cell_y", "cell_x"))
    return geo.merged_piles(geo.nearest_city(cells.select("id", "n", "lat", "lon"), cities(spark, sf), 300.0), 200.0)


@query("placement_plan", f"""{WITH}, f AS (SELECT DISTINCT id, folder, bytes FROM (
SELECT id, coalesce(category, 'unclassified') AS folder, coalesce(size, 0) AS bytes FROM items WHERE {_OK}
UNION ALL SELECT id, category_guess, coalesce(size, 0) FROM items WHERE {_OK} AND category = 'people' AND coalesce(category_guess_score, 0) >= 0.5
UNION ALL SELECT id, 'aerial', coalesce(size, 0) FROM items WHERE {_OK} AND aerial = 1) WHERE folder IS NOT NULL)
SELECT folder, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def placement_plan(spark, sf):
    return rollups.placements(items(spark, sf)).groupBy("folder").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("usage_summary", f"""WITH u AS (SELECT CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'tab_time' WHEN 2 THEN 'index_done' ELSE event_type END AS ev, user_id AS session, CASE WHEN event_id % 4 = 0 THEN value * 10 END AS ms, CASE WHEN event_id % 4 IN (1, 2) THEN value END AS seconds FROM events),
f AS (SELECT *, CASE ev WHEN 'tab_time' THEN 'tab' WHEN 'index_done' THEN 'index' WHEN 'search' THEN 'search' END AS f FROM u)
SELECT 'event' AS what, ev AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS seconds FROM u GROUP BY ev
UNION ALL SELECT 'feature', f, count(*), CAST(round_even(sum(coalesce(seconds, ms / 1000.0, 0)), 1) AS DOUBLE) FROM f WHERE f IS NOT NULL GROUP BY f
UNION ALL SELECT 'sessions', 'all', count(DISTINCT session), NULL FROM u""")
def usage_summary(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 4
    ev = F.when(k == 0, "search").when(k == 1, "tab_time").when(k == 2, "index_done").otherwise(F.col("event_type"))
    return rollups.usage_summary(e.select(ev.alias("ev"), F.col("user_id").alias("session"), F.when(k == 0, F.col("value") * 10).alias("ms"), F.when(k.isin(1, 2), F.col("value")).alias("seconds")))


assert category_match is not None
