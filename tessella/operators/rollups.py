"""Counts, sums and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import filters as flt


def days(items: DataFrame) -> DataFrame:
    """Per day: rows, clips and bytes."""
    return items.filter(F.col("taken_at").isNotNull()).groupBy(F.substring("taken_at", 1, 10).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(flt.is_clip()).alias("videos"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def category_counts(items: DataFrame) -> DataFrame:
    """Rows under their category (null: unclassified), and people rows under what they were guessed to be. One scan."""
    ok = items.filter("status = 'ok'")
    under = F.array_compact(F.array(F.coalesce("category", F.lit("unclassified")), F.when((F.col("category") == "people") & (F.col("category_guess") != "people"), F.col("category_guess"))))
    return ok.select(F.explode(under).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def conditional_counts(items: DataFrame) -> DataFrame:
    """One row of counts that reports are made of."""
    clip, ok = flt.is_clip(), F.col("status") == "ok"
    speed, look = flt.speed(), flt.look_of()
    named = {
        "total": F.lit(True), "ok": ok, "errors": F.col("status") == "error", "pending": F.col("status") == "pending", "photos": ok & ~clip, "videos": ok & clip,
        "classified": ok & F.col("category").isNotNull(), "clustered": ok & F.col("cluster").isNotNull(), "focus_known": ok & F.col("focus").isNotNull(),
        "located": ok & F.col("lat").isNotNull(), "aerial": ok & (F.coalesce("aerial", F.lit(0)) != 0), "faces_known": ok & F.col("n_faces").isNotNull(),
        "slow": ok & (speed == "slow"), "normal": ok & (speed == "normal"), "speed_unknown": ok & clip & speed.isNull(),
        "log": ok & (look == "log"), "standard": ok & (look == "standard"), "look_unknown": ok & clip & look.isNull(),
        **{f"duration_{n}": ok & clip & (S.duration_bucket(F.col("duration")) == n) for n, _, _ in S.DURATIONS},
    }
    return items.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in named.items()])


def mark_counts(items: DataFrame) -> DataFrame:
    """One row: flags, stars (at least so many), labels and rows with any mark."""
    stars = {f"stars_{k}": F.coalesce("rating", F.lit(0)) >= k for k in range(1, 6)}
    marked = F.col("flag").isNotNull() | (F.coalesce("rating", F.lit(0)) > 0) | F.col("label").isNotNull()
    named = {"picks": F.col("flag") == "pick", "rejects": F.col("flag") == "reject", **stars, "red": F.col("label") == "red", "blue": F.col("label") == "blue", "marked": marked}
    return items.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in named.items()])


# The order in which sizes are listed; others come last.
SHOT_SIZES = ["close", "medium", "wide", "unknown", "unscored"]


def shot_sizes(items: DataFrame) -> DataFrame:
    """(value, n, pos): items of each size, `unscored` where none was worked out; pos is the place in the fixed order."""
    found = counts(items, F.coalesce("shot_size", F.lit("unscored")), "value")
    at = F.array_position(F.array(*map(F.lit, SHOT_SIZES)), F.col("value")).cast("int")
    return found.withColumn("pos", F.when(at > 0, at).otherwise(len(SHOT_SIZES) + 1))


def counts(items: DataFrame, key: Column | str, name: str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return items.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def angles(items: DataFrame, score: str = "score") -> DataFrame:
    """Per named camera: rows and the best one (largest score, ties to the earlier position)."""
    best = F.max_by(F.col("id"), F.struct(F.col(score), -F.col("pos")))
    return items.filter(F.coalesce("camera", F.lit("")) != "").groupBy("camera").agg(F.count("*").alias("n"), best.alias("best"), F.max(score).alias("best_score"))


def same_moment(items: DataFrame, anchor_id: int, window_s: float = 300.0) -> DataFrame:
    """Rows of other named cameras within a window of the anchor's time, with dt_s. The anchor is one row."""
    a = items.filter(F.col("id") == anchor_id).select(F.col("t").alias("_t"), F.col("camera").alias("_camera")).limit(1)
    dt = F.col("t") - F.col("_t")
    near = items.join(F.broadcast(a), F.abs(dt) <= window_s)
    return near.filter((F.col("id") != anchor_id) & (F.col("camera") != F.col("_camera"))).select("id", "camera", F.bround(dt, 1).alias("dt_s"))


def placements(items: DataFrame) -> DataFrame:
    """(id, folder, bytes) of an export: a row for each folder that an item lands in, by category, its guess if that is
    sure, and `aerial`. Sizes count once for each."""
    sure = F.coalesce("category_guess_score", F.lit(0.0)) >= flt.SURE
    folders = F.array_distinct(F.array_compact(F.array(
        F.coalesce(F.col("category"), F.lit("unclassified")), F.when((F.col("category") == "people") & sure, F.col("category_guess")), F.when(F.col("aerial") == 1, "aerial")
    )))
    return items.filter("status = 'ok'").select("id", F.explode(folders).alias("folder"), F.coalesce("size", F.lit(0)).alias("bytes"))


def usage_summary(events: DataFrame) -> DataFrame:
    """(what, key, n, seconds): counters for each event, seconds for each feature, and the number of sessions."""
    feature = F.when(F.col("ev").isin("tab_time", "ui_tab_time"), "tab").when(F.col("ev").isin("index_done", "classify_done", "focus_run", "export_done"), F.regexp_extract("ev", "^[a-z]+", 0)).when(F.col("ev").isin("search", "people_group"), F.col("ev"))
    seconds = F.coalesce("seconds", F.col("ms") / 1000.0, F.lit(0.0))
    by_ev = events.groupBy(F.lit("event").alias("what"), F.col("ev").alias("key")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("seconds"))
    by_feature = events.withColumn("f", feature).filter("f IS NOT NULL").groupBy(F.lit("feature").alias("what"), F.col("f").alias("key")).agg(F.count("*").alias("n"), F.bround(F.sum(seconds), 1).alias("seconds"))
    sessions = events.agg(F.countDistinct("session").alias("n")).select(F.lit("sessions").alias("what"), F.lit("all").alias("key"), "n", F.lit(None).cast("double").alias("seconds"))
    return by_ev.unionByName(by_feature).unionByName(sessions)


def pile_summary(pile: DataFrame, items: DataFrame) -> DataFrame:
    """One row: n, photos, videos and bytes of the picked rows (id, seq) that are still ok. Their ids in order are a sort of
    the same join by seq."""
    rows = pile.select("id", "seq").join(items.filter("status = 'ok'"), "id")
    clips = F.count_if(F.coalesce(F.col("kind") == "video", F.lit(False)))
    return rows.agg(F.count("*").alias("n"), (F.count("*") - clips).alias("photos"), clips.alias("videos"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stale_vectors(items: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """One row: how many vectors of ok items, and of the segments (photo_id, vector) of ok items, have another width."""
    ok = items.filter("status = 'ok'")
    parts = segments.join(ok.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    return ok.select("vector").unionByName(parts.select("vector")).agg(F.count_if(F.coalesce(F.size("vector") != width, F.lit(False)) & F.col("vector").isNotNull()).alias("stale"))


def cull_counts(cull: DataFrame) -> DataFrame:
    """(what, key, n) of frames (product, pick, reason): all, picked, products, and those left out for each reason."""
    one = cull.agg(F.count("*").alias("photos"), F.count_if("pick").alias("picked"), F.countDistinct("product").alias("products"))
    totals = one.unpivot([], ["photos", "picked", "products"], "what", "n").select("what", F.lit("all").alias("key"), "n")
    left = cull.filter("reason IS NOT NULL AND NOT pick").groupBy(F.lit("rejected").alias("what"), F.col("reason").alias("key")).agg(F.count("*").alias("n"))
    return totals.unionByName(left)


def cull_products(cull: DataFrame) -> DataFrame:
    """(product, n, picked, rejected, spare, cover) of frames (id, product, variant, angle, pick, reason): the cover is the first by
    variant, angle and id. Product 0, which holds what matches none, comes last; most frames first."""
    out = cull.groupBy("product").agg(
        F.count("*").alias("n"), F.count_if("pick").alias("picked"), F.count_if(F.expr("NOT pick AND reason IS NOT NULL")).alias("rejected"),
        F.count_if(F.expr("NOT pick AND reason IS NULL")).alias("spare"), F.min_by("id", F.struct("variant", "angle", "id")).alias("cover"),
    )
    return out.orderBy(F.col("product") == 0, F.desc("n"), "product")


def cull_plan(cull: DataFrame, names: DataFrame, colours: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """(id, folder, name, colour, angle, status, why) of every frame: picked ones have a folder <product>/<colour>; the others
    the reason in words. names: (product, name); colours: (product, variant, colour)."""
    p, v = F.col("product"), F.col("variant")
    rows = cull.join(names.select("product", "name"), "product", "left").join(colours.select("product", "variant", "colour"), ["product", "variant"], "left")
    name = F.coalesce("name", F.when(p == 0, "not matched to a product").otherwise(F.concat(F.lit("product "), p.cast("string"))))
    colour = F.when(p == 0, "").otherwise(F.coalesce("colour", F.concat(F.lit("colour "), v.cast("string"))))
    words = F.coalesce(*[F.when(F.col("reason") == k, w) for k, w in reasons.items()], F.lit("not needed for the target"))
    return rows.select("id", "pick", words.alias("words"), name.alias("name"), colour.alias("colour"), F.coalesce(F.concat(F.lit("angle "), F.nullif("angle", F.lit(0)).cast("string")), F.lit("")).alias("angle")).select(
        "id", F.when(F.col("pick"), F.concat_ws("/", S.safe_segment(F.col("name")), S.safe_segment(F.col("colour")))).alias("folder"), "name", "colour", "angle",
        F.when(F.col("pick"), "picked").otherwise("left out").alias("status"), F.when(F.col("pick"), "").otherwise(F.col("words")).alias("why"),
    )


def bounds(items: DataFrame) -> DataFrame:
    """One row: the box around all located ok items, and how many are located and not."""
    ok = items.filter("status = 'ok'")
    at = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    box = [f(F.when(at, F.col(c))).alias(n) for n, f, c in (("south", F.min, "lat"), ("west", F.min, "lon"), ("north", F.max, "lat"), ("east", F.max, "lon"))]
    return ok.agg(*box, F.count_if(at).alias("located"), F.count_if(~at).alias("unlocated"))


def score_maps(scores: DataFrame) -> DataFrame:
    """(photo_id, scores): a map from category to score; of a category's repeated rows the best counts."""
    best = scores.filter("category IS NOT NULL").groupBy("photo_id", "category").agg(F.max("score").alias("score"))
    return best.groupBy("photo_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("scores"))
