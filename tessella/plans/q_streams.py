"""Streams over the event table, each drained to a table and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.plans.catalogue import query
from tessella.plans.items import items, table
from tessella.sources.shared import shared_dir
from tessella.streaming import live, models, runs, tags

#: Rows of one file, which are a batch; a table has three files at least, so that state is carried over.
FILE_ROWS = 1_000_000


def _landed(spark, df, order: str | None = None) -> tuple[str, str]:
    """The rows as files of a folder that a stream reads, and a folder for its output. With an order, the files are ranges of it
    that land one after the other: written at once, then stamped with times in their order, as a stream takes the oldest first."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    n = max(3, -(-df.count() // FILE_ROWS))
    (df.repartition(n) if order is None else df.repartitionByRange(n, order)).write.parquet(f"{base}/in")
    if order is not None:
        # Names of a range's files begin with its number, padded; a listing holds names only.
        files = sorted((f for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in")) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
        for i, f in enumerate(files):
            fs.setTimes(f.getPath(), files[0].getModificationTime() + 1000 * i, -1)
    return base, df.schema


def _drain(spark, rows, f, per_trigger: int = 1, order: str | None = None):
    base, schema = _landed(spark, rows, order)
    stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{base}/in"))
    return live.drained(stream, f"{base}/out", f"{base}/state")


@query("stream_dedup", "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS rel, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 5 AS size, 1 AS mtime FROM events")
def stream_dedup(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rel"), (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 5).alias("size"), F.lit(1).alias("mtime"))
    return _drain(spark, rows, live.deduplicated)


@query("stream_centroids")
def stream_centroids(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = v.select(F.col("label").cast("string").alias("product"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 9 == 0).alias("soft"), F.col("embedding").alias("vector"))
    return _drain(spark, rows, lambda s: live.assign_leaders("product", s, 0.3), order="seq")


@query("stream_alerts", """WITH f AS (SELECT event_type AS product, event_id AS seq, value / 100 AS level, CAST(user_id % 7 AS VARCHAR) AS setting, user_id % 2 = 0 AS strobe FROM events),
m AS (SELECT *, CASE WHEN count(level) OVER w >= 3 AND median(level) OVER w >= 0.02 THEN log2(median(level) OVER w / greatest(level, 1e-4)) END AS d FROM f WINDOW w AS (PARTITION BY product, setting ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))
SELECT product, seq, round(d, 6) AS drop, CASE WHEN strobe AND d >= 1.5 THEN 'flash_miss' WHEN d >= 1 THEN 'dark' END AS alert FROM m""")
def stream_alerts(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("product"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("level"), (F.col("user_id") % 7).cast("string").alias("setting"), (F.col("user_id") % 2 == 0).alias("strobe"))
    return _drain(spark, rows, live.alerts, order="seq").withColumn("drop", F.round("drop", 6))


# With a year's allowance nothing is late, so pairs are whole; RAWs alone stay in the state.
@query("stream_pair", """WITH f AS (SELECT event_id, ts, user_id, event_id % 2 = 0 AS is_raw FROM events)
SELECT 'f' || CAST(r.event_id AS VARCHAR) AS raw, 'f' || CAST(s.event_id AS VARCHAR) AS standard FROM f r JOIN f s ON r.user_id = s.user_id AND r.is_raw AND NOT s.is_raw AND abs(epoch_us(r.ts) - epoch_us(s.ts)) <= 3000000000""")
def stream_pair(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("dir"), F.lit("x").alias("stem"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("rel"), (F.col("event_id") % 2 == 0).alias("is_raw"))
    return _drain(spark, rows, lambda s: live.paired(s, 3000, "3650 days").drop("at"), per_trigger=2)


@query("stream_delivered", "SELECT event_id, user_id FROM events")
def stream_delivered(spark, sf):
    base, schema = _landed(spark, table(spark, sf, "events").select("event_id", "user_id"))
    return live.delivered(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/out", f"{base}/state")


@query("stream_runs")
def stream_runs(spark, sf):
    """A shoot for each user, whose frames come in the order of time, on a clock that makes neighbours of them."""
    rows = items(spark, sf)
    bright = S.brightness(F.col("fnumber"), F.col("exposure_s"), F.col("iso"), F.col("ev_bias"))
    ev = S.ev100(F.col("fnumber"), F.col("exposure_s"), F.col("iso"))
    none = F.lit(None).cast("array<double>")
    rows = rows.select(
        F.col("dir").alias("shoot"), F.col("frame_no").alias("seq"), "id", "dir", "rel", F.coalesce("kind", F.lit("photo")).alias("kind"), (F.col("t") / 40000.0).alias("t"),
        "camera", "frame_no", ev.alias("ev"), bright.alias("bright"), "exposure_s", F.lit(None).cast("int").alias("exp_mode"), none.alias("vector"), none.alias("field"),
    )
    with live.rich_state(spark):
        return runs.settled(_drain(spark, rows, runs.live_runs, order="seq"))


# Files land in no order of time, so most tags and half of the standard files are late.
@query("stream_tagged", """WITH e AS (SELECT event_id, ts, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
t AS (SELECT CONCAT('s', event_id % 20) AS shoot, ts AS moment, event_id AS seq, CASE WHEN k >= 2 THEN event_type END AS product FROM e WHERE k < 15),
f AS (SELECT CONCAT('s', event_id // 2 % 20) AS shoot, event_id // 2 AS stem, ts AS moment, event_id AS id, event_id % 2 = 0 AS is_raw FROM e WHERE k >= 15),
r AS (SELECT shoot, stem, min(moment) AS moment, arg_min(id, moment) AS id, bool_or(is_raw) AS has_raw, bool_or(NOT is_raw) AS has_std FROM f GROUP BY 1, 2)
SELECT r.shoot, CAST(stem AS VARCHAR) AS stem, id, CONCAT(stem, CASE WHEN has_std THEN '.jpg' ELSE '.arw' END) AS rel, CASE WHEN has_std AND has_raw THEN CONCAT(stem, '.arw') END AS sibling, product
FROM r ASOF LEFT JOIN t ON r.shoot = t.shoot AND r.moment >= t.moment""")
def stream_tagged(spark, sf):
    k, pair = F.regexp_extract("props", r"(\d+)", 1).cast("int"), F.expr("event_id div 2")
    is_tag, is_raw = k < 15, F.col("event_id") % 2 == 0
    stem = pair.cast("string")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.when(is_tag, F.col("event_id") % 20).otherwise(pair % 20).cast("string")).alias("shoot"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"), is_tag.alias("is_tag"), F.when(k >= 2, F.col("event_type")).alias("product"), F.lit("d").alias("dir"), stem.alias("stem"),
        F.concat(stem, F.when(is_raw, ".arw").otherwise(".jpg")).alias("rel"), is_raw.alias("is_raw"), F.col("event_id").alias("id"),
    )
    base, schema = _landed(spark, rows)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    frames = stream.filter("NOT is_tag").select("shoot", "at", "dir", "stem", "rel", "is_raw", "id")
    versions = tags.tagged(frames, stream.filter("is_tag").select("shoot", "at", "seq", "product"), late="3650 days", lanes=4)
    with live.rich_state(spark):
        return tags.latest(live.delivered(versions, f"{base}/out", f"{base}/state")).select("shoot", "stem", "id", "rel", "sibling", "product")


@query("stream_models")
def stream_models(spark, sf):
    """A hundred shoots with five people each; some names are typed, some faces soft."""
    at = F.timestamp_seconds(F.col("vec_id"))
    face = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("vec_id") * 7 % 5, 1.0).otherwise(0.0))
    rows = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 100).cast("string").alias("shoot"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("id"), at.alias("at"),
        F.when(F.col("vec_id") % 97 == 0, F.concat(F.lit("P"), (F.col("vec_id") % 5).cast("string"))).alias("typed"), face.alias("face"), (F.col("vec_id") % 9 == 0).alias("soft"),
    )
    with live.rich_state(spark):
        return models.told(_drain(spark, rows, models.cast, order="seq"))
