"""Catalogue tables derived from the supplied ones: items from events, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns in an SQL that both engines read alike; `k` and `v` come from the event.
SHARED = {
    "id": "event_id",
    "dir": "concat('u', CAST(user_id AS STRING))",
    "kind": "CASE WHEN k < 25 THEN 'video' WHEN k % 17 = 0 THEN NULL ELSE 'photo' END",
    "duration": "CASE WHEN k < 25 THEN v * 3 END",
    "fps": "CASE WHEN k >= 25 THEN NULL WHEN k % 4 = 0 THEN 120.0e0 WHEN k % 4 = 1 THEN 25.0e0 WHEN k % 4 = 2 THEN NULL ELSE 50.0e0 END",
    "capture_fps": "CASE WHEN k < 25 AND k % 6 = 1 THEN 100.0e0 END",
    "gamma": "CASE WHEN k >= 25 THEN NULL WHEN k % 5 = 0 THEN 'S-Log3' WHEN k % 5 = 1 THEN '' WHEN k % 5 = 2 THEN NULL ELSE 'rec709' END",
    "camera": "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('CAM', CAST(user_id % 7 AS STRING)) END",
    "lens": "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '' ELSE concat('L', CAST(k % 4 AS STRING)) END",
    "category": "CASE WHEN k % 23 = 0 THEN NULL WHEN k < 20 THEN 'other' ELSE event_type END",
    "category_score": "CASE WHEN k % 12 = 0 THEN NULL ELSE k / 100.0e0 END",
    "category_guess": "CASE WHEN k % 10 = 3 THEN 'people' ELSE event_type END",
    "category_guess_score": "CASE WHEN k % 15 = 0 THEN NULL ELSE (100 - k) / 100.0e0 END",
    "cluster": "CASE WHEN k % 6 = 0 THEN NULL ELSE concat('group ', CAST(k % 5 AS STRING)) END",
    "cluster_score": "CASE WHEN k % 6 = 1 THEN NULL ELSE (k % 50) / 50.0e0 END",
    "sharp": "CASE WHEN k % 29 = 0 THEN NULL ELSE v END",
    "n_faces": "CASE WHEN k % 31 = 0 THEN NULL ELSE k % 5 END",
    "people": "CASE WHEN k < 25 AND k % 3 <> 0 THEN k % 4 END",
    "rating": "CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 END",
    "flag": "CASE WHEN k % 10 < 2 THEN 'pick' WHEN k % 10 = 2 THEN 'reject' END",
    "label": "CASE WHEN k % 8 = 1 THEN 'red' WHEN k % 8 = 2 THEN 'blue' END",
    "aerial": "CASE WHEN k % 19 = 0 THEN 1 WHEN k % 19 = 1 THEN NULL ELSE 0 END",
    "status": "CASE WHEN k % 37 = 0 THEN 'error' WHEN k % 41 = 0 THEN 'pending' ELSE 'ok' END",
    "focus": "CASE WHEN k % 14 = 0 THEN 'bad' WHEN k % 14 < 4 THEN 'soft' WHEN k % 14 = 5 THEN NULL ELSE 'ok' END",
    "shot_size": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'close' WHEN k % 4 = 2 THEN 'medium' ELSE 'wide' END",
    "size": "k * 1000 + event_id % 1000",
    "lat": "CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(user_id % 120 - 60 AS DOUBLE) + k / 1000.0e0 END",
    "lon": "CASE WHEN k % 13 = 0 THEN NULL ELSE CAST((user_id * 7) % 360 - 180 AS DOUBLE) + k / 1000.0e0 END",
    "iso": "CASE WHEN k % 7 = 0 THEN 0 WHEN k % 7 = 1 THEN NULL ELSE 100 * (k % 7) * (k % 7) * (k % 7) END",
    "fnumber": "CASE WHEN k % 16 = 0 THEN NULL ELSE 1.4e0 * (1 + k % 9) END",
    "exposure_s": "CASE WHEN k % 18 = 0 THEN 0.0e0 ELSE 1.0e0 / (2 + k * k) END",
    "ev_bias": "CASE WHEN k % 2 = 0 THEN (k % 7 - 3) / 3.0e0 END",
    "flash": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN -1 ELSE k % 32 END",
    "focal_mm": "CASE WHEN k % 21 = 0 THEN NULL ELSE 12.0e0 + k * 2 END",
    "flicker": "CASE WHEN k % 4 = 0 THEN 'pulsing' WHEN k % 4 = 1 THEN 'none' WHEN k % 4 = 2 THEN 'unknown' END",
    "qhash": "concat('q', CAST((event_id * 7919) % 9000 AS STRING))",
}
_DOUBLES = {"duration", "fps", "capture_fps", "category_score", "category_guess_score", "cluster_score", "lat", "lon", "fnumber", "exposure_s", "ev_bias", "sharp", "focal_mm"}
_LONGS = {"n_faces", "people", "rating", "aerial", "size", "iso", "flash", "id"}


def _typed(name: str, sql: str, string: str) -> str:
    sql = sql.replace("AS STRING", f"AS {string}")
    kind = "DOUBLE" if name in _DOUBLES else "BIGINT" if name in _LONGS else string
    return f"CAST({sql} AS {kind}) AS {name}"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, as a still or a clip."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", F.col("value").alias("v"), F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k")
    )
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id")).cast("long")
    e = e.selectExpr(
        *[_typed(c, s, "STRING") for c, s in SHARED.items()], "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS taken_at",
        "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t", "user_id", "ts",
    ).withColumn("frame_no", nth)
    name = F.concat(F.col("dir"), F.lit("/DSC"), F.lpad(F.col("frame_no").cast("string"), 5, "0"), F.lit(".jpg"))
    return e.withColumn("rel", name).drop("ts")


def _duck() -> str:
    columns = ", ".join(_typed(c, s, "VARCHAR") for c, s in SHARED.items())
    return f"""e AS (SELECT event_id, user_id, ts, event_type, value AS v, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
items AS (SELECT *, dir || '/DSC' || lpad(CAST(frame_no AS VARCHAR), 5, '0') || '.jpg' AS rel FROM (
  SELECT {columns}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS taken_at, epoch_us(ts) / 1e6 AS t, user_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no FROM e))"""


#: A WITH list that defines `items` in DuckDB.
ITEMS_SQL = _duck()
