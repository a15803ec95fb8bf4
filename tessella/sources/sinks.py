"""Selections, plans and snapshots as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import scalars as S


def export_jobs(items: DataFrame, folder: Column, include_raw: bool = False) -> DataFrame:
    """(id, rel, folder) of the files to copy, an item's RAW sibling too if asked for."""
    rels = F.array_compact(F.array("rel", "sibling")) if include_raw else F.array("rel")
    return items.select("id", F.explode(rels).alias("rel"), S.safe_segment(folder).alias("folder"))


def destinations(jobs: DataFrame) -> DataFrame:
    """jobs with `dest`: names that clash in a folder, whatever their case, are numbered from the second on."""
    name, ext = S.stem(F.col("rel")), F.regexp_extract(S.basename(F.col("rel")), r"(?<=.)(\.[^.]*)$", 1)
    nth = F.row_number().over(Window.partitionBy("folder", F.lower(S.basename(F.col("rel")))).orderBy("id", "rel"))
    return jobs.withColumn("_n", nth).withColumn(
        "dest", F.concat_ws("/", "folder", F.concat(name, F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), ext))
    ).drop("_n")


def reconcile(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(dest, state) of planned files (dest, size, mtime) against those that exist: missing, already, clash."""
    e = existing.select("dest", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    same = (F.col("size") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) <= 2)
    return plan.join(e, "dest", "left").select("dest", F.when(F.col("_s").isNull(), "missing").when(same, "already").otherwise("clash").alias("state"))


def write_csv(items: DataFrame, path: str) -> None:
    """id, path and marks, guarded against formulas."""
    text = [f.name for f in items.schema if f.dataType.simpleString() == "string"]
    items.select(*[S.formula_guard(F.col(c)).alias(c) if c in text else c for c in items.columns]).write.mode("overwrite").option("header", "true").csv(path)


def write_manifest(plan: DataFrame, path: str) -> None:
    """A folder for each destination folder."""
    plan.write.mode("overwrite").partitionBy("folder").parquet(path)


def sidecars(items: DataFrame) -> DataFrame:
    """(path, xml) for items with marks; the first of a path stays, others are counted in `clashes`."""
    marked = items.filter(F.col("flag").isNotNull() | (F.coalesce("rating", F.lit(0)) > 0) | F.col("label").isNotNull())
    stars = F.when(F.col("flag") == "reject", F.lit(-1)).otherwise(F.coalesce("rating", F.lit(0)))
    escaped = F.replace(F.replace(F.replace(F.coalesce("label", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    xml = F.format_string('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description xmp:Rating="%d" xmp:Label="%s"/></x:xmpmeta>', stars.cast("int"), escaped)
    rows = marked.select("id", F.concat(F.regexp_replace("rel", r"\.[^./]*$", ""), F.lit(".xmp")).alias("path"), xml.alias("xml"))
    w = Window.partitionBy("path")
    return rows.withColumns({"_n": F.row_number().over(w.orderBy("id")), "clashes": F.count("*").over(w) - 1}).filter("_n = 1").drop("_n")


def store_plan(items: DataFrame) -> DataFrame:
    """Numbered names for each product, in the order they were taken."""
    order = Window.partitionBy("product").orderBy(F.col("taken_at").asc_nulls_last(), F.col("frame_no").asc_nulls_last(), "id")
    n = F.row_number().over(order)
    return items.withColumn("n", n).withColumn("name", F.format_string("%s_%03d", S.file_segment(F.col("product")), F.col("n")))


def move_plan(items: DataFrame) -> DataFrame:
    """(id, rel, dest): folder by aerial, video, person, then category."""
    folder = F.when(F.col("aerial") == 1, "aerial").when(F.col("kind") == "video", "videos").when(F.col("person").isNotNull(), S.safe_segment(F.col("person")))
    folder = folder.otherwise(F.coalesce(F.nullif("category", F.lit("other")), F.col("cluster"), F.lit("other")))
    jobs = items.select("id", "rel", folder.alias("folder"))
    return destinations(jobs).select("id", "rel", "dest")


def write_snapshot(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def segment_bytes(items: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, bytes) that trimmed segments would take: their share in the clip's length."""
    part = (F.col("end") - F.col("start")) / F.nullif(F.col("duration"), F.lit(0.0))
    return items.join(segments, "id").groupBy("id").agg(F.sum(F.coalesce(F.col("size") * F.least(part, F.lit(1.0)), F.lit(0.0))).alias("_b")).select("id", F.floor(F.col("_b") + 1e-6).alias("bytes"))
