"""What a shoot's tables say about its state, and logs that are read on from a place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import filters as flt
from tessella.operators import search

KEEP = 50_000
LARGEST_PAGE = 1000
#: Jobs that can be cut off and gone on with.
JOBS = ("scan", "focus")


def one_row(*parts: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def shoot_stats(items: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row: photos and clips that are ok, faces, people, errors (problems of ok items too), photos to be looked for faces,
    and focus verdicts."""
    ok, clip = F.col("status") == "ok", flt.is_clip()
    trouble = F.col("problem").isNotNull() if "problem" in items.columns else F.lit(False)
    named = {
        "photos": ok & ~clip, "videos": ok & clip, "errors": (F.col("status") == "error") | (ok & trouble), "faces_pending": ok & F.col("n_faces").isNull(),
        "bad": ok & (F.col("focus") == "bad"), "soft": ok & (F.col("focus") == "soft"),
    }
    counts = items.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in named.items()])
    return one_row(counts, faces.agg(F.count("*").alias("faces")), people.agg(F.count("*").alias("people")))


def scan_health(items: DataFrame, jobs: DataFrame, here: DataFrame) -> DataFrame:
    """One row: on_disk, new_on_disk (files (rel) that no item (rel, status, vector, n_faces) has), pending, unembedded,
    faces_pending, complete, interrupted (kind of the job (id, kind, state) that was cut off last; a scan only while it is not
    complete) and fix: what closes the gap, null if there is none."""
    ok = F.col("status") == "ok"
    named = {"pending": F.col("status") == "pending", "unembedded": ok & F.col("vector").isNull(), "faces_pending": ok & F.col("n_faces").isNull()}
    counts = items.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in named.items()])
    latest = jobs.filter(F.col("kind").isin(*JOBS)).groupBy("kind").agg(F.max(F.struct("id", "state")).alias("j"))
    cut = latest.agg(*[F.max(F.when((F.col("kind") == k) & (F.col("j.state") == "interrupted"), F.col("j.id"))).alias(f"_{k}") for k in JOBS])
    disk = here.agg(F.count("*").alias("on_disk"))
    new = here.join(items.select("rel"), "rel", "left_anti").agg(F.count("*").alias("new_on_disk"))
    row = one_row(counts, cut, disk, new).withColumn("complete", (F.col("pending") == 0) & (F.col("unembedded") == 0))
    scan, focus = F.when(~F.col("complete"), F.col("_scan")), F.col("_focus")
    row = row.withColumn("interrupted", F.when(scan.isNotNull() & (focus.isNull() | (scan > focus)), "scan").when(focus.isNotNull(), "focus"))
    fix = (
        F.when(~F.col("complete") | F.coalesce(F.col("interrupted") == "scan", F.lit(False)), "continue").when(F.col("interrupted") == "focus", "focus")
        .when(F.col("new_on_disk") > 0, "rescan").when(F.col("faces_pending") > 0, "faces")
    )
    return row.withColumn("fix", fix).drop("_scan", "_focus")


def shoot_facts(shoots: DataFrame, items: DataFrame) -> DataFrame:
    """shoots (shoot) with the photos and videos of their ok items (shoot, kind, status), their sum and whether there are any."""
    clip = F.coalesce(F.col("kind") == "video", F.lit(False))
    counts = items.filter("status = 'ok'").groupBy("shoot").agg(F.count_if(~clip).alias("photos"), F.count_if(clip).alias("videos"))
    rows = shoots.join(counts, "shoot", "left").fillna(0, ["photos", "videos"])
    return rows.withColumn("items", F.col("photos") + F.col("videos")).withColumn("indexed", F.col("items") > 0)


def faces_beside_cover(faces: DataFrame, items: DataFrame, covers: DataFrame, n: int) -> DataFrame:
    """(person_id, pos, id): the n best faces (id, photo_id, person_id, score) of each person but the cover (person_id, cover),
    ties to the smaller id. Faces of pictures that are gone don't count; each task sends n of a person at most."""
    rows = faces.join(items.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").filter("person_id IS NOT NULL")
    rows = rows.join(covers.select("person_id", F.col("cover").alias("id")), ["person_id", "id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc_nulls_last("score"), "id"))
    return rows.withColumn("pos", nth).filter(F.col("pos") <= n).select("person_id", "pos", "id")


def result_size(items: DataFrame, f: flt.Filters, keys: list[str]) -> DataFrame:
    """One row of a search: total rows, and folded, the rows left if each set (of the first key that a row has) counts once."""
    key = F.coalesce(*[F.when(F.col(k).isNotNull(), F.concat_ws(":", F.lit(k), F.col(k).cast("string"))) for k in keys], F.concat_ws(":", F.lit("id"), F.col("id").cast("string")))
    return flt.apply(items, f).agg(F.count("*").alias("total"), F.countDistinct(key).alias("folded"))


def clamped_page(items: DataFrame, f: flt.Filters, limit: int = 50, offset: int = 0, **how) -> DataFrame:
    """A page of 1 to 1000 rows, whatever is asked for."""
    return search.page(items, f, limit=min(max(limit, 1), LARGEST_PAGE), offset=max(offset, 0), **how)


def newest(events: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows in the order of columns that are unique together."""
    return events.orderBy(*[F.desc(c) for c in by]).limit(n)


def events_since(log: DataFrame, after: int, keep: int = KEEP) -> DataFrame:
    """(seq, ..., reset): rows of a log (seq, unique) after a reader's place. A log holds its newest rows only: a reader whose place
    lies before them or beyond the last one gets no rows but a single one with reset true, and has to begin anew."""
    held = newest(log, keep, "seq")
    ends = held.agg(F.min("seq").alias("_first"), F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    lost = (F.lit(after) > F.col("_last")) | (F.lit(after) < F.coalesce("_first", F.col("_last") + 1) - 1)
    ends = ends.select(lost.alias("_lost"))
    rows = held.filter(F.col("seq") > after).join(F.broadcast(ends.filter("NOT _lost")), F.lit(True), "left_semi").withColumn("reset", F.lit(False))
    return rows.unionByName(ends.filter("_lost").select(F.lit(True).alias("reset")), allowMissingColumns=True)


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with `reason`: the name of the first check that holds, null for sound rows. Works on a stream too: sound rows go on, and
    the others to a table of their own, instead of ending the stream."""
    return rows.withColumn("reason", F.coalesce(*[F.when(p, k) for k, p in checks.items()], F.lit(None).cast("string")))


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of a key's rows with gaps up to `gap`; end is the last row's time. Partial runs merge before the
    shuffle; a stream needs a watermark on `at`."""
    found = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.max(at).alias("end"), F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), "end", "n")


def segment_vectors(segments: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Segments (photo_id, vector) of clips that are ok whose vector has the right width."""
    clips = items.filter("status = 'ok' AND kind = 'video'").select(F.col("id").alias("photo_id"))
    return segments.filter(F.size("vector") == width).join(clips, "photo_id", "left_semi")
