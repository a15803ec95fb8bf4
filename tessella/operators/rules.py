"""Rules that follow a score: which category holds, what else an item is, and states read off its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_INTERVIEW_S, SECOND, AERIAL_GAP = 600.0, 0.15, 0.015


def classified(items: DataFrame) -> DataFrame:
    """category, score and guess after the rules, in order: a clip of ten minutes with people or an interview among category
    and guess is an interview, by category and guess, as likely as the likelier of the two; an item with a face is people,
    its scene kept as the guess (or the best scene if likely).

    items: kind, duration, n_faces, category, score, guess, guess_score; people_p and interview_p, the probabilities of the
    two; scene and scene_p, the likeliest category that is neither.
    """
    talk = F.coalesce(F.col("category").isin("people", "interview"), F.lit(False)) | F.coalesce(F.col("guess").isin("people", "interview"), F.lit(False))
    long_ = F.coalesce((F.col("kind") == "video") & (F.col("duration") >= LONG_INTERVIEW_S), F.lit(False)) & talk
    faces = F.coalesce(F.col("n_faces") >= 1, F.lit(False))
    likelier = F.greatest(F.coalesce("people_p", F.lit(0.0)), F.coalesce("interview_p", F.lit(0.0)))
    was_scene = ~long_ & F.coalesce(~F.col("category").isin("people", "interview", "other"), F.lit(False))
    likely = F.coalesce(F.col("scene_p") >= SECOND, F.lit(False))
    return items.select(
        "*",
        F.when(faces, "people").when(long_, "interview").otherwise(F.col("category")).alias("new_category"),
        F.when(faces, 1.0).when(long_, likelier).otherwise(F.col("score")).alias("new_score"),
        F.when(~faces & long_, "interview").when(~faces, F.col("guess")).when(was_scene, F.col("category")).when(likely, F.col("scene")).otherwise("people").alias("new_guess"),
        F.when(~faces & long_, likelier).when(~faces, F.col("guess_score")).when(was_scene, F.col("score")).when(likely, F.col("scene_p")).otherwise(1.0).alias("new_guess_score"),
    )


def also_of(category: Column, guess: Column, cleared: Column) -> Column:
    """Secondary categories: those cleared without the winner and the guess of a people row; none for other."""
    own = F.map_filter(cleared, lambda k, _: ~k.eqNullSafe(category) & ~((category == "people") & k.eqNullSafe(guess)))
    return F.when(category != "other", own).otherwise(F.map_filter(cleared, lambda k, v: F.lit(False)))


def flash_state(bits: Column, strobe: Column, no_flash: Column) -> Column:
    """fired, none or unknown from the recorded bit and what is declared of the set."""
    return F.when((bits >= 0) & (bits.bitwiseAND(1) == 1), "fired").when(strobe, "fired").when(no_flash | (bits >= 0), "none").otherwise("unknown")


def aerial(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """aerial set where the gap to ground scenes reaches the threshold or the name is a drone's; it is never unset."""
    named = F.regexp_extract("rel", r"([^/]*)$", 1).rlike(r"(?i)^DJI_")
    found = items.join(gaps.select("id", "gap"), "id", "left")
    on = (F.coalesce("aerial", F.lit(0)) == 1) | named | F.coalesce(F.col("gap") >= AERIAL_GAP, F.lit(False))
    return found.withColumn("aerial", on.cast("long")).drop("gap")


def whole_jpeg(content: Column) -> Column:
    """Whether a JPEG starts and ends as one: True or False, null for other data."""
    start, end = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, -2, 2))
    return F.when(start == "FFD8", end == "FFD9")


def estimated_seconds(mode: str, copy_bytes: Column, web_files: Column, rates: dict[str, float]) -> Column:
    """Seconds that an export takes at measured rates (bytes and files a second), or at cautious ones."""
    if mode == "symlink":
        return F.lit(0.0)
    return copy_bytes / rates.get("bytes", 100e6) + web_files / rates.get("web", 4.0)


def lifecycle(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known rows (rel, status) after a scan that found `seen` (rel, outcome ok or error): what was pending and not found
    goes, what was ok and not found is missing, and a missing row that is found is ok again."""
    x = known.join(seen, "rel", "full_outer")
    status = (
        F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("status") == "ok", "missing").when(F.col("status") == "pending", F.lit(None)).otherwise(F.col("status"))
    )
    return x.select("rel", status.alias("status")).filter("status IS NOT NULL")
