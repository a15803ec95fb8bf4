"""The conjunctive filter: every field that is set adds a predicate; nulls fail unless a field says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

GROUP_FACES, SURE = 3, 0.5
FACES = {"none": lambda n: n == 0, "one": lambda n: n == 1, "two": lambda n: n == 2, "group": lambda n: n >= GROUP_FACES}


@dataclass(frozen=True)
class Filters:
    sharp_min_pct: float | None = None
    faces: str | None = None
    kind: str | None = None
    aerial: bool | None = None
    shot_size: str | None = None
    slowmo: str | None = None
    camera: str | None = None
    look: str | None = None
    flicker: str | None = None
    duration: str | None = None
    hide_bad: bool = False
    hide_soft: bool = False
    category: str | None = None
    cluster: str | None = None
    taken_from: str | None = None
    taken_to: str | None = None
    day: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    group: str | None = None
    lens: str | None = None
    focal: str | None = None
    iso: str | None = None
    shutter: str | None = None
    aperture: str | None = None
    flash: str | None = None
    product: int | None = None
    variant: int | None = None
    flag: str | None = None
    stars_min: int | None = None
    label: str | None = None
    sure_only: bool = False

    def __post_init__(self):
        for name, allowed in (
            ("faces", {*FACES}), ("kind", {"photos", "videos"}), ("slowmo", {"slow", "normal"}), ("look", {"log", "standard"}),
            ("group", {"burst", "bracket", "copies"}), ("duration", {x[0] for x in S.DURATIONS}),
        ):
            if getattr(self, name) not in {None} | allowed:
                raise ValueError(f"{name} is one of {sorted(allowed)}")


def is_clip() -> Column:
    return F.coalesce(F.col("kind"), F.lit("photo")) == "video"


def faces_of() -> Column:
    """People counted in a clip (null if never looked at), faces on a still."""
    return F.when(is_clip(), F.col("people")).otherwise(F.coalesce(F.col("n_faces"), F.lit(0)))


def speed() -> Column:
    """slow, normal, or null where neither rate is known; clips only."""
    rate = F.greatest("fps", "capture_fps")
    return F.when(is_clip() & rate.isNotNull(), F.when(rate >= S.SLOW_FPS, "slow").otherwise("normal"))


def look_of() -> Column:
    """log or standard, of clips whose gamma was read and is not empty."""
    return F.when(is_clip() & (F.col("gamma") != ""), F.when(S.is_log(F.col("gamma")), "log").otherwise("standard"))


def category_match(cat: str, also: Column | None = None) -> Column:
    """Struct(sure, confidence) of an item in a category, or null. also: map of secondary categories to scores."""
    c, s, g, gs = F.col("category"), F.col("category_score"), F.col("category_guess"), F.coalesce("category_guess_score", F.lit(0.0))
    made = lambda sure, conf: F.struct(sure.alias("sure"), conf.cast("double").alias("confidence"))
    yes = made(F.lit(True), F.lit(1.0))
    if cat == "unclassified":
        return F.when(c.isNull(), yes)
    own = yes if cat == "other" else F.when(s.isNull(), yes).otherwise(made(s >= SURE, s))
    out = F.when(c == cat, own).when((c == "other") & (g == cat), made(F.lit(False), gs))
    if cat != "people":
        out = out.when((c == "people") & (g == cat), made(gs >= SURE, gs))
    if also is not None:
        out = out.when(also[cat].isNotNull(), made(also[cat] >= SURE, also[cat]))
    return out


def cluster_match(name: str) -> Column:
    s = F.col("cluster_score")
    return F.when(
        F.col("cluster") == name,
        F.struct(F.coalesce(s >= SURE, F.lit(True)).alias("sure"), F.coalesce(s, F.lit(1.0)).alias("confidence")),
    )


def predicates(f: Filters) -> dict[str, Column]:
    """A predicate for each field that is set; null counts as false."""
    still, c = ~is_clip(), F.col
    out: dict[str, Column] = {}
    if f.sharp_min_pct is not None:
        out["sharp"] = c("sharp_pct") >= f.sharp_min_pct
    if f.faces:
        out["faces"] = FACES[f.faces](faces_of())
    if f.kind:
        out["kind"] = is_clip() if f.kind == "videos" else still
    if f.aerial is not None:
        out["aerial"] = (F.coalesce(c("aerial"), F.lit(0)) != 0) == f.aerial
    for name in ("shot_size", "camera", "day", "product", "variant"):
        if getattr(f, name) is not None:
            out[name] = (F.substring("taken_at", 1, 10) if name == "day" else c(name)) == getattr(f, name)
    if f.slowmo:
        out["slowmo"] = speed() == f.slowmo
    if f.look:
        out["look"] = look_of() == f.look
    if f.flicker:
        out["flicker"] = is_clip() & (c("flicker") == f.flicker)
    if f.duration:
        out["duration"] = is_clip() & (S.duration_bucket(c("duration")) == f.duration)
    if f.hide_bad or f.hide_soft:
        out["hide"] = ~F.coalesce(c("focus"), F.lit("")).isin(*(["soft", "bad"] if f.hide_soft else ["bad"]))
    if f.category:
        out["category"] = category_match(f.category).isNotNull()
    if f.cluster:
        out["cluster"] = c("cluster") == f.cluster
    if f.taken_from or f.taken_to:
        at = F.coalesce(c("taken_at"), F.lit(""))
        out["taken"] = (at >= (f.taken_from or "")) & (at <= f.taken_to if f.taken_to else F.lit(True))
    if f.bbox:
        south, west, north, east = f.bbox
        lon = c("lon").between(west, east) if west <= east else (c("lon") >= west) | (c("lon") <= east)
        out["bbox"] = c("lat").between(south, north) & lon
    if f.group:
        out["group"] = c(f"{f.group}_id").isNotNull()
    if f.lens:
        out["lens"] = still & (F.coalesce(F.nullif(c("lens"), F.lit("")), F.lit("unknown")) == f.lens)
    for name, axis in (("focal", "focal_mm"), ("iso", "iso"), ("shutter", "exposure_s"), ("aperture", "fnumber"), ("flash", "flash")):
        if getattr(f, name):
            out[name] = still & (S.bucket(axis, c(axis)) == getattr(f, name))
    for name in ("flag", "label"):
        if getattr(f, name):
            out[name] = F.coalesce(c(name), F.lit("none")) == getattr(f, name)
    if f.stars_min is not None:
        out["stars"] = F.coalesce(c("rating"), F.lit(0)) >= f.stars_min
    return {k: F.coalesce(p, F.lit(False)) for k, p in out.items()}


def apply(items: DataFrame, f: Filters) -> DataFrame:
    for p in predicates(f).values():
        items = items.filter(p)
    return items


def with_confidence(items: DataFrame, f: Filters) -> DataFrame:
    """sure and confidence: both matches must be sure, and the smaller confidence counts; items that match none go."""
    matches = [m for m in (f.category and category_match(f.category), f.cluster and cluster_match(f.cluster)) if m is not None]
    if not matches:
        return items.withColumns({"sure": F.lit(True), "confidence": F.lit(1.0)})
    sure, confidence = F.lit(True), F.lit(1.0)
    for i, m in enumerate(matches):
        items = items.withColumn(f"_m{i}", m).filter(F.col(f"_m{i}").isNotNull())
        sure, confidence = sure & F.col(f"_m{i}.sure"), F.least(confidence, F.col(f"_m{i}.confidence"))
    items = items.withColumns({"sure": sure, "confidence": F.bround(confidence, 4)}).drop(*[f"_m{i}" for i in range(len(matches))])
    return items.filter("sure") if f.sure_only else items
