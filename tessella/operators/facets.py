"""Faceted counts: each axis is counted under all filters but its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import filters as flt


def face_value() -> Column:
    n = flt.faces_of()
    return F.when(n == 0, "none").when(n == 1, "one").when(n == 2, "two").when(n >= flt.GROUP_FACES, "group")


def facet_values(columns: list[str]) -> dict[str, Column]:
    """For each axis the value, or array of values, that an item counts under. What is not known of an item is no value,
    but for a still's lens and exposure. Axes whose columns are absent are left out."""
    still, c = ~flt.is_clip(), F.col
    known = lambda x: F.nullif(x, F.lit(""))
    guess = F.when(c("category").isin("other", "people") & (c("category_guess") != c("category")), known(c("category_guess")))
    filed = F.array(c("category"), guess)
    filed = F.concat(filed, F.map_keys("also")) if "also" in columns else filed
    sets = [F.when(c(f"{k}_id").isNotNull(), k) for k in GROUPS if f"{k}_id" in columns]
    values = {
        "kind": F.when(flt.is_clip(), "videos").otherwise("photos"),
        "faces": F.when(face_value() == "group", F.array(F.lit("group"))).otherwise(F.array(face_value())),
        "categories": F.when(c("category").isNull(), F.array(F.lit("unclassified"))).otherwise(F.array_distinct(F.array_compact(filed))),
        "cameras": known(c("camera")),
        "shot_size": known(c("shot_size")),
        "slowmo": F.when(flt.is_clip(), flt.speed()),
        "look": F.when(flt.is_clip(), flt.look_of()),
        "duration": F.when(flt.is_clip(), S.duration_bucket(c("duration"))),
        "lens": F.when(still, F.coalesce(known(c("lens")), F.lit("unknown"))),
        "iso": F.when(still, S.bucket("iso", c("iso"))),
        "shutter": F.when(still, S.bucket("exposure_s", c("exposure_s"))),
        "aperture": F.when(still, S.bucket("fnumber", c("fnumber"))),
        "flash": F.when(still, S.bucket("flash", c("flash"))),
        "days": F.when(F.length(F.substring("taken_at", 1, 10)) == 10, F.substring("taken_at", 1, 10)),
        "drone": F.when(F.coalesce(c("aerial"), F.lit(0)) != 0, "drone"),
    }
    if "focal_mm" in columns:
        values["focal"] = F.when(still, S.bucket("focal_mm", c("focal_mm")))
    if "flicker" in columns:
        values["flicker"] = F.when(flt.is_clip() & c("flicker").isin("pulsing", "banding", "none"), c("flicker"))
    if sets:
        values["groups"] = F.array(*sets)
    return values


def named(axis: str, values: Column) -> Column:
    return F.transform(F.array_compact(values), lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("value")))


#: The filter field behind each axis, where its name differs.
FIELD = {"categories": "category", "cameras": "camera", "days": "day", "drone": "aerial", "groups": "group"}
#: Kinds of sets, each with a column of set ids.
GROUPS = ["burst", "bracket", "copies"]
MANY = ("faces", "categories", "groups")


def facet_counts(items: DataFrame, f: flt.Filters) -> DataFrame:
    """(axis, value, n), and a row (total, all, n). One scan: each row is marked with the axes it fails, and gives a pair
    (axis, value) for those axes that it fails no other of; pairs are counted with map-side sums."""
    values, tests = facet_values(items.columns), flt.predicates(f)
    by_axis = {a: tests[k] for a in values if (k := FIELD.get(a, a)) in tests}
    used = {FIELD.get(a, a) for a in by_axis}
    for k, p in tests.items():
        if k not in used:
            items = items.filter(p)
    fails = {a: F.when(p, 0).otherwise(1) for a, p in by_axis.items()}
    total = reduce(lambda x, y: x + y, fails.values(), F.lit(0))
    rows = items.select(total.alias("_fails"), *[p.alias(f"_f_{a}") for a, p in fails.items()], *[v.alias(f"_v_{a}") for a, v in values.items()])
    pairs = []
    for a, v in values.items():
        own = F.col(f"_f_{a}") if a in fails else F.lit(0)
        column = F.col(f"_v_{a}") if a in MANY else F.array(F.col(f"_v_{a}"))
        pairs.append(F.when(F.col("_fails") - own == 0, named(a, column)))
    pairs.append(F.when(F.col("_fails") == 0, F.array(F.struct(F.lit("total").alias("axis"), F.lit("all").alias("value")))))
    empty = F.array().cast("array<struct<axis: string, value: string>>")
    flat = rows.select(F.explode(F.concat(*[F.coalesce(p, empty) for p in pairs])).alias("p"))
    return flat.groupBy(F.col("p.axis").alias("axis"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def group_sets(items: DataFrame, f: flt.Filters) -> DataFrame:
    """(value, n): how many sets of each kind have an item that passes all filters but that on sets."""
    for k, p in flt.predicates(f).items():
        if k != "group":
            items = items.filter(p)
    pairs = F.array(*[F.struct(F.lit(k).alias("value"), F.col(f"{k}_id").cast("string").alias("set")) for k in GROUPS if f"{k}_id" in items.columns])
    sets = items.select(F.explode(pairs).alias("p")).select("p.*").filter("set IS NOT NULL").distinct()
    return sets.groupBy("value").agg(F.count("*").alias("n"))
