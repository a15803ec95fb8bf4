"""Exact percentiles of groups of any size, without a shuffle of their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.shared import stored

#: Values of a group that are put in order at the end, steps of a sketch's grid, and its accuracy.
MOST, GRID, ACCURACY = 100_000, 200, 10_000


def percentiles(df: DataFrame, key: str, value: str, shares: list[float], most: int = MOST) -> DataFrame:
    """(key, values): for each share, the percentile of a key's values that are not null, between neighbours in proportion.

    Each value sought is one or two places in a key's order. A pass over the rows counts those below, at and inside two bounds of
    a place, and sketches what is inside; the sketch moves the bounds to some hundredths of it. When no more than `most` values are
    inside, they are counted value by value. A pass aggregates on the map side, so a key with all of the rows takes no longer
    than others, and equal values are nothing but a count.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "percentile-sizes")
    at = lambda s: F.lit(s) * (F.col("n") - 1)
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(s)), F.ceil(at(s))) for s in shares])))
    open_ = stored(sizes.select("key", "lo", "hi", F.explode(places).alias("k")), "percentile-places")
    grid, v = [i / GRID for i in range(GRID + 1)], F.col("v")
    done = []
    while True:
        own = open_.select(F.col("key").alias("_key"), "k", "lo", "hi")
        inside = (v > F.col("lo")) & (v < F.col("hi"))
        met = rows.join(own, F.col("key").eqNullSafe(F.col("_key"))).groupBy("key", "k", "lo", "hi").agg(
            F.count_if(v < F.col("lo")).alias("below"), F.count_if(v == F.col("lo")).alias("at"), F.count_if(inside).alias("inside"),
            F.percentile_approx(F.when(inside, v), grid, ACCURACY).alias("q"),
        )
        place = F.col("k") - F.col("below") - F.col("at")  # from 0, of those inside
        found = F.when(place < 0, F.col("lo")).when(place >= F.col("inside"), F.col("hi"))
        met = stored(met.withColumns({"place": place, "found": found}), "percentile-bounds")
        done.append(met.filter("found IS NOT NULL").select("key", "k", "found"))
        few = met.filter((F.col("found").isNull()) & (F.col("inside") <= most)).select(F.col("key").alias("_key"), "k", "lo", "hi", "place")
        counts = rows.join(few, F.col("key").eqNullSafe(F.col("_key"))).filter(inside).groupBy("key", "k", "place", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("key", "k").orderBy("v"))
        done.append(counts.withColumn("upto", upto).filter("upto > place").groupBy("key", "k").agg(F.min("v").alias("found")))
        more = met.filter((F.col("found").isNull()) & (F.col("inside") > most))
        step = F.col("place") / F.col("inside") * GRID
        low, high = F.greatest(F.floor(step).cast("int") - 1, F.lit(0)), F.least(F.ceil(step).cast("int") + 1, F.lit(GRID))
        # The ends of the grid are the outermost values inside, which a place beyond a sketch's error may be at.
        open_ = stored(more.select("key", "k", F.col("q")[low].alias("lo"), F.col("q")[high].alias("hi")), "percentile-places")
        if open_.isEmpty():
            break
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    values = all_.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("k", "found"))).alias("m"))
    pick = lambda i: F.col("m")[i.cast("long")]
    between = [pick(F.floor(at(s))) + (pick(F.ceil(at(s))) - pick(F.floor(at(s)))) * (at(s) - F.floor(at(s))) for s in shares]
    return sizes.join(values, F.col("key").eqNullSafe(F.col("_key"))).select(F.col("key").alias(key), F.array(*between).alias("values"))
