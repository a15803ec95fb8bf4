"""Piles of points, and nearest places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import EARTH_KM, haversine_km

CELL_KM, MERGE_KM, NAME_KM, KM_PER_DEGREE = 25.0, 50.0, 100.0, 111.0


def grid_cells(points: DataFrame, km: float = CELL_KM) -> DataFrame:
    """Cells of about km: n, mean and box of (lat, lon). Sums are made on the map side."""
    d = km / KM_PER_DEGREE
    return (
        points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(F.floor(F.col("lat") / d).alias("cell_y"), F.floor(F.col("lon") / d).alias("cell_x"))
        .agg(
            F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat").alias("south"), F.max("lat").alias("north"),
            F.min("lon").alias("west"), F.max("lon").alias("east"),
        )
    )


def nearest_city(points: DataFrame, cities: DataFrame, max_km: float = NAME_KM, most: int = 50_000) -> DataFrame:
    """points (id, lat, lon) with the nearest city's name, country and distance within max_km, else nulls.

    Points and cities meet by cells of one degree of latitude, so that only cities nearby are compared: a city is sent to
    the cells within reach. Beyond the polar circles, where a degree of longitude is short, all longitudes are reached.
    """
    reach = max_km / KM_PER_DEGREE
    wide = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(F.least(F.abs("clat") + reach, F.lit(89.0)))), F.lit(0.02)))
    c = cities.select("name", "country", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    ys = F.sequence(F.floor(F.col("clat") - reach).cast("int"), F.floor(F.col("clat") + reach).cast("int"))
    xs = F.sequence(F.floor(F.col("clon") - wide).cast("int"), F.floor(F.col("clon") + wide).cast("int"))
    c = c.withColumn("y", F.explode(ys)).withColumn("x", F.explode(F.array_distinct(F.transform(xs, lambda x: F.pmod(x + 180, F.lit(360))))))
    p = points.withColumns({"y": F.floor("lat").cast("int"), "x": F.pmod(F.floor("lon").cast("int") + 180, F.lit(360))})
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    near = p.join(c, ["y", "x"]).withColumn("km", km).filter(F.col("km") <= max_km)
    best = near.groupBy("id").agg(F.min(F.struct("km", "name", "country")).alias("b"))
    return points.join(best.select("id", "b.*"), "id", "left")


def merged_piles(cells: DataFrame, merge_km: float = MERGE_KM) -> DataFrame:
    """(name, country, n, lat, lon): cells of the same place in piles. Cells are taken by size; one belongs to the earliest
    pile whose mean by then lies within merge_km, or starts one. Cells without a name stay as they are.

    Cells are sums over a grid, so a place within reach of one name has few; each place is one group.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n", "lat", "lon"], ascending=[False, True, True])
        cells = p[["n", "lat", "lon"]].to_numpy(float)
        sums, used = np.zeros((len(cells), 3)), 0  # rows, and latitudes and longitudes weighted by them
        for n, lat, lon in cells:
            means = sums[:used, 1:] / sums[:used, :1]
            within = np.flatnonzero(km_between(means[:, 0], means[:, 1], lat, lon) <= merge_km)
            at = within[0] if len(within) else used
            used = max(used, at + 1)
            sums[at] += n, n * lat, n * lon
        n = sums[:used, 0]
        return pd.DataFrame({"name": key[0], "country": key[1], "n": n.astype(np.int64), "lat": sums[:used, 1] / n, "lon": sums[:used, 2] / n})

    schema = "name string, country string, n long, lat double, lon double"
    named = cells.filter("name IS NOT NULL").select("name", "country", "n", "lat", "lon").groupBy("name", "country").applyInPandas(run, schema)
    rest = cells.filter("name IS NULL").select("name", "country", "n", "lat", "lon")
    return named.unionByName(rest).withColumns({"lat": F.bround("lat", 5), "lon": F.bround("lon", 5)})


def km_between(lat1: np.ndarray, lon1: np.ndarray, lat2: float, lon2: float) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))
