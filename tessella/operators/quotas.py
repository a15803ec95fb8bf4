"""Totals dealt out by weight, shop by shop, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.sequence import numbered
from tessella.sources.shared import stored


def apportioned(products: DataFrame, totals: DataFrame) -> DataFrame:
    """(shop, product, picks) of products (shop, product, weight, cap) and totals (shop, total): in proportion to weights, by largest
    remainder, and never more than a cap; what a cap turns away is dealt out again among the others.

    A round gives every product the whole part of its share, as far as its cap allows, and the rest one by one by remainder, ties
    to the smaller product. Shares are fractions of whole numbers, so nothing is rounded. All shops take their round at once;
    a shop is done when nothing is left or nobody has room. Sums of a shop are aggregated on the map side, and places by remainder
    are numbered range by range, so no shop's products meet in one task. Weights and caps that are null or negative count as 0, and
    so does the total of a shop that has none.
    """
    whole = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    left = totals.groupBy("shop").agg(F.max(whole("total")).alias("left")).filter("left > 0")
    now = products.select("shop", "product", whole("weight").alias("w"), whole("cap").alias("room"), F.lit(0).cast("long").alias("picks"))
    done = []
    now, left = stored(now, "quota-products"), stored(left, "quota-left")
    while True:
        open_ = (F.col("w") > 0) & (F.col("room") > 0)
        sums = now.filter(open_).groupBy("shop").agg(F.sum("w").alias("of_all"))
        at = left.join(sums, "shop")
        if at.isEmpty():
            break
        # Products of shops that are done go out of the rounds as they are.
        rows = stored(now.join(at, "shop", "left"), "quota-round")
        done.append(rows.filter("left IS NULL").select("shop", "product", "picks"))
        rows = rows.filter("left IS NOT NULL")
        part = F.expr("(CAST(left AS DECIMAL(19,0)) * w) div of_all").cast("long")
        rows = rows.withColumn("give", F.when(open_, F.least(part, F.col("room"))).otherwise(F.lit(0).cast("long")))
        rows = rows.withColumn("less", -(F.col("left").cast("decimal(19,0)") * F.col("w") % F.col("of_all")))
        rows = stored(rows.select("shop", "product", "w", "room", "picks", "left", "give", "less"), "quota-shares")
        given = rows.groupBy("shop").agg(F.sum("give").alias("given"))
        more = numbered(rows.filter((F.col("w") > 0) & (F.col("room") > F.col("give"))).select("shop", "less", "product"), "shop", "less", "product", name="nth")
        more = stored(more, "quota-order")
        first = more.groupBy("shop").agg(F.min("nth").alias("first"))
        ones = more.join(first, "shop").select("shop", "product", (F.col("nth") - F.col("first")).alias("nth"))
        rows = rows.join(ones, ["shop", "product"], "left").join(given, "shop")
        one = F.coalesce(F.col("nth") < F.col("left") - F.col("given"), F.lit(False)).cast("long")
        gets = F.col("give") + one
        now = stored(rows.select("shop", "product", "w", (F.col("room") - gets).alias("room"), (F.col("picks") + gets).alias("picks"), gets.alias("gets")), "quota-products")
        spent = now.groupBy("shop").agg(F.sum("gets").alias("spent"))
        left = stored(left.join(spent, "shop").filter("spent > 0").select("shop", (F.col("left") - F.col("spent")).alias("left")).filter("left > 0"), "quota-left")
        now = now.drop("gets")
    out = now.select("shop", "product", "picks")
    for rows in done:
        out = out.unionByName(rows)
    return out
