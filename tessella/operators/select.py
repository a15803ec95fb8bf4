"""Selection under quotas and coverage."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Shelf:
    """Rows of a pick as arrays: numbered variants and angles, their places by score, and what has been taken of each."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        self.ids, self.free = rows["id"].to_numpy(), np.ones(len(rows), bool)
        self.variant, names = pd.factorize(rows["variant"], sort=True)
        self.angle, _ = pd.factorize(rows["angle"], sort=True, use_na_sentinel=False)  # an unknown angle is the last
        size = rows.groupby(self.variant)["size"].first() if "size" in rows else pd.Series(self.variant).value_counts().sort_index()
        self.by_size = np.lexsort((np.arange(len(names)), -size.to_numpy()))
        self.taken = {"variant": np.zeros(len(names), int), "angle": np.zeros(self.angle.max(initial=-1) + 1, int)}

    def take(self, fits: np.ndarray, spread: str) -> int | None:
        """The free row among those that fit whose `spread` has been taken least, then the best one."""
        at = np.flatnonzero(fits & self.free)
        if not len(at):
            return None
        load = self.taken[spread][getattr(self, spread)[at]]
        best = at[np.argmin(load)]  # the first of the least, and rows are in order of score
        self.free[best] = False
        for name, counts in self.taken.items():
            counts[getattr(self, name)[best]] += 1
        return int(self.ids[best])

    def wishes(self) -> Iterator[int | None]:
        """Picks without end: every variant, every angle that those left out, then the variants in rounds."""
        for v in self.by_size:
            yield self.take(self.variant == v, "angle")
        for a in np.flatnonzero(self.taken["angle"] == 0):
            yield self.take(self.angle == a, "variant")
        while self.free.any():
            open_ = [v for v in self.by_size if self.free[self.variant == v].any()]
            yield self.take(self.variant == min(open_, key=self.taken["variant"].__getitem__), "angle")


def coverage_pick(rows: pd.DataFrame, n: int) -> list[int]:
    """Up to n ids of (id, variant, angle, score): every variant first, the largest first, then every angle, then the
    variants with fewest picks; larger scores first, ties to the smaller id. Where rows are left out, `size` has their
    variants' sizes."""
    return list(islice((x for x in Shelf(rows).wishes() if x is not None), max(n, 0))) if len(rows) else []


def pick_each(df: DataFrame, n: int) -> DataFrame:
    """(product, id) of a coverage pick in each product.

    A pick of n needs of each variant and angle its n best rows only, so others go before the rows of a product meet. Variants
    are ordered by their sizes before that.
    """
    best = F.row_number().over(Window.partitionBy("product", "variant", "angle").orderBy(F.desc("score"), "id"))
    counted = df.withColumn("size", F.count("*").over(Window.partitionBy("product", "variant")))
    rows = counted.withColumn("_r", best).filter(F.col("_r") <= n)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"product": p["product"].iat[0], "id": coverage_pick(p, n)})

    return rows.select("product", "id", "variant", "angle", "score", "size").groupBy("product").applyInPandas(run, "product string, id long")


def swap_ring(df: DataFrame, group: str, *order) -> DataFrame:
    """next_id: the row after each in its group's order, the first after the last."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("next_id", F.coalesce(F.lead("id").over(w), first))
