"""Pictures grouped into products, variants and views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.cluster import average_linkage, cosine_linkage, within_links
from tessella.operators.vectors import with_similarities

PRODUCT, VARIANT, VIEW = 0.11, 21.0, 0.03
#: Cosine from which strays join their nearest product.
ATTACH = 0.8
#: Hues by name, as Lab.
COLOURS = {"red": (53, 80, 67), "green": (46, -52, 50), "blue": (32, 79, -108), "yellow": (97, -22, 94), "white": (100, 0, 0), "grey": (54, 0, 0), "black": (0, 0, 0)}


def colour_linkage(lab: np.ndarray, cut: float) -> np.ndarray:
    """Average linkage of colours: equal ones merge before all others, so a distinct colour stands for its rows."""
    own, of, n = np.unique(lab, axis=0, return_inverse=True, return_counts=True)
    found = average_linkage(np.linalg.norm(own[:, None] - own[None, :], axis=2), cut, n)[of.ravel()] if len(lab) else np.zeros(0, int)
    first = {g: i for i, g in reversed(list(enumerate(found)))}
    order = {g: k for k, g in enumerate(sorted(first, key=lambda g: (-(found == g).sum(), first[g])))}
    return np.array([order[g] for g in found], int)


def group(vectors: np.ndarray, colours: list) -> list[tuple[int, int, int]]:
    """(product, variant, view) of each row, -1 for a row without a product: average linkage of cosine distance, then of
    colour inside a product (rows without a colour are a variant of their own), then of cosine distance inside a variant."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    product = cosine_linkage(unit, PRODUCT)
    out = [(-1, -1, -1)] * len(unit)
    for p in range(product.max() + 1 if len(product) else 0):
        rows = np.flatnonzero(product == p)
        if len(rows) < 2:
            continue
        seen = [i for i in rows if colours[i] is not None]
        lab = np.array([colours[i] for i in seen], float).reshape(-1, 3)
        variant = dict(zip(seen, colour_linkage(lab, VARIANT).tolist(), strict=True))
        blank = max(variant.values(), default=-1) + 1
        for v in range(blank + 1):
            own = np.array([i for i in rows if variant.get(i, blank) == v], int)
            if len(own):
                for i, view in zip(own, cosine_linkage(unit[own], VIEW), strict=True):
                    out[i] = (int(p), int(v), int(view))
    return out


def colour_name(lab) -> str:
    return min(COLOURS, key=lambda c: sum((a - b) ** 2 for a, b in zip(COLOURS[c], lab, strict=True)))


def find(items: DataFrame, shoot: str = "shoot") -> DataFrame:
    """(shoot, id, product, variant, view) of items (shoot, id, vector, colour) with a product, by shoot. Products never reach
    across components of the pairs within PRODUCT, so each component is looked at on its own."""

    def work(m: np.ndarray, colours: list) -> list[tuple[int, int, int, int]]:
        return [(at, *found) for at, found in enumerate(group(m, colours)) if found[0] >= 0] if len(m) > 1 else []

    return within_links(items.select(shoot, "id", "vector", "colour"), shoot, 1 - PRODUCT - 1e-9, work, "product", "variant int, view int")


def attached(strays: DataFrame, home: DataFrame, least: float = ATTACH) -> DataFrame:
    """(bunch, product, score) of strays (bunch, vector), which move by the bunch: the product whose frames (product, vector) its
    own are nearest to, by the mean of each one's largest cosine; ties to the smaller product, null if below `least`. Frames
    without a vector don't count, and a bunch of such frames only has no row. `home` is small, and checked to be so."""
    sims, found = with_similarities(strays.select("bunch", "vector"), home, "product")
    means = sims.select("bunch", F.posexplode("sims").alias("i", "s")).groupBy("bunch", "i").agg(F.avg("s").alias("score"))
    best = means.groupBy("bunch").agg(F.max(F.struct("score", (-F.col("i")).alias("i"))).alias("b"))
    product = F.get(F.array(*[F.lit(p) for (p,) in found]), -F.col("b.i")) if found else F.lit(None)
    return best.select("bunch", F.when(F.col("b.score") >= least, product).alias("product"), F.col("b.score").alias("score"))
