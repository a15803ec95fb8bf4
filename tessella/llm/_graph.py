"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import stored


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b) that is not a root; root is the component's smallest vertex.

    Alternates large-star and small-star steps, which keep at most a row for each edge, until nothing changes. Minima are
    aggregated, so no vertex's neighbours are gathered in one place. Each round is written to the shared folder.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    was = e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("root").alias("v"), F.col("v").alias("root")))
        low = both.groupBy("v").agg(F.least(F.min("root"), F.first("v")).alias("m"))
        large = both.join(low, "v").filter(F.col("root") > F.col("v")).select(F.col("root").alias("v"), F.col("m").alias("root"))
        # Edges now point from the larger to a smaller vertex; each vertex hands its smallest on to its others.
        large = large.filter("v <> root").distinct()
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).unionByName(low.select("v", F.col("m").alias("root")))
        before, e = e, stored(small.filter("v <> root").distinct(), "edges")
        n = e.count()
        # Both are sets: of equal size, one inside the other, they are the same.
        if n == was and e.join(before, ["v", "root"], "left_anti").isEmpty():
            return e
        was = n
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
