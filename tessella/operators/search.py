"""Ranking and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import filters
from tessella.operators.sequence import numbered


def order_of(sort: str = "oldest") -> list[Column]:
    """Total orders; ties go by path, and newest turns that round too."""
    when = F.coalesce("taken_at", F.lit(""))
    return {
        "oldest": [when.asc(), F.col("rel").asc()],
        "newest": [when.desc(), F.col("rel").desc()],
        "biggest": [F.coalesce("size", F.lit(0)).desc(), F.col("rel").asc()],
        "smallest": [F.coalesce("size", F.lit(0)).asc(), F.col("rel").asc()],
        "name": [F.lower("rel").asc(), F.col("rel").asc()],
        "longest": [F.coalesce("duration", F.lit(0.0)).desc(), F.col("rel").asc()],
    }[sort]


def sharp_percentile(items: DataFrame) -> DataFrame:
    """sharp_pct: rank by sharpness (ties by id) as a percentage. Ranks are numbered range by range, in no single task."""
    rows = numbered(items.withColumn("_s", F.coalesce("sharp", F.lit(0.0))), "_s", "id", name="_rank", total="_rows")
    return rows.withColumn("sharp_pct", F.col("_rank") / F.greatest(F.col("_rows") - 1, F.lit(1)) * 100).drop("_s", "_rank", "_rows")


def ranked(items: DataFrame, f: filters.Filters, sort: str = "oldest", score: Column | None = None) -> tuple[DataFrame, list[Column]]:
    """(rows, order): filtered rows with their confidence, and the order that they are shown in: sure ones by the sort (or
    score), then the others by confidence."""
    rows = filters.with_confidence(filters.apply(items, f), f)
    base = [F.col("score").desc(), F.col("id").asc()] if score is not None else order_of(sort)
    if score is not None:
        rows = rows.withColumn("score", score)
    return rows, [F.col("sure").desc(), F.when(F.col("sure"), 0.0).otherwise(-F.col("confidence")).asc(), *base]


def page(items: DataFrame, f: filters.Filters, *, sort: str = "oldest", score: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the ranked rows, as a top-k (no full sort), with `pos` from 0."""
    rows, order = ranked(items, f, sort, score)
    top = rows.orderBy(*order).limit(limit + offset)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("pos") >= offset)
