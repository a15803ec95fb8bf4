"""Similarity, prompts and centroids over vector columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.functions.scalars import band_floor, dot

#: Rows of a reference or prompt table that may be broadcast; beyond it, join in blocks.
SMALL_ROWS = 20_000


def checked_width(df: DataFrame, vector: str, d: int) -> DataFrame:
    """Vectors of another width count as absent."""
    return df.withColumn(vector, F.when(F.size(vector) == d, F.col(vector)))


def top_k(df: DataFrame, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows with the largest dot product; rows without a vector score -1. A top-k, so nothing is sorted whole."""
    score = F.coalesce(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), F.lit(-1.0))
    return df.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def small(df: DataFrame) -> DataFrame:
    """A table for broadcast, if its size allows."""
    n = df.count()
    if n > SMALL_ROWS:
        raise ValueError(f"{n} rows are too many to compare with every row; at most {SMALL_ROWS}: take them in blocks")
    return F.broadcast(df)


#: Similarities that are worked out at once.
CELLS_AT_ONCE = 2_000_000


def with_similarities(df: DataFrame, others: DataFrame, *keys: str) -> tuple[DataFrame, list]:
    """df with `sims`, the largest dot product of its column `vector` with those of each group of `others` (keys, vector), and
    the groups' keys in that order. `others` is small, and checked to be so: it reaches the tasks as one matrix, so rows
    are neither multiplied nor shuffled. Null where a vector is null, has a null in it or another width."""
    rows = others.filter("vector IS NOT NULL").select(*keys, F.col("vector").cast("array<double>").alias("vector")).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} rows are too many to compare with every row: take them in blocks")
    rows = sorted(rows, key=lambda r: tuple((r[k] is not None, r[k]) for k in keys))
    groups = list(dict.fromkeys(tuple(r[k] for k in keys) for r in rows))
    place = {g: i for i, g in enumerate(groups)}
    starts = np.searchsorted([place[tuple(r[k] for k in keys)] for r in rows], np.arange(len(groups)))
    matrix = np.array([r.vector for r in rows], np.float64)
    out = T.StructType([*df.schema.fields, T.StructField("sims", T.ArrayType(T.DoubleType()))])
    if not rows:
        return df.withColumn("sims", F.array().cast("array<double>")), []
    return df.mapInArrow(similarities(df.columns.index("vector"), matrix, starts), out), groups


def similarities(at: int, matrix: np.ndarray, starts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a column of the largest products of the vectors in column `at` with each run of the matrix's rows."""
    d, step = matrix.shape[1], max(1, CELLS_AT_ONCE // len(matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), step):
                batch = whole.slice(a, step)
                column = batch.column(at)
                fits = pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False)
                v = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                best = np.maximum.reduceat(v @ matrix.T, starts, axis=1)
                known = np.flatnonzero(fits)[~np.isnan(best).any(axis=1)]
                best = best[~np.isnan(best).any(axis=1)]
                sizes = np.zeros(len(batch), np.int64)
                sizes[known] = len(starts)
                null = np.ones(len(batch), bool)
                null[known] = False
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                sims = pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*batch.columns, sims], names=[*batch.schema.names, "sims"])

    return run


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, centroid): means of the vectors scaled to unit length, summed up by position on the map side."""
    parts = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(label)))
    unit = parts.withColumn("x", F.col("x") / F.greatest(norm, F.lit(1e-12)))
    made = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return unit.groupBy(label).agg(F.max("n").alias("n"), made.alias("centroid"))


def match_references(faces: DataFrame, refs: DataFrame, min_sim: float, unsure_band: bool = False) -> DataFrame:
    """(name, photo_id, similarity, sure): of each named reference the best face of each photo, at the threshold or in the
    band below it. The references are few and checked to be so; only matches become rows."""
    floor = band_floor(min_sim) if unsure_band else min_sim
    sims, names = with_similarities(faces.select("photo_id", "vector"), refs, "name")
    found = F.filter(F.transform("sims", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"] >= floor)
    rows = sims.select("photo_id", F.explode(found).alias("m")).groupBy("photo_id", "m.i").agg(F.max("m.s").alias("similarity"))
    name = F.get(F.array(*[F.lit(n) for (n,) in names]).cast("array<string>"), F.col("i"))
    return rows.select(name.alias("name"), "photo_id", "similarity", (F.col("similarity") >= min_sim).alias("sure"))


def best_per_photo(faces: DataFrame, query: list[float], min_sim: float) -> DataFrame:
    """(photo_id, face_id, similarity) of the best face of each photo at the threshold."""
    sim = dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    rows = faces.withColumn("similarity", sim).filter(F.col("similarity") >= min_sim)
    best = F.max(F.struct("similarity", (-F.col("face_id")).alias("face_id"))).alias("b")
    return rows.groupBy("photo_id").agg(best).select("photo_id", (-F.col("b.face_id")).alias("face_id"), F.col("b.similarity").alias("similarity"))


def zero_shot(
    df: DataFrame, prompts: DataFrame, *, temperature: float = 117.33, min_prob: float = 0.35, margin: float = 0.15, min_cosine: float = 0.02,
    family: Column | None = None, second: float = 0.15,
) -> DataFrame:
    """category, guess, p_best, margin and `cleared` of each row with id and vector.

    prompts: (owner, family, vector), owner `__other__` standing for none; few rows, checked. A category's cosine is the
    largest over its prompts; a softmax over the categories gives probabilities; the best counts only if its probability,
    its lead over the best of another family and its cosine all clear their gates. A row without a vector is `other`.
    """
    sims, groups = with_similarities(df.select("id", "vector"), prompts, "owner", "family")
    owners, families = (F.array(*[F.lit(g[i]) for g in groups]) for i in (0, 1))
    each = F.transform("sims", lambda x, i: F.struct((-x).alias("neg"), F.get(owners, i).alias("owner"), F.get(families, i).alias("family")))
    lists = sims.select("id", F.array_sort(each).alias("s"))
    top = F.col("s")[0]
    exp = F.transform("s", lambda x: F.exp(-(x["neg"] - top["neg"]) * temperature))
    lists = lists.withColumn("e", exp).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    lists = lists.withColumn("p", F.transform("e", lambda x: x / F.col("z")))
    rows = F.arrays_zip("s", "p")
    other = F.filter(rows, lambda x: x["s"]["family"] != top["family"])
    p2 = F.coalesce(F.get(other, F.lit(0))["p"], F.get(F.col("p"), F.lit(1)), F.lit(0.0))
    real = F.filter(rows, lambda x: x["s"]["owner"] != "__other__")
    cleared = F.transform(F.filter(real, lambda x: (x["p"] >= second) & (-x["s"]["neg"] >= min_cosine)), lambda x: x["s"]["owner"])
    lead = F.col("p")[0] - p2
    passes = (top["owner"] != "__other__") & (-top["neg"] >= min_cosine) & (F.col("p")[0] >= min_prob) & (lead >= margin)
    return lists.select(
        "id", F.when(passes, top["owner"]).otherwise("other").alias("category"), F.get(real, F.lit(0))["s"]["owner"].alias("guess"),
        F.col("p")[0].alias("p_best"), lead.alias("margin"), F.array_sort(cleared).alias("cleared"),
    )


def suggest_pairs(groups: DataFrame, min_sim: float, least: int = 3, limit: int = 50, different: DataFrame | None = None) -> DataFrame:
    """Pairs of groups (id, n, centroid) that may be the same: similarity at the threshold, one group of `least` or more,
    no decision that they differ; ranked by similarity and size. Group centroids are few, and checked to be so."""
    a = groups.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("centroid").alias("_a"))
    b = small(groups.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("centroid").alias("_b")))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("similarity", dot(F.col("_a"), F.col("_b")))
    pairs = pairs.filter((F.col("similarity") >= min_sim) & (F.greatest("n_a", "n_b") >= least))
    if different is not None:
        pairs = pairs.join(different.select("a", "b"), ["a", "b"], "left_anti")
    rank = F.col("similarity") * (1 + F.log10(F.greatest(F.least("n_a", "n_b"), F.lit(1))))
    return pairs.select("a", "b", "n_a", "n_b", "similarity", rank.alias("rank")).orderBy(F.desc("rank"), "a", "b").limit(limit)


def aerial_gap(df: DataFrame, aerial: DataFrame, ground: DataFrame) -> DataFrame:
    """(id, gap): largest cosine with aerial prompts minus that with ground prompts; null without prompts of both."""
    both = aerial.select(F.lit(1).alias("up"), "vector").unionByName(ground.select(F.lit(0).alias("up"), "vector"))
    sims, _ = with_similarities(df.select("id", "vector"), both, "up")
    return sims.select("id", (F.get("sims", F.lit(1)) - F.get("sims", F.lit(0))).alias("gap"))


def best_words(groups: DataFrame, words: DataFrame, least: float = 0.05, lead: float = 0.01) -> DataFrame:
    """(id, word) of groups (id, vector): the word (word, vector) of the largest cosine, if that is `least` or more and leads the
    next word's by `lead`; else null. A single word has nothing to lead."""
    sims, found = with_similarities(groups.select("id", "vector"), words, "word")
    ranked = F.array_sort(F.transform("sims", lambda s, i: F.struct((-s).alias("neg"), i.alias("i"))))
    first, second = (F.get(ranked, F.lit(k)) for k in (0, 1))
    clear = (-first["neg"] >= least) & (F.coalesce(second["neg"] - first["neg"], F.lit(float("inf"))) >= lead)
    word = F.get(F.array(*[F.lit(w) for (w,) in found]).cast("array<string>"), first["i"])
    return sims.select("id", F.when(clear, word).alias("word"))


def nearest_group(groups: DataFrame, query: list[float], above: float = 0.5) -> DataFrame:
    """The group (id, similarity) whose centroid is nearest to a vector, if nearer than `above`; no row otherwise."""
    sim = dot(F.col("centroid"), F.array(*[F.lit(float(x)) for x in query]))
    return groups.select("id", sim.alias("similarity")).filter(F.col("similarity") > above).orderBy(F.desc("similarity"), "id").limit(1)


def moved_sums(models: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, n, total) of models (id, n, total: the sum of their vectors) after moves (old, new, vector): each vector is taken
    from the old model's sum and added to the new one's, either of which may be null. A model left without rows goes."""
    cells = lambda df, id_, n, v: df.select(F.col(id_).alias("id"), n.alias("n"), F.posexplode(v).alias("pos", "x"))
    wide = moves.select("old", "new", F.col("vector").cast("array<double>").alias("v"))
    one = F.lit(1).cast("long")
    all_ = cells(models, "id", F.col("n"), F.col("total")).unionByName(cells(wide, "old", -one, F.transform("v", lambda x: -x))).unionByName(cells(wide, "new", one, F.col("v")))
    parts = all_.filter("id IS NOT NULL").groupBy("id", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).filter("n > 0")
    total = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return parts.groupBy("id").agg(F.max("n").alias("n"), total.alias("total"))
