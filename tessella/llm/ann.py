"""Nearest neighbours by cosine as a block matrix join.

Queries and candidates are dealt into blocks of bounded size, and every pair of a query block with a candidate block is a
cell, worked out in one task of the cogrouped join: no table goes through the driver, and a lost cell is worked out anew by
itself. Both sides are unit vectors scaled to int8. A cell goes through tiles of candidates; their products of int8 values
(exact in the float type they are summed in) give cosines with a bound on what the rounding can have changed:
|u.w - s t (q.r)| <= s t (|q|_1 / 2 + |r|_1 / 2 + d / 4) for u = s (q + e), w = t (r + f), |e|, |f| <= 1/2.
A pair survives if its upper bound reaches the query's k-th best so far; survivors are recomputed in double precision
from the original vectors and merged into a heap of k for each query. Cells return their heaps; a row number over them
(which Spark limits on the map side too) gives the result. Nothing is lost: the bounds are proofs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
a null id; only vectors of equal length are compared; rows with the query's own id are its own; a query row that is
repeated is searched once for each; vectors of any norm are compared, as each is scaled by a power of two first; fewer
candidates than k give fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm._common import stored, table

#: Components in a block of queries and of candidates, candidates in a tile, queries against a tile at once.
QUERY_VALUES, BLOCK_VALUES, TILE, AT_ONCE = 2_000_000, 1_000_000, 2048, 1024
#: Components summed up in float32 at once: 127 * 127 * 1024 is under 2 ** 24, so their int8 products stay exact.
EXACT = 1024


class Quantised:
    """Unit vectors as int8 values with a scale, and the originals times a power of two, which changes no cosine."""

    def __init__(self, vectors: np.ndarray):
        _, power = np.frexp(np.abs(vectors).max(axis=1))
        self.raw = np.ldexp(vectors, -power[:, None])
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        unit = self.raw / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.l1 = np.abs(self.q.astype(np.int32)).sum(axis=1)

    def bounds(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of all pairs as int8 products give them, and how far they may be off."""
        d = self.q.shape[1]
        dots = np.zeros((len(self.q), len(other.q)))
        for a in range(0, d, EXACT):
            dots += self.q[:, a : a + EXACT].astype(np.float32) @ other.q[:, a : a + EXACT].astype(np.float32).T
        scales = self.scale[:, None] * other.scale[None, :]
        off = scales * (0.5 * self.l1[:, None] + 0.5 * other.l1[None, :] + 0.25 * d) + 1e-9
        return dots * scales, off

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.raw, out.norm, out.scale, out.q, out.l1 = self.raw[rows], self.norm[rows], self.scale[rows], self.q[rows], self.l1[rows]
        return out


def cosines(a: Quantised, i: np.ndarray, b: Quantised, j: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision; a bounded number at once."""
    step = max(1, 4_000_000 // a.raw.shape[1])
    parts = [(a.raw[i[s : s + step]] * b.raw[j[s : s + step]]).sum(axis=1) for s in range(0, len(i), step)]
    return np.concatenate(parts or [np.zeros(0)]) / (a.norm[i] * b.norm[j])


def search_tile(queries: Quantised, query_ids: np.ndarray, tile: Quantised, ids: np.ndarray, heaps: list[list], k: int) -> None:
    """Merge a tile's survivors into the queries' heaps of (score, -id)."""
    for at in range(0, len(query_ids), AT_ONCE):
        part = queries.part(slice(at, at + AT_ONCE))
        own = query_ids[at : at + AT_ONCE]
        about, off = part.bounds(tile)
        low = np.where(own[:, None] == ids[None, :], -np.inf, about - off)
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[at : at + AT_ONCE]])
        if len(ids) >= k:
            floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        i, j = np.nonzero((about + off >= floor[:, None]) & np.isfinite(low))
        s, c = cosines(part, i, tile, j), ids[j]
        # Of a query's survivors, which are many where vectors are alike, the best k alone can enter its heap.
        order = np.lexsort((c, -s, i))
        i, s, c = i[order], s[order], c[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        for q, c_, s_ in zip(i[best].tolist(), c[best].tolist(), s[best].tolist(), strict=True):
            h = heaps[at + q]
            if len(h) < k:
                heapq.heappush(h, (s_, -c_))
            elif (s_, -c_) > h[0]:
                heapq.heapreplace(h, (s_, -c_))


def sound(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, in double precision."""
    v = F.col("v")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fit)


def matrices(block: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) for each vector length of a block with columns row, id and v; `most` rows at once."""
    block = block.combine_chunks()
    lists = pa.concat_arrays(block.column("v").chunks) if block.num_rows else pa.array([], pa.list_(pa.float64()))
    starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    flat, ids, rows = lists.values.to_numpy(), block.column("id").to_numpy(), block.column("row").to_numpy()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        for a in range(0, len(at), most):
            some = at[a : a + most]
            yield rows[some], ids[some], flat[starts[some][:, None] + np.arange(d)]


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    query_values: int = QUERY_VALUES, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest candidates, ties to the smaller id."""
    asked = stored(sound(queries, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "queries")
    candidates = sound(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id())
    values = lambda t: t.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first().n
    n, m = (max(1, ceil(values(t) / most)) for t, most in ((asked, query_values), (candidates, block_values)))
    dealt = lambda t, own, blocks, other, others: t.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )
    left, right = dealt(asked, "i", n, "j", m), dealt(candidates, "j", m, "i", n)

    def run(cell: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for rows, query_ids, matrix in matrices(queries, 1 << 30):
            asked, heaps = Quantised(matrix), [[] for _ in rows]
            for _, ids, tile in matrices(block, TILE):
                if tile.shape[1] == matrix.shape[1]:
                    search_tile(asked, query_ids, Quantised(tile), ids, heaps, k)
            for row, q, h in zip(rows.tolist(), query_ids.tolist(), heaps, strict=True):
                for s, c in h:
                    for column, x in zip(out, (row, q, -c, s), strict=True):
                        column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["row", "query_id", "vec_id", "score"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
