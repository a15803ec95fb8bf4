"""Whitening of embeddings onto their leading components, which LOBPCG finds.

Vectors become integers, floor(scale * c). The fit list holds each distinct integer vector once; its covariance is never
formed. A step of LOBPCG needs the covariance's product with a narrow block only: each partition centres its rows and sums up
rows' (rows block), the sums of partitions are added up in a few tasks, and d x block numbers reach the driver. There the
Rayleigh-Ritz method on the span of iterate, residuals and previous directions gives the next iterate; the basis of that span
is made orthonormal first, and its product is computed anew in every step, so that rounding does not pile up. The steps end
when each wanted component is certified: its residual |V q - e q| bounds the error of its eigenvalue, and that over the
distance to the other eigenvalues the angle to the true component. Where residuals are down to the rounding of the product
itself, nothing better can be had in double precision, and the steps end too. Then rows are projected in one map.

The block has a few more columns than components are wanted; it converges by the gap behind the last of them.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped; so are those whose length
is not the most frequent one (of equally frequent ones, the larger); repeated rows and equal vectors each get their rows, and
count once in the fit; null ids are passed through; with fewer dimensions than components there are as many components as
dimensions; a component without variance (under 1e-12 of the total, as with one distinct vector) has a null `whitened` and
takes no part in `identity_error`, which is null if no component has any; a deviation beyond a long is null; components of
equal variance are any basis of their space; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import stored, table

#: Units in 1.0 of a vector entry, components, further columns of the block, and tasks that add up partitions' sums.
SCALE, COMPONENTS, GUARD, ADDERS = 256, 4, 12, 8
#: Wanted: residuals over the largest eigenvalue, and the angle to the true component.
RESIDUAL, ANGLE = 1e-12, 1e-8
#: Steps after which an uncertified result is an error. A certified or rounding-bound one ends long before.
MOST_STEPS = 500
#: Numbers of a matrix that a task makes of its rows at once.
AT_ONCE = 4_000_000
#: Least share of the total variance that a component has to be whitened.
LEAST_SHARE = 1e-12


@dataclass
class Fit:
    """n, S and trace of the fit list; components as columns with their eigenvalues and residuals."""

    n: int
    sums: list[int]
    trace: float
    basis: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return means(self.sums, self.n)

    @property
    def sound(self) -> np.ndarray:
        return self.values > LEAST_SHARE * self.trace


def means(sums: list[int], n: int) -> np.ndarray:
    """S / n of exact integers, each rounded once."""
    return np.array([s / n for s in sums])


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.col("v")
    fit = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(v.isNotNull() & fit)
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = rows.select("vec_id", x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (sizes[0].d if sizes else 0))


def matrices(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Rows of a list column of d long entries each, a bounded number at once."""
    flat, step = column.flatten().to_numpy(), max(1, AT_ONCE // d)
    for a in range(0, len(column), step):
        yield flat[a * d : (a + step) * d].reshape(-1, d)


def added(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], adders: int = ADDERS) -> np.ndarray:
    """The sum of `of` over all rows' matrices: in each partition, then in a few tasks, of which the driver adds up what is left."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in matrices(batch.column(0), d):
                part = of(m)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                part = row.values.to_numpy()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select("x").mapInArrow(first, "sums array<double>")
    parts = parts.repartition(adders).mapInArrow(then, "sums array<double>")
    return sum(np.array(r.sums) for r in parts.collect())


def product(rows: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """block -> V block, by one pass over the rows."""

    def times(block: np.ndarray) -> np.ndarray:
        def of(m: np.ndarray) -> np.ndarray:
            z = m - mean
            return z.T @ (z @ block)

        return added(rows, len(mean), of).reshape(block.shape) / n

    return times


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's span outside `against`; directions that are nothing but rounding are left out."""
    sizes = np.sqrt((block * block).sum(axis=0))
    block = block[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    return block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, guard: int = GUARD, seed: int = 5, most: int = MOST_STEPS):
    """The k largest eigenvalues and eigenvectors of a symmetric matrix that only `times` knows; residuals and steps."""
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    rest, before = None, []
    for step in range(1, most + 1):
        span = x if rest is None else np.hstack([x, orthonormal(rest, x)])
        product_ = times(span)
        small = span.T @ product_
        e, c = np.linalg.eigh((small + small.T) / 2)
        e, c = e[::-1][:m], c[:, ::-1][:, :m]
        after, image = span @ c, product_ @ c
        r = image - after * e
        norms = np.sqrt((r * r).sum(axis=0))
        top = max(abs(e[0]), np.finfo(float).tiny)
        gaps = np.array([min((abs(e[i] - e[j]) for j in range(m) if j != i), default=top) for i in range(k)])
        before.append(norms[:k].max() / top)
        close = (norms[:k] <= ANGLE * (gaps - norms[:k])).all()
        # Equal eigenvalues have no angle to certify: then residuals go down until rounding stops them.
        stuck = len(before) > 3 and min(before[-3:]) > 0.5 * min(before[:-3])
        if span.shape[1] == d or (before[-1] <= RESIDUAL and (close or stuck)):
            return e[:k], after[:, :k], norms[:k], step
        p = span[:, m:] @ c[m:] if rest is not None else None
        x = np.linalg.qr(after)[0]
        rest = r if p is None else np.hstack([r, p])
    raise RuntimeError(f"residuals of {norms[:k].max():.3g} are not certified after {most} steps")


def fitted(rows: DataFrame, k: int = COMPONENTS, guard: int = GUARD) -> Fit | None:
    """Components of a fit list (x); None if it is empty."""
    sums = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    if not sums:
        return None
    n, totals = sums[0].n, [int(r.s) for r in sums]
    d, mean = len(totals), means(totals, n)
    trace = float(added(rows, d, lambda m: ((m - mean) ** 2).sum(axis=0)).sum() / n)
    k = min(k, d)
    if trace == 0:
        return Fit(n, totals, 0.0, np.eye(d)[:, :k], np.zeros(k), np.zeros(k), 0)
    e, q, residuals, steps = lobpcg(product(rows, mean, n), d, k, guard=guard)
    return Fit(n, totals, trace, q, np.maximum(e, 0), residuals, steps)


def spread(rows: DataFrame, fit: Fit) -> float | None:
    """The largest absolute entry of the covariance of what is whitened, over the fit list, minus the identity."""
    if not fit.sound.any():
        return None
    mean, to = fit.mean, fit.basis[:, fit.sound] / np.sqrt(fit.values[fit.sound])

    def of(m: np.ndarray) -> np.ndarray:
        w = (m - mean) @ to
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w

    k = to.shape[1]
    total = added(rows, len(mean), of).reshape(k + 1, k + 1) / fit.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def deviations(m: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Of each row, the sum of (n x - S)^2 as an exact integer; None beyond a long."""
    far = n * max(int(m.max()), -int(m.min())) + max(abs(s) for s in sums)
    if len(sums) * far * far < 1 << 63:
        return ((n * m - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in m.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"


def whitened(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """A row for each vector that takes part and each component; `eigenvalue` and `residual` are the component's."""
    own = integers(vectors, vec_id, vector, scale)
    kind = own.schema["vec_id"].dataType.simpleString()
    rows = stored(own.select("x").distinct(), "whitening-fit")
    fit = fitted(rows, components, guard)
    if fit is None:
        return own.select("vec_id").filter("false").selectExpr("vec_id", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in OUT.split(", ")])
    error = spread(rows, fit)
    k, d = len(fit.values), len(fit.sums)
    to = np.where(fit.sound, fit.basis / np.sqrt(np.where(fit.sound, fit.values, 1.0)), 0.0)
    lost = np.flatnonzero(~fit.sound)
    mean, share = fit.mean, fit.values / fit.trace if fit.trace else fit.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for m in matrices(batch.column(1), d):
                w, rows = (m - mean) @ to, len(m)
                ids = batch.column(0).slice(at, rows).take(np.repeat(np.arange(rows), k))
                at += rows
                empty = np.isin(np.tile(np.arange(k), rows), lost)
                deviation = pa.array(deviations(m, fit.sums, fit.n), pa.int64()).take(np.repeat(np.arange(rows), k))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n)), deviation,
                    pa.array(w.ravel(), mask=empty), pa.array(np.tile(share, rows)), pa.array([error] * (rows * k), pa.float64()),
                    pa.array(np.tile(fit.values, rows)), pa.array(np.tile(fit.residuals, rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *[c.split()[0] for c in OUT.split(", ")]])

    return own.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, {OUT}")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
