"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of a text (lengths, shares of character classes, repetition) are scaled and mapped to random Fourier features,
which approximate a Gaussian kernel. Each partition sums up its normal equations; their total is solved for ridge
weights. A fifth of the training rows is kept from that fit: their ridge scores, as a histogram, are fitted by isotonic
regression, which turns scores into shares of label 1. Scoring is a map over Arrow batches without a shuffle.

The fit takes at most MAX_ROWS labelled rows (chosen by a hash of the id), in FIT_PARTITIONS partitions, so what reaches
the driver is bounded by these parameters. Every text is scored, whole.

Defined results: null and empty texts are scored as empty; labels that are null or contradict each other for an id are
left out; repeated rows get the same score each; with no labels, or labels of one kind only, the score is that share
(0.5 with none) for all; other columns are passed through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import stored, table, values, words_of

#: Most labelled rows that a fit takes, and their partitions.
MAX_ROWS, FIT_PARTITIONS = 200_000, 16
#: Labelled ids that may be broadcast (12 bytes each); with a larger max_rows they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Random features, ridge penalty for each row, and the seed of the features.
FEATURES, PENALTY, SEED = 384, 1e-4, 11
#: Buckets of ridge scores for calibration; scores run from about -0.5 to 1.5.
BUCKETS = 1000


def classes() -> np.ndarray:
    """Byte classes, as rows of a 0/1 matrix: upper, lower, digit, blank, full stop and comma, other ASCII marks, beyond ASCII."""
    c = np.arange(256)
    upper, lower, digit = (c >= 65) & (c <= 90), (c >= 97) & (c <= 122), (c >= 48) & (c <= 57)
    blank, plain, high = np.isin(c, [9, 10, 13, 32]), np.isin(c, [44, 46]), c >= 128
    marks = ~(upper | lower | digit | blank | plain | high)
    return np.array([upper, lower, digit, blank, plain, marks, high], np.float64)


CLASSES = classes()


def share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(raw: bytes | None) -> list[float]:
    """Numbers that describe a text's shape, none of which depends on its language."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digit, blank, plain, marks, high = (CLASSES @ counts).tolist()
    p = counts[counts > 0] / max(n, 1)
    words = words_of(raw)
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    seen = Counter(words)
    pairs = len({*zip(words, words[1:], strict=False)})
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    w = len(words)
    return [
        np.log1p(n), np.log1p(w), sizes.mean() if w else 0.0, sizes.std() if w else 0.0, sizes.max() if w else 0.0,
        share(upper, upper + lower), share(digit, n), share(blank, n), share(plain, n), share(marks, n), share(high, n),
        float(-(p * np.log2(p)).sum()), share(np.log1p(len(seen)), np.log1p(w)), share(max(seen.values(), default=0), w),
        share(pairs, max(w - 1, 1)), share(int((sizes <= 3).sum()), w), share(len({*lines}), len(lines)),
        np.log1p(line_sizes.mean()) if len(lines) else 0.0, np.log1p(len(lines)),
        share(sum(x.rstrip()[-1:] in (b".", b"?") for x in lines), len(lines)), share(int(counts[124]), w), share(int(counts[33]), w),
        share(raw.count(b". "), w), share(marks, w),
    ]


@dataclass
class Model:
    """Scaling, random features, ridge weights and calibration; weights of None stand for a constant score."""

    constant: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    waves: np.ndarray | None = None
    phases: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[list[float], list[float]] = field(default_factory=lambda: ([0.0, 1.0], [0.0, 1.0]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.hstack([out, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.ridge(x), *self.steps), 0, 1)


def pooled(at: list[float], shares: list[float], counts: list[float]) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling adjacent violators; each pool stands at its mean place."""
    pools: list[list[float]] = []
    for x, y, n in zip(at, shares, counts, strict=True):
        pools.append([x, y, n])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            n = a[2] + b[2]
            pools.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
    return [p[0] for p in pools], [p[1] for p in pools]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns in a struct `row`, and the statistics of the text in `x`."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("raw"))
    schema = packed.select("row", F.lit(None).cast("array<double>").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(raw) for raw in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["row", "x"])

    return packed.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(x, y, kept): statistics, label, and whether the row is kept for calibration, of at most about max_rows ids."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("doc_id", "y")
    )
    n = known.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if n > max_rows:
        known = known.filter(order < int((1 << 30) * max_rows / n))
    # max_rows bounds what is broadcast; only rows with a label are measured, whose texts no shuffle then moves.
    known = known.filter(F.col("doc_id").isNotNull())
    known = F.broadcast(known) if max_rows <= BROADCAST_ROWS else known
    own = docs.select("doc_id", "text").join(known, "doc_id")
    rows = measured(own).select("row.doc_id", "row.y", "x")
    return rows.select("x", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).alias("kept"))


def summed(rows: DataFrame, of) -> list[np.ndarray]:
    """For each of the arrays that `of(x, y)` gives for a batch, its sum over all rows: summed up in each partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(matrix(batch.column(0)), batch.column(1).to_numpy())
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.ravel().tolist() for a in total]], pa.list_(pa.list_(pa.float64())))], names=["sums"])

    parts = [r.sums for r in rows.select("x", "y").mapInArrow(run, "sums array<array<double>>").collect()]
    return [sum(np.array(p[i]) for p in parts) for i in range(len(parts[0]))] if parts else []


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, features: int = FEATURES, seed: int = SEED) -> Model:
    """Learn from rows of labels whose remainder is not 1."""
    rows = stored(training_rows(docs, labels, max_rows).repartition(FIT_PARTITIONS), "training-rows")
    basic = summed(rows, lambda x, y: [np.array([len(x), y.sum()]), x.sum(axis=0), (x * x).sum(axis=0)])
    if not basic:
        return Model()
    (n, ones), mean = basic[0], basic[1] / basic[0][0]
    if ones in (0, n):
        return Model(constant=float(ones / n))
    rng = np.random.default_rng(seed)
    d = len(mean)
    model = Model(
        mean=mean, scale=np.sqrt(np.maximum(basic[2] / n - mean * mean, 0)) + 1e-6,
        waves=rng.normal(0, 1 / np.sqrt(d), (d, features)), phases=rng.uniform(0, 2 * np.pi, features),
    )

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.expand(x)
        return [z.T @ z, z.T @ y]

    gram, right = summed(rows.filter("NOT kept"), equations)
    gram = gram.reshape(features + 1, features + 1) + PENALTY * n * np.diag([1.0] * features + [0.0])
    model.weights = np.linalg.solve(gram, right)

    def histogram(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        at = np.clip(np.rint((model.ridge(x) + 0.5) * BUCKETS / 2), 0, BUCKETS).astype(int)
        return [np.bincount(at, minlength=BUCKETS + 1).astype(float), np.bincount(at, y, minlength=BUCKETS + 1)]

    if kept := summed(rows.filter("kept"), histogram):
        at = np.flatnonzero(kept[0])
        places, shares = pooled((at * 2 / BUCKETS - 0.5).tolist(), (kept[1][at] / kept[0][at]).tolist(), kept[0][at].tolist())
        model.steps = (places, shares)
    return model


def scored(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs' columns in a struct `row`, and the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("raw"))
    schema = packed.select("row", F.lit(None).cast("double").alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(raw) for raw in values(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["row", "score"])

    return packed.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("row.doc_id")) == 1, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
