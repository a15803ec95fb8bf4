"""N-gram Jaccard join by chosen paths.

Texts become sets of shingles of five words. Equal sets are one class from the start. Each set has a sketch of minwise
tokens; two sets share a token with the probability of their similarity. A run samples one token as a root: sets that
share it meet in a bucket. A bucket of more than LIMIT sets is split again on BRANCH tokens sampled by its path, level
by level; small buckets are compared pair by pair on their sketches. A bucket whose sets are alike on average (two share
a token with a probability of DENSE) would not come apart: it is compared at once, in a grid of blocks, as is what is
still large after DEPTH levels. Runs are repeated until a pair at the threshold is missed with a probability of at most
1 - RECALL.

Candidates only have to connect: a bucket gives one row for each of its sets. Their connected components are then
compared exactly, on the full shingle sets and each pair once, in a grid of blocks of bounded size; so the links counted
are exact, pairs never become rows, and no group is gathered in one task.

Defined results: a text of one to four words is one shingle; texts without words (and nulls) are linked to nothing and
are classes of their own; rows with equal shingle sets are copies of each other and share a class and its links; the
class id is the smallest document id in the class (null if it has none); other columns are passed through or left out;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import portions, row_key, stored, table, values, words_of
from tessella.llm._graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 1 - 1e-6
#: Sets in a bucket that is compared pair by pair, tokens that a larger one is split on, and levels of splits.
LIMIT, BRANCH, DEPTH = 256, 2, 4
#: Average similarity from which a bucket is not split, and the sets in a block of the grid that it is compared in.
DENSE, GRID_SETS = 0.5, 1024
#: Tokens of a sketch.
TOKENS = 64
#: Sets and shingles of a block of the exact grid.
BLOCK_SETS, BLOCK_SHINGLES = 384, 400_000
#: Keys that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
PAIRS_AT_ONCE = 200_000

rng = np.random.default_rng(5)
MULTIPLY = (rng.integers(1, 1 << 32, 512, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = rng.integers(0, 1 << 32, 512, dtype=np.uint64).astype(np.uint32)


def runs_for(threshold: float, recall: float, branch: int = BRANCH) -> int:
    """Runs after which a pair at the threshold is missed with a probability of at most 1 - recall.

    A pair survives a split if it shares one of its tokens and survives below; the worst depth is taken.
    """
    return ceil(log(1 - recall) / log(missed_by_run(threshold, branch)))


def missed_by_run(threshold: float, branch: int = BRANCH) -> float:
    missed = 0.0
    for _ in range(DEPTH):
        missed = (1 - threshold * (1 - missed)) ** branch
    return 1 - threshold * (1 - missed)


def slack(threshold: float, recall: float = RECALL) -> float:
    """How far an estimate may fall below the threshold. All runs use one sketch, so it has what the paths leave of
    1 - recall: the exact tail of the binomial count of tokens that agree, one byte in 256 of them by chance."""
    left, p = 1 - recall - missed_by_run(threshold) ** runs_for(threshold, recall), threshold + (1 - threshold) / 256
    tail, k = 0.0, 0
    while k < TOKENS and (tail := tail + comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k)) <= left:
        k += 1
    return threshold - k / TOKENS + 1e-9


def shingles(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(raw)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for j in range(min(size, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(tokens: np.ndarray, runs: int) -> tuple[np.ndarray, bytes]:
    """Root tokens, one for each run, and a byte of each of the other minwise tokens."""
    folded = ((tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    low = np.full(runs + TOKENS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(folded), 1024):
        part = folded[a : a + 1024]
        x = part[None, :] * MULTIPLY[: runs + TOKENS, None] + ADD[: runs + TOKENS, None]
        np.minimum(low, x.min(axis=1), out=low)
    roots = (low[:runs].astype(np.uint64) << np.uint64(16)) | np.arange(runs, dtype=np.uint64)
    mixed = (low[runs:] * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return roots.astype(np.int64), mixed.astype(np.uint8).tobytes()


def sketched(docs: DataFrame, doc_id: str, text: str, runs: int) -> DataFrame:
    """(doc_id, t: key of the text, ka, kb: key of the set or null, n, roots, sig) of every document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(text)).alias("t"), F.col(text).cast("binary").alias("raw"))
    schema = own.select("doc_id", "t").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw in values(batch.column(2)):
                tokens = shingles(raw)
                if len(tokens):
                    key, (roots, sig) = xxhash.xxh3_128_digest(tokens.tobytes()), sketch(tokens, runs)
                    row = [int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), len(tokens), roots, sig]
                else:
                    row = [None, None, 0, None, None]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "ka", "kb", "n", "roots", "sig"])

    full = own.select(
        "doc_id", "t", *[F.lit(None).cast(k).alias(c) for c, k in (("ka", "long"), ("kb", "long"), ("n", "long"), ("roots", "array<long>"), ("sig", "binary"))]
    ).schema
    assert schema.names == ["doc_id", "t"]
    return own.mapInArrow(run, full)


def by_group(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches in the order of a key column."""
    left: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]) if left is not None else t
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0
        if cut:
            yield t.slice(0, cut)
        left = t.slice(cut)
    if left is not None and len(left):
        yield left


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest that the edges connect it to."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, was[i], low)
        np.minimum.at(label, was[j], low)
        label = label[label]
        if (label == was).all():
            return label


def pairs_within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside consecutive groups of these sizes, a bounded number at once."""
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    partners = ends - np.arange(len(ends)) - 1  # of each row, those after it in its group
    total = np.cumsum(partners)
    at = 0
    while at < len(partners):
        base = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
        n = partners[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto


def compare_buckets(least: float) -> Callable:
    """Of batches of (bucket, ka, sig), in the order of buckets: (a, b), each set with the smallest that it connects to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches):
            buckets, ka = t.column(0).to_numpy(), t.column(1).to_numpy()
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(t), TOKENS)
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)))
            label = np.arange(len(t))
            for i, j in pairs_within(sizes):  # edges are folded into the labels portion by portion
                near = (sig[i] == sig[j]).sum(axis=1) >= least * TOKENS
                label = lowest(len(t), label[i[near]], label[j[near]])[label]
            at = np.flatnonzero(label != np.arange(len(t)))
            yield pa.RecordBatch.from_arrays([pa.array(ka[at]), pa.array(ka[label[at]])], names=["a", "b"])

    return run


def gridded(rows: DataFrame, blocks: str, *into: str) -> DataFrame:
    """Each row once for each cell (bi, bj) of its group's grid; blocks: the column with the number of blocks."""
    own = F.pmod(F.xxhash64("ka", F.lit(2)), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.select(*into, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): each set with another one that it may be linked to, enough to connect all that are."""
    rows = sets.select(F.explode("roots").alias("bucket"), "ka", "sig")
    compare, out, seen = compare_buckets(least), None, []

    def small(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "ka", "sig").mapInArrow(compare, "a long, b long")

    def grid(large: DataFrame) -> DataFrame:
        blocks = large.withColumn("blocks", F.ceil(F.col("size") / GRID_SETS))
        return gridded(blocks, "blocks", "bucket", "ka", "sig").select(F.xxhash64("bucket", "bi", "bj").alias("bucket"), "ka", "sig")

    for level in range(DEPTH + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        rows = stored(rows.join(sizes, "bucket"), f"buckets-{level}")
        seen.append(small(rows.filter(F.col("size") <= LIMIT)))
        large = rows.filter(F.col("size") > LIMIT)
        if large.isEmpty():
            break
        if level == DEPTH:
            seen.append(small(grid(large)))
            break
        # A child is named by its parent, the token's place and its value.
        place = (F.pmod(F.xxhash64("bucket", "k"), F.lit(TOKENS)) + 1).cast("int")
        split = large.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))))
        split = split.withColumn("child", F.xxhash64("bucket", "k", F.substring(F.col("sig"), place, F.lit(1))))
        alike = F.sum(F.col("n") * F.col("n")) / F.first(F.col("size") * F.col("size")) / BRANCH
        dense = split.groupBy("bucket", "size", "child").agg(F.count("*").alias("n")).groupBy("bucket").agg(alike.alias("alike"))
        dense = stored(dense.filter(F.col("alike") >= DENSE).select("bucket"), f"dense-{level}")
        seen.append(small(grid(large.join(dense, "bucket", "left_semi"))))
        rows = split.join(dense, "bucket", "left_anti").select(F.col("child").alias("bucket"), "ka", "sig")
    for x in seen:
        out = x if out is None else out.unionByName(x)
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 blocks over the shingles that two sets or more hold."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    shared = n[at] > 1
    owner, at = owner[shared], rank[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((m, m))
    width = 4096
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [a, a + width])
        block = np.zeros((m, width), np.float32)
        block[owner[lo:hi], at[lo:hi] - a] = 1
        out += block @ block.T
    return out


def pack_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (t, raw): (t, tokens), the sorted shingle hashes of each text, worked out once and not in each cell."""
    for whole in batches:
        for batch in portions(whole, 1):
            tokens = pa.array((shingles(x).tobytes() for x in values(batch.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=["t", "tokens"])


def verify_cells(threshold: float) -> Callable:
    """Of batches of (cell, ka, kb, own, bi, bj, tokens) in the order of cells: (ka, kb, la, lb, links) for each set: the
    smallest set that the cell's links connect it to, and the number of links that are counted in this cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches):
            cell = t.column(0).to_numpy()
            ka, kb, own = (t.column(c).to_numpy() for c in (1, 2, 3))
            across = t.column(4).to_numpy() != t.column(5).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            label, links = np.arange(len(t)), np.zeros(len(t), np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in t.column(6).slice(a, b - a).to_pylist()]
                n = np.array([len(x) for x in sets])
                both = intersections(sets)
                near = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                np.fill_diagonal(near, False)
                if across[a]:
                    near &= own[a:b][:, None] != own[a:b][None, :]
                links[a:b] = near.sum(axis=1)
                i, j = np.nonzero(near)
                label[a:b] = a + lowest(b - a, i, j)
            names = ["ka", "kb", "la", "lb", "links"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ka, kb, ka[label], kb[label], links)], names=names)

    return run


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(doc_id, t, root, class_id, n_links, n_copies) of every document: t is the key of its text; root names its class,
    null without words; n_links is the number of other shingle sets at the threshold or above; n_copies the number of
    other documents with the same set."""
    sketches = stored(sketched(docs, doc_id, text, runs_for(threshold, recall)), "sketches")
    sets = sketches.filter("n > 0").groupBy("ka", "kb").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("t").alias("t"), F.first("n").alias("n"),
        F.first("roots").alias("roots"), F.first("sig").alias("sig"),
    )
    sets = stored(sets, "sets")
    found = components(candidates(sets, threshold - slack(threshold, recall)))
    members = found.select(F.col("v").alias("ka"), "root").unionByName(found.select(F.col("root").alias("ka"), "root").distinct())
    members = stored(sets.select("ka", "kb", "t", "n").join(members, "ka"), "members")
    groups = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    cells = gridded(members.join(groups, "root"), "blocks", "root", "ka", "kb", "t", "blocks")
    wanted = members.select("t").distinct()
    texts = docs.select(row_key(F.col(text)).alias("t"), F.col(text).cast("binary").alias("raw"))
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = texts.join(wanted, "t", "left_semi").groupBy("t").agg(F.first("raw").alias("raw"))
    packed = texts.mapInArrow(pack_shingles, texts.select("t", F.col("raw").alias("tokens")).schema)
    cells = cells.join(packed, "t").select(F.xxhash64("root", "bi", "bj").alias("cell"), "ka", "kb", "own", "bi", "bj", "tokens", "blocks")
    whole = cells.repartition("cell").sortWithinPartitions("cell").drop("blocks")
    judged = whole.mapInArrow(verify_cells(threshold), "ka long, kb long, la long, lb long, links long")
    judged = stored(judged, "judged")
    vertex = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    linked = judged.select(vertex("ka", "kb").alias("a"), vertex("la", "lb").alias("b"))
    final = components(linked)
    links = judged.groupBy("ka", "kb").agg(F.sum("links").alias("n_links"))
    own = sets.select("ka", "kb", "rep", "copies", vertex("ka", "kb").alias("v")).join(final, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = own.groupBy("root").agg(F.min("rep").alias("class_id"))
    own = own.join(names, "root").join(links, ["ka", "kb"], "left").select("ka", "kb", "root", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sketches.filter("n > 0").select("doc_id", "t", "ka", "kb").join(own, ["ka", "kb"])
    rows = rows.select("doc_id", "t", "root", "class_id", "n_links", (F.col("copies") - 1).alias("n_copies"))
    none = F.lit(0).cast("long")
    no_root = F.lit(None).cast(rows.schema["root"].dataType).alias("root")
    return rows.unionByName(sketches.filter("n = 0").select("doc_id", "t", no_root, F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies")))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but one document of each class: the smallest id stays, then the smallest key of the text. Of rows
    repeated in id and text one stays. Documents without words all stay."""
    found = stored(near_duplicates(docs, doc_id=doc_id, text=text, **options).select("doc_id", "t", "root").filter("root IS NOT NULL"), "near-duplicates")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("keep"), F.count("*").alias("size")).filter("size > 1")
    same = F.struct("doc_id", "t").eqNullSafe(F.col("keep"))
    judged = found.join(first, "root").select(row_key(F.col("doc_id"), F.col("t.a"), F.col("t.b")).alias("_tessella_key"), same.alias("stays"))
    judged = stored(judged, "judged-rows")
    gone = judged.filter("NOT stays").select("_tessella_key").distinct()
    repeated = judged.filter("stays").groupBy("_tessella_key").agg(F.count("*").alias("n")).filter("n > 1").select("_tessella_key")
    t = row_key(F.col(text))
    keyed = docs.withColumn("_tessella_key", row_key(F.col(doc_id), t["a"], t["b"]))
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, "_tessella_key", "left_anti")
    if repeated.isEmpty():
        return kept.drop("_tessella_key")
    once = kept.join(repeated, "_tessella_key", "left_semi").dropDuplicates([doc_id, text])
    return kept.join(repeated, "_tessella_key", "left_anti").unionByName(once).drop("_tessella_key")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("t", "root")


#: Shingles are compared as texts; texts under five words are one shingle.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0
), sets AS (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM s GROUP BY s),
tokens AS (SELECT rep, n, unnest(s) AS tok FROM sets),
freq AS (SELECT tok FROM tokens GROUP BY tok HAVING count(*) > 1),
common AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM (SELECT * FROM tokens SEMI JOIN freq USING (tok)) x JOIN (SELECT * FROM tokens SEMI JOIN freq USING (tok)) y ON x.tok = y.tok AND x.rep <> y.rep GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE k >= 0.8 * (na + nb - k) - 1e-9),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS class_id FROM r GROUP BY a
)
SELECT s.doc_id, r.class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(t.copies - 1 AS BIGINT) AS n_copies
FROM s JOIN sets t ON s.s = t.s JOIN reach r ON r.a = t.rep LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = t.rep
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM w WHERE len(w) = 0
"""
