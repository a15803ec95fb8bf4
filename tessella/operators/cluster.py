"""Clusters, links and names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import discover_k
from tessella.operators.sequence import numbered
from tessella.sources.shared import stored

#: Vectors in a block of the pairwise comparison; where only links are asked for, most in a block, blocks aimed at, and products at once.
BLOCK = 2048
LINK_BLOCK, FEWEST, TILE = 16_384, 8, 4_000_000
#: Edges that become stars at once.
LOCAL = 500_000
MIN_CLUSTER = 8


def eps_edges(df: DataFrame, min_sim: float, *, links: bool = False, only: tuple[list[str], Callable] | None = None, left: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of pairs of (id, vector) at a cosine or more.

    Rows are dealt into blocks by id hash; each pair of blocks is one cell, compared as a matrix product in one task, so
    a row is sent once for each block and pairs become rows only where they are linked.

    links: (a, b) that connect what they connect. only: columns, and a function of their values in the rows of each pair and of
    similarities that tells which pairs are wanted. left: a column, true in one row at least of each pair, with `only`.
    """
    if links:
        return eps_links(df, min_sim)
    if left:
        return left_pairs(df, min_sim, only, left)
    more, wanted = only or ([], None)
    n = max(1, -(-df.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = df.select("id", "vector", *more, own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vector", *more)

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        m = np.array(cell["vector"].tolist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        ids, own = cell["id"].to_numpy(), cell["own"].to_numpy()
        sims = m @ m.T
        near = (sims >= min_sim) & (ids[:, None] < ids[None, :])
        if cell["i"].iat[0] != cell["j"].iat[0]:
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(near)
        if only:
            keep = wanted(*({c: cell[c].to_numpy()[x] for c in more} for x in (a, b)), sims[a, b])
            a, b = a[keep], b[keep]
        return pd.DataFrame({"a": ids[a], "b": ids[b], "similarity": sims[a, b]})

    return cells.groupBy("i", "j").applyInPandas(compare, "a long, b long, similarity double")


def left_pairs(df: DataFrame, min_sim: float, only: tuple[list[str], Callable], left: str, block: int = LINK_BLOCK) -> DataFrame:
    """eps_edges() with `only` and `left`: blocks of the rows with `left` meet blocks of all, each two of them in one task.

    Products are in single precision, and in double for what that leaves open, so `only` is asked with cosines a little too high first.
    """
    more, wanted = only
    rows = df.filter("vector IS NOT NULL").select("id", "vector", *more, F.col(left).alias("_left"))
    n, n_left = rows.agg(F.count("*"), F.count_if("_left")).first()
    size = min(block, max(BLOCK, -(-n // FEWEST)))
    blocks, lefts = max(1, -(-n // size)), max(1, -(-n_left // size))
    dealt = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cells = rows.filter("_left").select(dealt(1, lefts).alias("i"), every(blocks).alias("j"), F.lit(True).alias("asks"), *rows.columns)
    cells = cells.unionByName(rows.select(every(lefts).alias("i"), dealt(2, blocks).alias("j"), F.lit(False).alias("asks"), *rows.columns))

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        asks, ids, is_left = (cell[c].to_numpy() for c in ("asks", "id", "_left"))
        own = {c: cell[c].to_numpy() for c in more}
        here, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(here) and len(there):
            m = cell["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            slack = 1.2e-7 * (m.shape[1] + 8)
            x32, y32 = m[here].astype(np.float32), m[there].astype(np.float32)
            step = max(1, TILE // len(there))
            for s in range(0, len(here), step):
                sims = x32[s : s + step] @ y32.T
                at = np.flatnonzero(sims >= min_sim - slack)
                a, b = np.divmod(at, len(there))
                a, b, sim = here[s + a], there[b], sims.ravel()[at].astype(np.float64) + slack
                # Two rows with `left` meet twice.
                keep = (ids[a] != ids[b]) & ((ids[a] < ids[b]) | ~is_left[b])
                a, b, sim = a[keep], b[keep], sim[keep]
                keep = wanted(*({c: v[x] for c, v in own.items()} for x in (a, b)), sim)
                a, b = a[keep], b[keep]
                for k in range(0, len(a), 1 << 16):
                    p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    sim = (m[p] * m[q]).sum(axis=1)
                    keep = (sim >= min_sim) & wanted(*({c: v[x] for c, v in own.items()} for x in (p, q)), sim)
                    out.append((ids[p[keep]], ids[q[keep]], sim[keep]))
        a, b, sim = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "similarity": pa.array(sim)})

    return cells.groupBy("i", "j").applyInArrow(compare, "a long, b long, similarity double")


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of vertices, each the position of the first of its set, after the sets of the ends of edges are one."""
    x, y = label[a], label[b]
    while (apart := x != y).any():
        x, y = x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := label[label], label):
            label = far
        x, y = label[x], label[y]
    return label


def starred(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as (a, b) of every vertex and the smallest id that the edges of its partition, LOCAL at a time, connect it with."""

    def stars(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in part]) for c in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = united(np.arange(len(ids)), at[: len(a)], at[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = [], 0
        for batch in batches:
            if len(batch):
                part, n = [*part, batch], n + len(batch)
            if n >= LOCAL:
                yield stars(part)
                part, n = [], 0
        if part:
            yield stars(part)

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of the edges (a, b); root is the component's smallest id.

    Each partition's edges become stars. While more than LOCAL are left, every vertex goes into that of its neighbours and itself
    which is first in an order at random, so that a third of them and more go in each round, by expectation and however long the paths are. At most LOCAL edges
    are stars at once in one task; then the rounds are followed back. Tables are written to the shared folder, which ends their lineage.
    With two points enough for a cluster, these are the clusters of a density clustering too.
    """
    first = left = stored(starred(edges), "edges")
    rounds, links = [], left
    while (n := links.count()) > LOCAL:
        links = links.filter("a <> b")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = F.lit(len(rounds))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(turn, "b").alias("by"), "b")).alias("near"))
        into = near.select("a", F.least("near", F.struct(F.xxhash64(turn, "a").alias("by"), F.col("a").alias("b")))["b"].alias("into"))
        rounds.append(stored(into, "into"))
        name = lambda c: rounds[-1].select(F.col("a").alias(c), F.col("into").alias(f"_{c}"))
        ends = links.join(name("a"), "a").join(name("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        links = stored(starred(ends), "edges")
    labels = starred(links.coalesce(1)).select(F.col("a").alias("id"), F.col("b").alias("root"))
    if not rounds:
        return stored(labels, "labels")
    for into in reversed(rounds):
        labels = into.join(labels.select(F.col("id").alias("into"), "root"), "into", "left").select(F.col("a").alias("id"), F.coalesce("root", "into").alias("root"))
        labels = stored(labels, "labels")
    labels = first.select(F.col("a").alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("_root"))
    labels = stored(labels, "labels")
    least = labels.groupBy("_root").agg(F.min("id").alias("root"))
    return stored(labels.join(least, "_root").select("id", "root"), "labels")


def new_links(x: np.ndarray, y: np.ndarray | None, min_sim: float, label: np.ndarray) -> np.ndarray:
    """Labels, as united() has them, of the rows of x and then y after pairs of one with the other, or of x with itself, at a cosine
    or more are linked. Rows are of unit length. Products are in single precision, and in double where that leaves it open."""
    other, start = (x, 0) if y is None else (y, len(x))
    x32, y32, slack = x.astype(np.float32), other.astype(np.float32), 1.2e-7 * (x.shape[1] + 8)
    step = max(1, TILE // max(1, len(other)))
    for s in range(0, len(x), step):
        if not label.any():
            break  # all are linked
        skip = s if y is None else 0
        sims = x32[s : s + step] @ y32[skip:].T
        at = np.flatnonzero(sims >= min_sim - slack)
        a, b = np.divmod(at, sims.shape[1])
        open_ = label[s + a] != label[start + skip + b]
        a, b, sim = s + a[open_], skip + b[open_], sims.ravel()[at[open_]]
        near = sim >= min_sim + slack
        for k in range(0, len(a), 1 << 16):
            part = np.flatnonzero(~near[k : k + (1 << 16)]) + k
            near[part] = (x[a[part]] * other[b[part]]).sum(axis=1) >= min_sim
        label = united(label, a[near], start + b[near])
    return label


def grid_links(rows: DataFrame, key: str | None, min_sim: float, known: str | None = None, block: int = LINK_BLOCK) -> DataFrame:
    """(a, b) of rows (id, vector) that connect what pairs at a cosine or more connect, within each value of a key.

    Rows are dealt into blocks by id hash; each pair of blocks is one cell, compared tile by tile in one task, and hands on fewer
    edges than it has rows. Blocks are as large as leaves FEWEST of them, and `block` at most. known: a column of sets that are
    connected already; only what connects two of them is handed on.
    """
    rows = rows.select(*([F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]), "id", "vector", *([F.col(known).alias("_known")] if known else [])).filter("vector IS NOT NULL")
    size = rows.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.least(F.ceil(F.col("_n") / BLOCK), F.lit(FEWEST))).cast("int")
    size = F.broadcast(stored(size.select(F.col("_key").alias("_of"), blocks.alias("_blocks")), "blocks"))
    rows = rows.join(size, F.col("_key").eqNullSafe(F.col("_of")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    sent = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = sent.select("_key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vector", *(["_known"] if known else []))

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, i, own = (cell[c].to_numpy() for c in ("id", "i", "own"))
        m = cell["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        order = np.lexsort((ids, own))  # the rows of block i first
        ids, m, n = ids[order], m[order], int((own == i[0]).sum())
        before = np.arange(len(ids))
        if known:
            _, first, of = np.unique(cell["_known"].to_numpy()[order], return_index=True, return_inverse=True)
            before = first[of.ravel()]
        after = new_links(m[:n], m[n:] if n < len(ids) else None, min_sim, before)
        moved = np.flatnonzero((before == np.arange(len(ids))) & (after != before))
        return pa.table({"a": pa.array(ids[after[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    return cells.groupBy("_key", "i", "j").applyInArrow(compare, "a long, b long")


def eps_links(df: DataFrame, min_sim: float) -> DataFrame:
    """(a, b) that connect what the pairs of eps_edges() connect: fewer than a cell of the grid has rows."""
    return grid_links(df, None, min_sim)


def linked_groups(vectors: DataFrame, min_sim: float, same: DataFrame | None = None, join: Callable = eps_links) -> DataFrame:
    """Clusters of the similarity graph together with decisions (a, b) that two rows are the same.

    join: what finds pairs at a cosine or more that connect the rest; eps_links() compares all, index.near_links() begins with those
    that an index lets meet.
    """
    edges = join(vectors, min_sim).select("a", "b")
    if same is not None:
        edges = edges.unionByName(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return components(edges)


def kept_names(new: DataFrame, old: DataFrame) -> DataFrame:
    """(root, name): each new group takes the most common old name among its members, ties to the smaller."""
    votes = new.join(old, "id").groupBy("root", "name").agg(F.count("*").alias("n"))
    return votes.groupBy("root").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))


def kmeans(df: DataFrame, k: int | None = None, rounds: int = 12, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster) of unit vectors, and the centroids: assignment and sums are a map over Arrow batches; a round sends
    k sums from each task."""
    n = df.count()
    k = k or discover_k(n)
    d = df.select(F.size("vector").alias("d")).first().d
    start = df.orderBy(F.xxhash64("id", F.lit(seed))).limit(k).toPandas()
    centres = np.array(start["vector"].tolist(), np.float64)

    def assign(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (m @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)

    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(centres), np.zeros(len(centres))
            for b in batches:
                if len(b):
                    m = np.array(b["vector"].tolist(), np.float64)
                    label = assign(m, centres)
                    np.add.at(total, label, m)
                    count += np.bincount(label, minlength=len(centres))
            yield pd.DataFrame({"cluster": range(len(centres)), "n": count, "total": list(total)})

        parts = df.select("vector").mapInPandas(sums, "cluster int, n double, total array<double>")
        flat = parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = centres.copy()
        for r in flat.collect():
            if r.n:
                new[r.cluster, r.pos] = r.x / r.n
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    assert centres.shape == (len(start), d)

    def label(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "cluster": assign(np.array(b["vector"].tolist(), np.float64), centres)})

    return df.select("id", "vector").mapInPandas(label, "id long, cluster int"), centres


def named_clusters(df: DataFrame, labels: list[str], words: np.ndarray, k: int | None = None, share: float = 0.25, contrast: float = 0.5, floor: float = 0.0) -> DataFrame:
    """(id, cluster, name, closeness): k-means, clusters under MIN_CLUSTER folded into the nearest, each named by the word
    that its centroid and a share of its members agree on, else `group N`; repeats are numbered."""
    found, centres = kmeans(df, k)
    found = stored(found, "kmeans")
    sizes = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    large = [c for c in sizes if sizes[c] >= MIN_CLUSTER] or [max(sizes, key=sizes.get)]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    into = {c: c if c in large else max(large, key=lambda x: float(unit[c] @ unit[x])) for c in sizes}
    mean = sum(sizes[c] * centres[c] for c in sizes) / sum(sizes.values())
    mean = mean / max(float(np.linalg.norm(mean)), 1e-12)
    lift = words @ mean

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.array(b["vector"].tolist(), np.float64) @ words.T - contrast * lift
                yield pd.DataFrame({"id": b["id"], "word": s.argmax(axis=1)})

    fold = F.create_map(*[F.lit(x) for c, t in into.items() for x in (c, t)])
    found = found.withColumn("cluster", fold[F.col("cluster")])
    votes = found.join(df.select("id", "vector").mapInPandas(vote, "id long, word int"), "id").groupBy("cluster", "word").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    names, used, nth = {}, {}, 0
    by = {}
    for r in votes.collect():  # at most clusters x words rows
        by.setdefault(r.cluster, []).append(r)
    for c in sorted(by, key=lambda c: (-sum(r.n for r in by[c]), min(r.first for r in by[c]))):
        total, top = sum(r.n for r in by[c]), max(by[c], key=lambda r: (r.n, -r.word))
        own = unit[c] @ words.T
        pick = int((own - contrast * lift).argmax())
        if top.word == pick and top.n >= share * total and own[pick] >= floor:
            used[pick] = used.get(pick, 0) + 1
            names[c] = labels[pick] + (f" {used[pick]}" if used[pick] > 1 else "")
        else:
            nth += 1
            names[c] = f"group {nth}"
    table = df.sparkSession.createDataFrame([(int(c), names[c], [float(x) for x in unit[c]]) for c in names], "cluster int, name string, _c array<double>")
    from tessella.functions.scalars import dot

    rows = found.join(df.select("id", "vector"), "id").join(F.broadcast(table), "cluster").withColumn("cos", dot(F.col("vector"), F.col("_c")))
    span = rows.groupBy("cluster").agg(F.min("cos").alias("lo"), F.max("cos").alias("hi"))
    close = F.when(F.col("hi") > F.col("lo"), (F.col("cos") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return rows.join(F.broadcast(span), "cluster").select("id", "cluster", "name", close.alias("closeness"))


def average_linkage(m: np.ndarray, cut: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Groups of rows by average linkage of a distance matrix, up to a distance; numbered by size, then first row. A row
    may stand for a number of equal ones, its weight."""
    n = len(m)
    d = m.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n) if weight is None else weight.astype(float), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        group[i] += group[j]
        alive[j] = False
    out = np.zeros(n, int)
    order = sorted((g for g, a in zip(group, alive, strict=True) if a), key=lambda g: (-len(g), min(g)))
    for k, g in enumerate(order):
        out[g] = k
    return out


def cosine_linkage(unit: np.ndarray, cut: float) -> np.ndarray:
    """The groups of average_linkage() of the cosine distances of unit rows, without their matrix.

    The mean distance of two groups is one less the product of their means, so a mean stands for each group. Chains of
    nearest neighbours merge the same groups as closest pairs first do, as a merge brings no group nearer to others. A group
    whose nearest is beyond the cut stays as it is. Memory grows with the rows, time with their square.
    """
    mean, size, group = unit.astype(float), np.ones(len(unit)), [[i] for i in range(len(unit))]
    alive, done, chain = np.ones(len(unit), bool), [], []
    while alive.any():
        if not chain:
            if alive.sum() * 2 < len(alive):
                mean, size, group, alive = mean[alive], size[alive], [g for g, a in zip(group, alive, strict=True) if a], alive[alive]
            chain.append(int(alive.argmax()))
        i = chain[-1]
        sims = mean @ mean[i]
        sims[~alive] = -np.inf
        sims[i] = -np.inf
        j = int(sims.argmax())
        if len(chain) > 1 and sims[chain[-2]] >= sims[j] - 1e-12:
            j = chain[-2]
        if 1 - sims[j] > cut:
            # All that is before it in a chain would be nearer, so it is alone there; else rounding is at play.
            chain.pop()
            alive[i] = False
            done.append(group[i])
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            size[i] += size[j]
            group[i] = group[i] + group[j]
            alive[j] = False
        else:
            chain.append(j)
    out = np.zeros(len(unit), int)
    for k, g in enumerate(sorted(done, key=lambda g: (-len(g), min(g)))):
        out[g] = k
    return out


def within_links(df: DataFrame, key: str, min_sim: float, work, name: str, more: str = "") -> DataFrame:
    """(key, id, name, more) by a function of the rows of a component: of the pairs of a key's rows at a cosine or more.

    work: vectors of one component in the order of id, and lists of the other columns -> (position, name (numbers of its own), the
    columns of `more`) of rows. Groups
    are numbered over the whole key, by size, then smallest id. Pairs are compared in a grid of blocks for each key, of which a
    cell hands on what connects its rows; components are dealt over tasks. A component is worked on in one task.
    """
    kind, blocks = df.schema[key].dataType.simpleString(), F.ceil(F.col("_n") / BLOCK).cast("int")
    # Vertices are hashes; should two rows share one, their components meet in one task, which changes no result.
    rows = stored(df.withColumn("_v", F.shiftrightunsigned(F.xxhash64(key, "id"), 28)), "rows")
    large = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK).select("_key", blocks.alias("_blocks"))
    roots = components(grid_links(rows.select(key, F.col("_v").alias("id"), "vector"), key, min_sim))
    rows = rows.join(F.broadcast(stored(large, "large")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    parts = rows.join(roots.withColumnRenamed("id", "_v"), "_v", "left").withColumn("_root", F.coalesce("root", "_v")).drop("root")
    parts = parts.withColumn("_task", F.pmod(F.xxhash64("_root"), F.col("_blocks") * 4))

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values(["_root", "id"], ignore_index=True)
        bounds = np.flatnonzero(np.r_[True, np.diff(task["_root"].to_numpy()) != 0, True])
        m, out = np.array(task["vector"].tolist(), np.float64), []
        for nth, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            out += [(lo + at, nth, *rest) for at, *rest in work(m[lo:hi], *[task[c].iloc[lo:hi].tolist() for c in use])]
        got = pd.DataFrame(out, columns=["_at", "_part", name, *more_names])
        got["id"] = task["id"].to_numpy()[got["_at"].to_numpy(dtype=int)]
        per = got.groupby(["_part", name])["id"]
        return got.assign(_first=per.transform("min"), _size=per.transform("size"), **{key: task[key].iat[0]})[columns]

    more_names = [c.split()[0] for c in more.split(", ") if c]
    use = [c for c in df.columns if c not in (key, "id", "vector")]
    columns = [key, "id", *[c.split()[0] for c in more.split(", ") if c], "_first", "_size"]
    found = parts.groupBy(key, "_task").applyInPandas(run, f"{key} {kind}, id long, {more + ', ' if more else ''}_first long, _size long")
    found = stored(found, "found")
    groups = numbered(found.select(F.col(key).alias("_key"), (-F.col("_size")).alias("_less"), "_first").distinct(), "_key", "_less", "_first", name="_at")
    groups = stored(groups, "groups")
    start = groups.groupBy(F.col("_key").alias("_of")).agg(F.min("_at").alias("_start"))
    groups = groups.join(start, F.col("_key").eqNullSafe(F.col("_of"))).select("_key", F.col("_first").alias("_f"), (F.col("_at") - F.col("_start")).cast("int").alias(name))
    joined = found.join(groups, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_first") == F.col("_f")))
    return joined.select(key, "id", name, *[c.split()[0] for c in more.split(", ") if c])


def linkage_groups(df: DataFrame, key: str, cut: float) -> DataFrame:
    """(key, id, group) by average linkage of cosine distance within each value of key, of any size. Groups never reach
    across components of the pairs within the cut, so each component is clustered on its own."""

    def work(m: np.ndarray) -> list[tuple[int, int]]:
        return list(enumerate(cosine_linkage(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), cut).tolist()))

    return within_links(df.select(key, "id", "vector"), key, 1 - cut - 1e-9, work, "group")
