"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each task stores the postings (term, position) of its own documents, so nothing is
shuffled and no list of a frequent term ever meets in one place. A benchmark item is cut into windows of `width` words.
For each window the offset-adjusted lists are intersected from the rarest test term on; what is left are the exact
phrase matches. Proximity matches are places where an item's rarest terms all stand within `slop` words of each other.
Term frequencies, which say what is rare, are counted over the whole corpus first.

The benchmark is broadcast in blocks of bounded size (BLOCK_CHARS of text); however many there are, each is matched
against all documents.

Defined results: null or wordless texts have no words and no matches; repeated rows get the same result each; an item
that has fewer than `width` words is one window, an item without words none; items with a null id take no part; items
that share an id count as one; other columns are passed through, whatever their names; an empty benchmark matches
nothing and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import portions, table, values, words_of

WIDTH, SLOP, RAREST = 10, 24, 4
#: Characters of benchmark text in a block that is broadcast: about 300,000 windows, or 25 MB.
BLOCK_CHARS = 2_000_000
#: Places of windows' rarest terms that are intersected at once.
PLACES_AT_ONCE = 500_000
#: Bytes of text that a task indexes at once; a longer text is a portion by itself.
PORTION_BYTES = 8_000_000

STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near", T.ArrayType(T.StringType())),
    ]
)


class Block:
    """Test terms and windows of some benchmark items, as arrays: about 60 bytes for each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int):
        self.names: list[str] = []
        self.terms: dict[bytes, int] = {}
        self.item_terms: list[np.ndarray] = []
        rows, sizes, owners = [], [], []
        for name, raw in items:
            ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in words_of(raw)], np.int32)
            if not len(ids):
                continue
            size = min(width, len(ids))
            windows = np.full((len(ids) - size + 1, width), -1, np.int32)
            windows[:, :size] = np.lib.stride_tricks.sliding_window_view(ids, size)
            rows.append(windows)
            sizes.append(np.full(len(windows), size, np.int32))
            owners.append(np.full(len(windows), len(self.names), np.int32))
            self.names.append(name)
            self.item_terms.append(np.unique(ids))
        self.windows = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        self.sizes, self.owners = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (sizes, owners))
        self.width = int(self.sizes.max(initial=0))
        self.words = sorted(self.terms)  # ties in frequency go by the term itself
        self.counts = np.zeros(len(self.terms), np.int64)

    def rank(self, counts: dict[bytes, int], rarest: int) -> None:
        """Order every window's offsets, and each item's terms, by their frequency in the corpus."""
        place = np.zeros(len(self.terms), np.int64)
        for k, term in enumerate(self.words):
            place[self.terms[term]] = k
            self.counts[self.terms[term]] = counts.get(term, 0)
        seen = np.where(self.windows >= 0, self.counts[self.windows] if len(self.counts) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(seen, axis=1, kind="stable").astype(np.int16)
        self.signs = [x[np.lexsort((place[x], self.counts[x]))][:rarest] for x in self.item_terms]


class Index:
    """Postings of the test terms in a portion of documents, as sorted numbers term * span + position; positions run on
    over documents, with gaps between them."""

    def __init__(self, texts: list[bytes | None], terms: dict[bytes, int], gap: int):
        get, found, at, place = terms.get, [], [], gap
        self.starts, self.sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for d, raw in enumerate(texts):
            words = words_of(raw)
            self.starts[d], self.sizes[d] = place, len(words)
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            kept = np.flatnonzero(ids >= 0)
            found.append(ids[kept])
            at.append(kept + place)
            place += len(words) + gap
        self.span = place + gap
        ids, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, at))
        self.keys = np.sort(ids * self.span + at)

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of terms begin and end among the keys."""
        return np.searchsorted(self.keys, terms * self.span), np.searchsorted(self.keys, (terms + 1) * self.span)

    def list(self, term: int) -> np.ndarray:
        a, b = self.bounds(np.array([term], np.int64))
        return self.keys[a[0] : b[0]] - term * self.span

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        want = terms * self.span + positions
        i = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
        return self.keys[i] == want if len(self.keys) else np.zeros(len(want), bool)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def phrases(index: Index, block: Block, at_once: int = PLACES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, places where they start): the list of each window's rarest term, adjusted by its offset, is intersected with
    those of its other terms from the rarest on; a bounded number of places at once, of all windows together."""
    if not len(block.windows):
        return
    first = block.order[:, 0].astype(np.int64)
    low, high = index.bounds(block.windows[np.arange(len(first)), first].astype(np.int64))
    total = np.cumsum(high - low)
    for base in range(0, int(total[-1]), at_once):
        k = np.arange(base, min(base + at_once, int(total[-1])))
        w = np.searchsorted(total, k, "right")
        start = index.keys[high[w] - (total[w] - k)] - block.windows[w, first[w]].astype(np.int64) * index.span - first[w]
        for r in range(1, block.windows.shape[1]):
            o = block.order[w, r].astype(np.int64)
            term = block.windows[w, o].astype(np.int64)
            kept = (term < 0) | index.holds(np.maximum(term, 0), start + o)
            w, start = w[kept], start[kept]
        if len(w):
            yield w, start


def nearby(index: Index, block: Block, slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, places of its rarest term with its other signs within slop words)."""
    present = np.zeros(len(block.terms), bool)
    if len(block.terms):
        low, high = index.bounds(np.arange(len(block.terms)))
        present = high > low
    for item, signs in enumerate(block.signs):
        if not present[signs].all():
            continue
        at = index.list(int(signs[0]))
        for t in signs[1:]:
            other = index.list(int(t))
            i = np.searchsorted(other, at)
            after, before = other[np.minimum(i, len(other) - 1)], other[np.maximum(i - 1, 0)]
            at = at[np.minimum(np.abs(after - at), np.abs(at - before)) <= slop]
            if not len(at):
                break
        if len(at):
            yield item, at


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def matched(texts: list[bytes | None], block: Block, slop: int) -> list[tuple[int, list, set, set]]:
    """Of each text: number of words, spans hit, items found exactly, items found by proximity."""
    index = Index(texts, block.terms, max(block.width, slop) + 1)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    near: list[set] = [set() for _ in texts]
    for w, starts in phrases(index, block):
        docs = index.documents(starts)
        for d, s, size, item in zip(docs.tolist(), (starts - index.starts[docs]).tolist(), block.sizes[w].tolist(), block.owners[w].tolist(), strict=True):
            spans[d].append((s, s + size))
            items[d].add(item)
    for item, at in nearby(index, block, slop):
        for d in np.unique(index.documents(at)).tolist():
            near[d].add(item)
    return [
        (int(n), united(s), {block.names[i] for i in x}, {block.names[i] for i in y})
        for n, s, x, y in zip(index.sizes, spans, items, near, strict=True)
    ]


def blocks_of(benchmark: DataFrame, item: str, text: str, width: int, block_chars: int) -> Iterator[Block]:
    """The benchmark in blocks of about block_chars characters, one at a time on the driver."""
    rows = benchmark.filter(F.col(item).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("raw")
    )
    total = rows.agg(F.coalesce(F.sum(F.length("raw") + 16), F.lit(0)).alias("n")).first().n
    n = max(1, ceil(total / block_chars))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k).collect()
        yield Block([(r.item, bytes(r.raw) if r.raw is not None else None) for r in own], width)


def corpus_counts(texts: DataFrame, block: Block) -> dict[bytes, int]:
    """How often each of the block's terms stands in the whole corpus. texts has one column of binary texts."""
    terms = texts.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n = terms.value.get, len(terms.value)
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for raw in values(batch.column(0)):
                words = words_of(raw)
                total += np.bincount(np.fromiter((get(w, n) for w in words), np.int32, len(words)), minlength=n + 1)
        at = np.flatnonzero(total[:n])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    names = list(block.terms)
    out = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {names[r.term]: r.n for r in out.collect()}


def match_documents(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, slop: int = SLOP, rarest: int = RAREST, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs' columns in a struct `row`, and a struct `found` of each text.

    found has n_words; hits, the disjoint spans of words (from 0, end exclusive) inside exact matches; items, the ids of
    items with an exactly matching window; near, those with a proximity match.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(text).cast("binary").alias("raw"))
    none = F.lit(None).cast(STATE)
    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("raw"), none.alias("found"))
    schema = packed.schema
    for block in blocks_of(benchmark, item, item_text, width, block_chars):
        block.rank(corpus_counts(raw, block), rarest)
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in (x for whole in batches for x in portions(whole, 1, PORTION_BYTES)):
                found, was = [], batch.column(2).to_pylist()
                for n, spans, items, near in matched(batch.column(1).to_pylist(), block, slop):
                    if before := was[len(found)]:
                        spans = united(spans + [(x["start"], x["end"]) for x in before["hits"]])
                        items, near = items | {*before["items"]}, near | {*before["near"]}
                    hits = [{"start": s, "end": e} for s, e in spans]
                    found.append({"n_words": n, "hits": hits, "items": sorted(items), "near": sorted(near)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, batch.schema.field(2).type)], names=["row", "raw", "found"]
                )

        packed = packed.mapInArrow(run, schema)
    return packed.select("row", "found")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    n_hit = F.aggregate(found.hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return match_documents(docs, table(spark, sf_dir, "benchmark")).select(
        "row.doc_id",
        found.n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (F.size(found.hits) > 0).alias("contaminated"), F.size(found.near).cast("long").alias("n_near"),
        F.sha2(F.array_join(found.near, ","), 256).alias("near_sha256"),
    )


OP3_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words CROSS JOIN sizes WHERE len(w) >= k)
), occurs AS (SELECT p.rid, p.i, p.k, x.item FROM places p JOIN windows x ON p.k = x.k AND p.phrase = x.phrase),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM occurs) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM occurs GROUP BY rid)
, item_rows AS (SELECT row_number() OVER () AS ir, item, w FROM item_words WHERE len(w) > 0),
item_terms AS (SELECT DISTINCT ir, item, unnest(w) AS term FROM item_rows),
doc_terms AS (SELECT * FROM (SELECT rid, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM doc_words) SEMI JOIN item_terms USING (term)),
seen AS (SELECT term, count(*) AS n FROM doc_terms GROUP BY 1),
signs AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY ir ORDER BY coalesce(n, 0), term) AS r FROM item_terms t LEFT JOIN seen USING (term)) WHERE r <= 4),
sizes_of AS (SELECT ir, max(r) AS k FROM signs GROUP BY 1),
places_of AS (SELECT s.ir, s.item, s.r, d.rid, d.pos FROM signs s JOIN doc_terms d ON s.term = d.term),
found AS (
  SELECT a.rid, a.item FROM places_of a JOIN places_of b ON a.ir = b.ir AND a.rid = b.rid AND abs(a.pos - b.pos) <= 24 JOIN sizes_of k ON k.ir = a.ir
  WHERE a.r = 1 GROUP BY a.rid, a.item, a.ir, a.pos, k.k HAVING count(DISTINCT b.r) = k.k
), near AS (SELECT rid, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM found GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
  CAST(coalesce(e.n, 0) AS BIGINT) AS n_near, sha256(coalesce(e.ids, '')) AS near_sha256
FROM doc_words d LEFT JOIN hit h USING (rid) LEFT JOIN items x USING (rid) LEFT JOIN near e USING (rid)
"""
