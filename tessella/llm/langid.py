"""Language identification by rank-order profiles.

A profile is a list of n-grams, of one to three letters, in order of frequency. Words are runs of letters in lower case between
blanks; n-grams may hold the blank at either end of a word. A language's profile holds the most frequent n-grams of all the texts
it is learned from: tasks count them, the counts are added up by language and n-gram, and a rank limit (which Spark also applies
before the shuffle) keeps the first. A document's profile is made of its whole text in the same way. Its distance to a language
is the sum, over its n-grams, of how far the language's profile has them out of place; what the profile lacks counts as far as
the profile is long. The nearest language is predicted. Profiles reach the tasks as a map from n-gram to places; each language
has at most `size` n-grams, and more than MOST_LANGUAGES languages are an error, so that map is bounded.

An n-gram is one long, 21 bits for each code point, so counting is sorting, document by document, in numpy.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned; the
score is the share of the largest distance that the nearest language stays below, times the share by which it is nearer than
the next one, brought to 0 to 1 by a square root; languages at equal distance go by name; equally frequent n-grams go by code
points; a null language teaches nothing, a null id is neither learned from nor held out; repeated rows count each; the length
of a text has no effect but on time; other columns are passed through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm._common import portions, table

#: N-grams of a profile.
SIZE = 400
#: Languages that may be told apart: ISO 639-3 has fewer.
MOST_LANGUAGES = 10_000
#: Counted n-grams that a task holds of a language before it adds them up, and bytes of text that it takes up at once.
HELD, AT_ONCE = 2_000_000, 4_000_000
BITS, BLANK, UNKNOWN = 21, 32, "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as longs, in order, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = letters()[codes]
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[BLANK], np.where(known, codes, BLANK), [BLANK]])
    blank = codes == BLANK
    # Of neighbouring blanks one is left.
    codes = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    blank = codes == BLANK
    pairs = (codes[:-1] << BITS) | codes[1:]
    threes = ((pairs[:-1] << BITS) | codes[2:])[~blank[1:-1]]
    return np.unique(np.concatenate([codes[~blank], pairs, threes]), return_counts=True)


def profile(text: str | None, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first."""
    keys, counts = grams(text)
    if len(keys) > size:
        # np.unique gives the n-grams in order, so a stable sort leaves equally frequent ones in order.
        return keys[np.argsort(-counts, kind="stable")[:size]]
    return keys[np.argsort(-counts, kind="stable")]


def texts(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text): each task's counts, not yet added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[lang]])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held[lang]]), len(keys)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in portions(batch, 1, AT_ONCE):
                for lang, text in zip(texts(part.column(0)), texts(part.column(1)), strict=True):
                    keys, n = grams(text)
                    held.setdefault(lang, []).append((keys, n))
                    sizes[lang] = sizes.get(lang, 0) + len(keys)
                    if sizes[lang] > HELD:
                        held[lang] = [merged(lang)]
                        sizes[lang] = len(held[lang][0][0])
                        if sizes[lang] > HELD // 2:
                            yield out(lang)
                            del held[lang], sizes[lang]
                    elif sum(sizes.values()) > 4 * HELD:
                        # Many languages in one task: none is held on to.
                        for other in list(held):
                            yield out(other)
                        held, sizes = {}, {}
        for lang in held:
            yield out(lang)

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def learned(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, place) of (lang, text): each language's profile, places from 0."""
    totals = counted(rows.filter(F.col("lang").isNotNull())).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < size).select("lang", "gram", "place")


@dataclass
class Places:
    """Profiles by n-gram: those of grams[i] are langs[at[i] : at[i + 1]], with their places."""

    names: list[str]
    grams: np.ndarray
    at: np.ndarray
    langs: np.ndarray
    places: np.ndarray
    size: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """How far the n-grams of a document's profile are out of place in each language."""
        i = np.searchsorted(self.grams, own)
        i[i == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[i] == own)
        a, b = self.at[i[known]], self.at[i[known] + 1]
        sizes = b - a
        rows = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        off = np.abs(self.places[rows] - np.repeat(known, sizes))
        return len(own) * self.size + np.bincount(self.langs[rows], np.minimum(off, self.size) - self.size, len(self.names))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(own)
        best = int(np.argmin(d))  # the first of equals, and names are in order
        near = 1 - d[best] / (len(own) * self.size)
        others = np.delete(d, best)
        lead = 1.0 if not len(others) else 1 - d[best] / others.min() if others.min() else 0.0
        return self.names[best], float(min(1.0, max(0.0, near * lead)) ** 0.5)


def collected(profiles: DataFrame, size: int = SIZE, most: int = MOST_LANGUAGES) -> Places:
    """Profiles for the tasks; their number is checked first."""
    names = sorted(r.lang for r in profiles.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages: not a table of languages")
    number = {n: i for i, n in enumerate(names)}
    rows = profiles.toArrow()
    langs = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    keys, places = rows.column("gram").to_numpy(), rows.column("place").to_numpy().astype(np.int64)
    order = np.lexsort((langs, keys))
    distinct, first = np.unique(keys[order], return_index=True)
    return Places(names, distinct, np.append(first, len(order)), langs[order], places[order], size)


def identified(docs: DataFrame, places: Places, *, text: str = "text") -> DataFrame:
    """docs' columns in a struct `row`, and lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(places)
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("own"))
    schema = packed.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, AT_ONCE):
                found = [shared.value.predict(t) for t in texts(part.column(1))]
                columns = [part.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"])

    return packed.mapInArrow(run, schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    places = collected(learned(docs.filter(remainder(F.col("doc_id")) != 1)))
    out = identified(docs.select("doc_id", "text"), places)
    held = F.coalesce(remainder(F.col("row.doc_id")) == 1, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "lang_pred", "score")
