"""Cross-site removal of boilerplate lines, with built-in functions only.

Each line is known by a 128-bit hash of its folded text. A HyperLogLog sketch of the sites that hold it (32 registers)
is built for every hash by a partial aggregation on the map side and merged after the shuffle. For so few registers a
sketch's estimate bounds the count from below: with n sites at most n registers are filled, so an estimate over
`sure_above(min_sites)` proves that the threshold is met. Lines that the sketch leaves open (estimate not above that, but
enough occurrences on more than one site) get exact distinct counts. The decisions are therefore exact.

A line on at least `min_sites` sites is boilerplate. Its first occurrence (smallest document id, then text, then
position) stays, all others go. Blank lines are never removed. Lines are exploded as hashes; only the documents that
lose a line are joined again, by a key of their id and text.

Defined results: a null text stays null and has no lines; an empty text has one blank line; a null site counts as one
site of its own; rows repeated in id and text are treated alike, so both keep a first occurrence; a null id sorts first;
other columns are passed through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import row_key, stored, table
from tessella.llm._spans import let

#: Sites from which a line is boilerplate.
MIN_SITES = 5
#: Error that gives a sketch of 32 registers.
RSD = 0.2
REGISTERS = 32
#: Boilerplate lines whose first places (50 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_LINES = 500_000


def sure_above(min_sites: int) -> int:
    """The largest estimate that fewer than min_sites sites can give: each fills one register at most.

    Small counts are estimated as m ln(m / (m - filled)). Beyond what that can express no estimate is proof.
    """
    filled = min_sites - 1
    return round(REGISTERS * log(REGISTERS / (REGISTERS - filled))) if filled <= REGISTERS // 4 else 1 << 30


def folded(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(ha, hb) of the lines on at least min_sites sites."""
    sketches = lines.groupBy("ha", "hb").agg(
        F.approx_count_distinct("site", RSD).alias("about"), F.count("*").alias("n"),
        F.min(F.xxhash64("site")).alias("low"), F.max(F.xxhash64("site")).alias("high"),
    )
    several = (F.col("low") != F.col("high")) | F.lit(min_sites <= 1)
    sketches = stored(sketches.filter((F.col("n") >= min_sites) & several).select("ha", "hb", "about"), "line-sketches")
    sure = F.col("about") > sure_above(min_sites)
    exact = (
        lines.select("ha", "hb", "site").join(sketches.filter(~sure), ["ha", "hb"], "left_semi").groupBy("ha", "hb", "site").agg(F.lit(1))
        .groupBy("ha", "hb").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    )
    return sketches.filter(sure).select("ha", "hb").unionByName(exact.select("ha", "hb"))


def remove_boilerplate(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """docs' columns in a struct `row`; `clean`, the text without boilerplate lines; n_lines and n_removed."""
    t, d = F.col(f"row.{text}"), F.col(f"row.{doc_id}")
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", row_key(d, t))
    split = F.split(t, "\n", -1)
    lines = rows.filter(t.isNotNull()).select(
        F.struct(d.alias("d"), F.col("key.a").alias("ka"), F.col("key.b").alias("kb")).alias("doc"),
        F.coalesce(F.concat(F.lit("="), F.col(f"row.{site}").cast("string")), F.lit("")).alias("site"),
        F.posexplode(F.transform(split, lambda x: folded(x))).alias("pos", "line"),
    )
    lines = lines.filter(F.col("line") != "").withColumn("h", row_key(F.col("line"))).select(
        F.col("h.a").alias("ha"), F.col("h.b").alias("hb"), "site", "doc.d", "doc.ka", "doc.kb", "pos"
    )
    lines = stored(lines, "lines")
    known = stored(boilerplate(lines, min_sites), "boilerplate")
    if known.count() <= BROADCAST_LINES:  # a line that very many documents share is then in no one task's hands
        known = F.broadcast(known)
    common = stored(lines.join(known, ["ha", "hb"], "left_semi").select("ha", "hb", F.struct("d", "ka", "kb", "pos").alias("at")), "common-lines")
    first = stored(common.groupBy("ha", "hb").agg(F.min("at").alias("first")), "first-lines")
    if first.count() <= BROADCAST_LINES:
        first = F.broadcast(first)
    lost = (
        common.join(first, ["ha", "hb"]).filter(~F.col("at").eqNullSafe(F.col("first")))
        .groupBy(F.struct(F.col("at.ka").alias("a"), F.col("at.kb").alias("b")).alias("key")).agg(F.collect_set("at.pos").alias("gone"))
    )
    # Positions that stay, by a hash of those that go: the work follows the number of lines.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    kept = let(split, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    return rows.join(lost, "key", "left").select(
        "row", F.when(F.col("gone").isNull(), t).otherwise(kept).alias("clean"),
        F.when(t.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))


#: Keys of id and text are ids here, as ids are unique in the table.
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, i, raw, lower(trim(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), common AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 5
), judged AS (
  SELECT l.*, c.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.i) > 1 AS gone
  FROM lines l LEFT JOIN common c ON c.line = l.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS clean_sha256
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
