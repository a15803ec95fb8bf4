"""Information-theoretic sanitisation of personal data, with built-in functions only.

Base spans are patterns (email, ip, card, phone) with their checks. Each value found is a protected entity. Corpus
co-occurrence then says how strongly a document's terms give its entities away. With N documents, n_e of them holding
entity e, n_t holding term t and n_te holding both, all counted on whole documents, PMI(t; e) =
log2(N n_te / ((n_t + a)(n_e + a))), smoothed by `a` documents, and its share in the entity's own information
IC(e) = log2(N / n_e) is the disclosure of e by t: near 1 where t stands in the documents of e only, and the nearer the
more documents say so. A term whose disclosure of any entity of a document reaches `generalise` is generalised wherever
it stands in that document, and removed from `remove` on.

Terms are runs of two letters or digits or more, and pairs of characters in scripts without blanks.

Pairs are counted only where counts alone don't give n_te. Exact copies of a text are one text with a weight. An entity
in one text only has n_te = its weight for every term of that text, and so has a term in one text only; both follow from
n_t and n_e. What is left are entities and terms in two texts or more, of which entities with the same set of texts are
one, and pairs that could not reach the threshold with the largest n_te possible are never made. Copies get the same spans,
as terms are laid on each distinct text once.

Defined results: null and empty texts have no spans; repeated rows count as documents of their own and get the same
spans; an entity in all documents has nothing to disclose; terms that touch a base span keep clear of it; other columns are
passed through (operator) or left out (query); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import HOT_SHARE, hot_keys, may_be_hot, row_key, salted_join, stored, table
from tessella.llm._spans import TAGGED, between, clear_of, count_of, cut, folded, let, located, matches, merged, tagged, written

# In each pattern a run of characters is tried from its start or from the last match's end alone: no later start in it
# could match either, and long runs stay cheap. A card is a whole run of digits, so those of other lengths are no matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Terms: pairs of characters of scripts without blanks, and runs of letters, marks and digits of other scripts.
TERM = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{2}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{2,}+"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: Documents that smooth the counts, and shares of an entity's information at which a term is generalised and removed.
SMOOTH, GENERALISE, REMOVE = 0.5, 0.7, 0.9
NAMES = ["email", "ip", "card", "phone"]
TERM_PLACE = len(NAMES) + 1


def luhn(value: Column) -> Column:
    """14 to 19 digits whose check digit fits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    reverse = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns in a struct `row`, the text `x` (null: empty), and `base`: the spans of the patterns."""
    x, none = F.col("x"), F.array().cast("array<string>")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = rows.select(
        "row", "x", F.when(x.contains("@"), matches(x, EMAIL)).otherwise(none).alias("m_email"), matches(x, IP).alias("m_ip"),
        matches(x, CARD).alias("m_card"), F.when(x.contains("+"), matches(x, PHONE)).otherwise(none).alias("m_phone"),
    )
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    kinds = [
        tagged(located(x, F.col("m_email"), EMAIL), "email", 1, lambda v: F.lit(True)),
        tagged(located(x, F.col("m_ip"), IP), "ip", 2, lambda v: v.rlike(IP_PARTS)),
        tagged(located(x, F.col("m_card"), CARD), "card", 3, luhn),
        tagged(located(x, F.col("m_phone"), PHONE), "phone", 4, lambda v: digits(v).between(10, 15)),
    ]
    found = F.size("m_email") + F.size("m_ip") + F.size("m_card") + F.size("m_phone") > 0
    return rows.select("row", "x", F.when(found, F.array_sort(F.concat(*kinds))).otherwise(F.array().cast(TAGGED)).alias("base"))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text. Splitting between words is cheaper than the pattern, which only some scripts need."""
    plain = F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.when(text.rlike(UNSPACED), matches(text, TERM)).otherwise(plain))


def entity(span: Column) -> Column:
    """What names a protected value: its kind, and its digits or its text in lower case."""
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def disclosure(n: Column, n_te: Column, n_t: Column, n_e: Column, smooth: float) -> Column:
    """PMI as a share of the entity's information; 0 where it has none."""
    information = F.log2(n / n_e)
    return F.when(information > 0, F.log2(n * n_te / ((n_t + smooth) * (n_e + smooth))) / information).otherwise(0.0)


def judged(texts: DataFrame, terms: DataFrame, docs: DataFrame, total: int, generalise: float, remove: float, smooth: float) -> DataFrame:
    """(key, term, removed) of the terms of each text that reach a threshold.

    texts: (key, weight, base) of the distinct texts that hold an entity; terms: (key, weight, term), distinct; docs: one
    column `x`, the texts of all documents.
    """
    n = F.lit(float(max(total, 1)))
    n_texts = texts.count()

    def joined(left: DataFrame, right: DataFrame, on: list[str], rows: str, share: int = HOT_SHARE, columns: list[str] | None = None) -> DataFrame[DataFrame, DataFrame]:
        """left joined to columns of right, whose `rows` says how many rows of left have a key: right is written if it is read twice."""
        if not may_be_hot(n_texts):
            return left.join(right.select(*(columns or right.columns)), on)
        right = stored(right, "pii-counts")
        return salted_join(left, right.select(*(columns or right.columns)), on, hot_keys(right, on, rows, n_texts, share))
    held = texts.select("key", "weight", F.explode(F.array_distinct(F.transform("base", entity))).alias("name")).select("key", "weight", row_key(F.col("name")).alias("e"))
    held = stored(held, "pii-entities")
    counts = held.groupBy("e").agg(
        F.sum("weight").alias("n_e"), F.count("*").alias("n_texts"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("mix"),
    )
    held = joined(held, counts, ["e"], "n_texts")
    # Entities with the same texts are one: named by their texts, which their number and two hashes of the texts give.
    held = held.select("key", "n_e", "n_texts", F.struct("n_e", "n_texts", "sum", "mix").alias("c"))
    held = stored(held, "pii-held")
    fewest = held.groupBy("key").agg(F.min("n_e").alias("low"))
    # Terms of all documents; those of many documents are spread, as many texts with entities hold them.
    words = docs.select(F.explode(terms_of(F.lower("x"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    known = terms.groupBy("term").agg(F.sum("weight").alias("n_own"), F.count("*").alias("n_texts")).join(words, "term")
    own = joined(terms.select("key", "weight", "term"), known, ["term"], "n_texts", 64, ["term", "n_t"])
    own = own.join(fewest, "key")
    reach = lambda x, at: x >= at - 1e-9
    own = own.withColumn("least", disclosure(n, F.col("weight"), F.col("n_t"), F.col("low"), smooth))
    own = stored(own, "pii-own")
    plain = own.filter(reach(F.col("least"), generalise)).select("key", "term", reach(F.col("least"), remove).alias("removed"))
    several = held.filter("n_texts > 1").select("key", "c", "n_e").distinct()
    if several.isEmpty():
        return plain
    bound = disclosure(n, F.least("n_t", "n_e"), F.col("n_t"), F.col("n_e"), smooth)
    pairs = own.filter(F.col("n_t") > F.col("weight")).join(several, "key").filter(reach(bound, generalise) & (bound > F.col("least")))
    pairs = stored(pairs.select("key", "c", "term", "weight", "n_t", "n_e"), "pii-pairs")
    met = pairs.groupBy("c", "term").agg(F.sum("weight").alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"), F.count("*").alias("rows"))
    met = met.withColumn("share", disclosure(n, F.col("n_te"), F.col("n_t"), F.col("n_e"), smooth)).filter(reach(F.col("share"), generalise))
    met = stored(met.select("c", "term", "rows", reach(F.col("share"), remove).alias("removed")), "pii-met")
    hot = hot_keys(met, ["c", "term"], "rows", pairs.count())
    told = salted_join(pairs.select("key", "c", "term"), met.drop("rows"), ["c", "term"], hot).select("key", "term", "removed")
    return plain.unionByName(told).groupBy("key", "term").agg(F.max("removed").alias("removed"))


def find_private(
    docs: DataFrame, *, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, smooth: float = SMOOTH
) -> DataFrame:
    """docs' columns in a struct `row`, and arrays of struct(start, place, kind, end, value): `base`, and `spans` with the
    terms that disclose an entity, of kind `term` or `gone` (to be generalised, to be removed)."""
    found = base_spans(docs, text)
    hits = stored(found.filter(F.size("base") > 0).withColumn("key", row_key(F.col("x"))), "pii-hits")
    # Documents without an entity need nothing else.
    none = F.array().cast(TAGGED)
    rest = found.filter(F.size("base") == 0).select("row", none.alias("base"), none.alias("spans"))
    texts = stored(hits.groupBy("key").agg(F.count("*").alias("weight"), F.first(F.struct("x", "base")).alias("t")).select("key", "weight", "t.*"), "pii-texts")
    lower = lambda a: F.transform(a, lambda w: F.lower(w["value"]))
    x = F.col("x")
    placed = stored(texts.select("key", "weight", located(x, matches(x, TERM), TERM).alias("at")), "pii-words")
    terms = placed.select("key", "weight", F.explode(F.array_distinct(lower(F.col("at")))).alias("term"))
    marks = judged(texts.select("key", "weight", "base"), terms, docs.select(F.coalesce(F.col(text), F.lit("")).alias("x")), docs.count(), generalise, remove, smooth)
    words = placed.select("key", F.explode("at").alias("w")).select("key", "w.start", "w.end", F.lower("w.value").alias("term"))
    more = words.join(marks, ["key", "term"]).groupBy("key").agg(
        F.collect_list(F.struct("start", F.lit(TERM_PLACE).alias("place"), F.when(F.col("removed"), "gone").otherwise("term").alias("kind"), "end", F.col("term").alias("value"))).alias("more")
    )
    laid = texts.select("key", "weight", "base").join(more, "key").select("key", "weight", clear_of(F.col("more"), F.col("base"), TERM_PLACE).alias("more"))
    n_hits = hits.count()
    if may_be_hot(n_hits):
        laid = stored(laid, "pii-laid")
        out = salted_join(hits, laid.select("key", "more"), ["key"], hot_keys(laid, ["key"], "weight", n_hits), "left")
    else:
        out = hits.join(laid.select("key", "more"), "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(TAGGED))))
    return out.select("row", "base", spans.alias("spans")).unionByName(rest)


def sanitise(found: DataFrame, *, text: str = "text", into: str = "sanitised") -> DataFrame:
    """The rows of find_private() with a column of the text whose spans are replaced.

    Base spans become their kind in brackets, disclosing terms [word], removed ones nothing. Spans that overlap are one, of
    the kind that begins first. Null texts stay null.
    """
    x = F.col(f"row.{text}")
    mark = lambda k: F.when(k == "gone", "").when(k == "term", "[word]").otherwise(F.concat(F.lit("["), k, F.lit("]")))

    def replaced(ranges: Column) -> Column:
        # A span begins a range, and names it, where no span before it reaches.
        first = folded(
            F.col("spans"), -1, lambda s, y: F.greatest(s, y["end"]), lambda s, y: F.when(y["start"] >= s, mark(y["kind"])), "array<string>"
        )
        marks = F.concat(F.filter(first, lambda y: y.isNotNull()), F.array(F.lit("")))
        pieces = cut(x, between(ranges, F.length(x)))
        return F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), marks.alias("m")), lambda z: F.concat(z["p"], z["m"])), "")

    done = F.when(F.size("spans") == 0, x).otherwise(let(merged(F.col("spans")), replaced))
    return found.withColumn(into, F.when(x.isNotNull(), done))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in NAMES],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
