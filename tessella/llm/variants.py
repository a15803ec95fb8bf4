"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, an integer that all its anagrams share. Two words that differ by
one letter have keys that differ by the value of the letter added or removed, or by the difference of the two values that
were exchanged: so each word is entered under its key, and under its key less the value of each of its letters, and entries
that meet are candidates. (No two differences of fifth powers of the alphabet's numbers are equal, so a pair meets once.)
Anagrams are many where words are alike; as one edit leaves the letters before it or after it as they were, an entry also
carries the half of the word that the edit leaves alone, once for the first and once for the second half. What meets is then
verified letter by letter. Everything is built-in functions; no entry is longer than its word, a word has at most two for
each of its distinct letters and two more, and all of a word's entries go to different places.

Words that are near to a word at least `lead` times as frequent take the most frequent as their form; forms are followed to
their end by doubling, in as many rounds as the chain's length has binary digits (each step multiplies n by `lead`).

Defined results: null texts have no words; a null id is the empty string in the hash that decides on a deletion; repeated
rows count each; equally frequent forms go by code-point order; very long words are words like others; other columns are
not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import fold, stored, table

#: Letters of a word. Lower case a-z are the numbers 1 to 26 of the alphabet, U+00C0 to U+00FF the numbers 27 to 90.
FIRST_HIGH, LAST_HIGH = 0xC0, 0xFF
LETTERS = f"A-Za-z{chr(FIRST_HIGH)}-{chr(LAST_HIGH)}"
#: A letter's value is its number to this power.
POWER = 5
#: Fewest letters and occurrences of a word, and how many times as frequent its form is.
LEAST_LETTERS, LEAST_COUNT, LEAD = 7, 2, 10
#: One run in so many, by a hash of id and run, loses a letter.
DELETE_ONE_IN = 31


def value(letter: Column) -> Column:
    """The value of a letter as a long; sums over any string stay below the largest long."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < FIRST_HIGH, code - 96).otherwise(code - (FIRST_HIGH - 27))
    out = number
    for _ in range(POWER - 1):
        out = out * number
    return out


def observed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(word): every run of at least `least` letters, folded, less a letter where the hash says so."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run")).withColumn("run", fold(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    return observed(docs, doc_id, text, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def entries(words: DataFrame) -> DataFrame:
    """(word, n, side, half, key, whole): what a word is entered under.

    side 1: `half` hashes the first letters, which an edit behind them leaves alone; side 2: the last ones. The halves are those
    of the word without the letter that is left out, of which `key` sums up the values. whole: no letter is left out.
    """
    letters = F.split("word", "")
    rows = words.select("word", "n", F.length("word").alias("size"), letters.alias("letters"), F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a + value(c)).alias("sum"))

    def halves(size: Column) -> tuple[Column, Column]:
        first = F.ceil(size / 2).cast("int")
        return first, size - first

    def some(of: Column, least: Column, side: int, half: Column, whole: bool) -> Column:
        """Entries of a side for the distinct letters `of` left out."""
        name = F.xxhash64(F.lit(side), least, half)
        return F.transform(of, lambda c: F.struct(F.lit(side).alias("side"), name.alias("half"), (F.col("sum") - value(c)).alias("key"), F.lit(whole).alias("whole")))

    size = F.col("size")
    a, b = halves(size - 1)
    first = some(F.array_distinct(F.slice("letters", a + 1, size)), size - 1, 1, F.substring("word", F.lit(1), a), False)
    last = some(F.array_distinct(F.slice("letters", F.lit(1), size - b)), size - 1, 2, F.right("word", b), False)
    a, b = halves(size)
    alone = [
        F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), size, half).alias("half"), F.col("sum").alias("key"), F.lit(True).alias("whole"))
        for side, half in ((1, F.substring("word", F.lit(1), a)), (2, F.right("word", b)))
    ]
    found = rows.select("word", "n", F.explode(F.concat(first, last, F.array(*alone))).alias("e"))
    return found.select("word", "n", "e.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all words that are one edit apart, each pair in both orders once.

    Both sides of the join are one shuffle of the same entries, which Spark reuses; neither side is filtered before it.
    """
    own = entries(words)
    other = own.select(*[F.col(c).alias(f"_{c}") for c in own.columns])
    meet = (F.col("side") == F.col("_side")) & (F.col("half") == F.col("_half")) & (F.col("key") == F.col("_key"))
    once = ~(F.col("whole") & F.col("_whole")) & (F.col("word") != F.col("_word"))
    near = own.join(other, meet & once)
    # The first side has all pairs that are equal up to the first half; the second takes the others.
    half = F.ceil((F.greatest(F.length("word"), F.length("_word")) - 1) / 2).cast("int")
    left = (F.col("side") == 1) | (F.substring("word", F.lit(1), half) != F.substring("_word", F.lit(1), half))
    near = near.filter(left & (F.levenshtein("word", "_word", 1) == 1))
    return near.select("word", "n", F.col("_word").alias("near"), F.col("_n").alias("near_n"))


def ends(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain of forms, by doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, *, lead: int = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n)."""
    words = stored(words.select("word", "n"), "variant-words")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))).alias("best")
    each = near_pairs(words).unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), best)
    takes = -F.col("best.less") >= lead * F.col("n")
    each = each.select("word", "n", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    each = stored(each, "variant-forms")
    found = each.join(ends(each.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
