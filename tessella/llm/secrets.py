"""Secret scans, with built-in functions only.

Base kinds are patterns (assignments, access keys, long hex). The method then takes candidate strings in the text between
base spans, and in each the runs of every character class (hex, base32, letters, alphanumeric, base64). Over a run slides a
window, whose Shannon entropy is kept by incremental counts: a table with one place for each character of the class, of
which a step changes two, the one that leaves and the one that enters. Windows that reach the class's bits are random; what
they cover, over all classes, is a secret, unless the allow-list knows it. The work is a projection: no shuffle and no state
beyond a row.

Defined results: null and empty texts have no spans; repeated rows get the same result each; texts of any length are
scanned whole, in time that follows their length; other columns are passed through (operator) or left out (query); an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table
from tessella.llm._spans import RANGES, SPAN, TAGGED, between, count_of, cut, let, located, matches, merged, tagged, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
#: Runs of 32 hex digits and more; shorter runs fail as a whole, so none is retried inside.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Candidates: runs of the characters of all classes.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Window positions that are worked through in one go.
PIECE = 192


@dataclass(frozen=True)
class CharClass:
    """Runs of an alphabet's characters, at least a window long, that hold one of each of `needs`; `bits` a character make
    a window random."""

    alphabet: str
    run: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()


#: Bits are set so that words of prose, also joined ones, stay below. Of random strings of 30 characters all but a few have a
#: window above; of those of one case's letters, which are nearest to words, about 87 in 100.
CLASSES = [
    CharClass(digits + "abcdef", r"(?<![0-9a-f])[0-9a-f]{20,}+", 20, 3.0, ("[0-9]", "[a-f]")),
    CharClass(digits + "ABCDEF", r"(?<![0-9A-F])[0-9A-F]{20,}+", 20, 3.0, ("[0-9]", "[A-F]")),
    CharClass(ascii_uppercase + "234567", r"(?<![A-Z2-7])[A-Z2-7]{20,}+", 20, 3.5, ("[2-7]", "[A-Z]")),
    CharClass(ascii_lowercase, r"(?<![a-z])[a-z]{20,}+", 20, 3.65),
    CharClass(ascii_uppercase, r"(?<![A-Z])[A-Z]{20,}+", 20, 3.65),
    CharClass(ascii_letters, r"(?<![A-Za-z])[A-Za-z]{20,}+", 20, 4.0, ("[a-z]", "[A-Z]")),
    CharClass(ascii_letters + digits, r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+", 20, 3.75, ("[0-9]", "[A-Za-z]")),
    CharClass(ascii_letters + digits + "+/_=-", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 20, 3.9, ("[0-9]", "[A-Za-z]")),
    # Strings under 20 characters stand by themselves and hold all three kinds.
    CharClass(ascii_letters + digits, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{16,19}+(?![A-Za-z0-9+/_=-])", 16, 3.6, ("[0-9]", "[a-z]", "[A-Z]")),
]
#: Strings that look random and are none: samples, UUIDs, alphabets, checksums that say so. Patterns that begin with ^ are
#: for whole candidates, others for spans.
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij",
    r"^(?i:sha(1|256|384|512))[-_=]",
]
ENTROPY_PLACE = 4


def as_column(c: CharClass) -> Column:
    kinds = F.array(*[F.lit(n) for n in c.needs]).cast("array<string>")
    return F.struct(F.lit(c.alphabet).alias("alphabet"), F.lit(c.run).alias("run"), F.lit(c.window).alias("window"), F.lit(c.bits).alias("bits"), kinds.alias("needs"))


def marked_windows(text: Column, weights: Column, c: Column) -> Column:
    """A digit for each window of a piece of a run: 1 where it is random. text, c: fields of a lambda's variable.

    A count is a character of the table `counts`, at the place that the counted character has in the alphabet.
    """
    w = c["window"]
    place = lambda ch: F.position(ch, c["alphabet"])
    count = lambda state, ch: F.ascii(F.substring(state["counts"], place(ch), F.lit(1))) - 48
    put = lambda state, ch, k: F.overlay(state["counts"], F.char(k + 48), place(ch), F.lit(1))
    weight = lambda k: F.element_at(weights, k + 1)

    def changed(state: Column, ch: Column, by: int) -> Column:
        """The state after a character's count, and so the sum of k log2 k, changed by one."""
        return let(count(state, ch), lambda k: F.struct(
            put(state, ch, k + by).alias("counts"), (state["sum"] - weight(k) + weight(k + by)).alias("sum"), state["hot"].alias("hot")
        ))

    def judged(state: Column) -> Column:
        random = F.log2(w) - state["sum"] / w >= c["bits"] - 1e-9
        return F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"), F.concat(state["hot"], F.when(random, "1").otherwise("0")).alias("hot"))

    chars = lambda from_, n: F.split(F.substring(text, from_, n), "")
    empty = F.struct(F.repeat(F.lit("0"), F.length(c["alphabet"])).alias("counts"), F.lit(0.0).alias("sum"), F.lit("").alias("hot"))
    first = F.aggregate(chars(F.lit(1), w), empty, lambda state, ch: changed(state, ch, 1), judged)
    steps = F.arrays_zip(chars(F.lit(1), F.length(text) - w).alias("gone"), chars(w + 1, F.length(text)).alias("come"))
    steps = F.when(F.length(text) > w, steps).otherwise(F.array().cast("array<struct<gone: string, come: string>>"))
    slide = lambda state, ch: let(changed(state, ch["gone"], -1), lambda s: let(changed(s, ch["come"], 1), judged))
    return F.aggregate(steps, first, slide, lambda state: state["hot"])


def random_ranges(rows: DataFrame) -> DataFrame:
    """rows with `random`: ranges of the text that random windows of any class cover. rows has `candidates`, placed in the text.

    A run is cut into pieces that overlap by a window less one character: every window is in one piece, and no piece's
    state grows with the run. The classes are an array of literals, so that one expression serves them all; each step is a
    column of its own, so that none is nested too deep to be resolved.
    """
    kept, some = rows.columns, F.size("candidates") > 0
    classes = F.array(*[as_column(c) for c in CLASSES])

    def runs_of(c: Column) -> Column:
        own = F.transform("candidates", lambda x: F.transform(
            located(x["value"], matches(x["value"], c["run"]), c["run"]), lambda r: F.struct((x["start"] + r["start"]).alias("start"), r["value"].alias("value"), c.alias("c"))
        ))
        return F.filter(F.flatten(own), lambda r: F.forall(c["needs"], lambda n: F.rlike(r["value"], n)))

    def pieces(r: Column) -> Column:
        w = r["c"]["window"]
        starts = F.sequence(F.lit(0), F.floor((F.length(r["value"]) - w) / PIECE).cast("int"))
        return F.transform(starts, lambda k: F.struct((r["start"] + k * PIECE).alias("start"), F.substring(r["value"], k * PIECE + 1, w + (PIECE - 1)).alias("text"), r["c"].alias("c")))

    rows = rows.withColumn("runs", F.when(some, F.flatten(F.transform(classes, runs_of))))
    rows = rows.withColumn("pieces", F.flatten(F.transform("runs", pieces))).drop("runs")
    weights = F.array(*[F.lit(k * log2(k) if k else 0.0) for k in range(max(c.window for c in CLASSES) + 1)])
    marked = lambda v: F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["c"]["window"].alias("window"), marked_windows(p["text"], v, p["c"]).alias("hot")))
    rows = rows.withColumn("marked", F.when(F.size("pieces") > 0, let(weights, marked))).drop("pieces")
    covered = lambda m: F.transform(
        located(m["hot"], matches(m["hot"], "1+"), "1+"), lambda h: F.struct((m["start"] + h["start"]).alias("start"), (m["start"] + h["end"] + (m["window"] - 1)).alias("end"))
    )
    rows = rows.withColumn("random", F.coalesce(F.flatten(F.transform("marked", covered)), F.array().cast(RANGES)))
    return rows.select(*kept, merged(F.col("random")).alias("random"))


def entropy_spans(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """(row, base, more): the random parts of the text `x` between base spans, as tagged spans of kind `entropy`."""
    known = lambda v, some: reduce(lambda a, b: a | b, [v.rlike(a) for a in some], F.lit(False))
    of_all, of_span = [a for a in allowed if a[0] == "^"], [a for a in allowed if a[0] != "^"]
    x, none = F.col("x"), F.array().cast(SPAN)
    whole = F.array(F.struct(x.alias("p"), F.struct(F.lit(0).cast("bigint").alias("start"), F.length(x).cast("bigint").alias("end")).alias("g")))
    cut_out = let(between(merged(F.col("base")), F.length(x)), lambda g: F.arrays_zip(cut(x, g).alias("p"), g.alias("g")))
    rows = rows.withColumn("gaps", F.when(F.size("base") > 0, cut_out).otherwise(whole))
    moved = lambda at, s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value"))
    found = F.flatten(F.transform("gaps", lambda z: F.transform(located(z["p"], matches(z["p"], CANDIDATE), CANDIDATE), lambda s: moved(z["g"]["start"], s))))
    rows = rows.withColumn("candidates", F.filter(found, lambda s: ~known(s["value"], of_all))).drop("gaps")
    rows = random_ranges(rows)
    spans = F.transform(F.arrays_zip(F.col("random").alias("r"), cut(x, F.col("random")).alias("v")), lambda z: F.struct(z["r"]["start"].alias("start"), z["r"]["end"].alias("end"), z["v"].alias("value")))
    rows = rows.withColumn("found", F.when(F.size("random") > 0, spans).otherwise(none))
    keep = lambda v: ~known(v, of_span)
    return rows.select("row", "base", tagged(F.col("found"), "entropy", ENTROPY_PLACE, keep).alias("more"))


def scan_secrets(docs: DataFrame, *, text: str = "text", allowed: list[str] = ALLOWED) -> DataFrame:
    """docs' columns in a struct `row`, and `base` and `spans`: arrays of struct(start, place, kind, end, value)."""
    x, none = F.col("x"), F.array().cast("array<string>")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = rows.select(
        "row", "x", matches(x, ASSIGN).alias("m_assign"),
        F.when(x.contains("AKIA"), matches(x, ACCESS)).otherwise(none).alias("m_access"), matches(x, HEX).alias("m_hex"),
    )
    kinds = [
        tagged(located(x, F.col("m_assign"), ASSIGN), "assign", 1, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 8),
        tagged(located(x, F.col("m_access"), ACCESS), "access", 2, lambda v: F.length(v) >= 16),
        tagged(located(x, F.col("m_hex"), HEX), "hex", 3, lambda v: F.length(v) >= 32),
    ]
    found = F.size("m_assign") + F.size("m_access") + F.size("m_hex") > 0
    rows = rows.select("row", "x", F.when(found, F.array_sort(F.concat(*kinds))).otherwise(F.array().cast(TAGGED)).alias("base"))
    return entropy_spans(rows, allowed).select("row", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "row.doc_id", count_of(base, "assign").alias("n_assign"), count_of(base, "access").alias("n_access"),
        count_of(base, "hex").alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
