"""Places of regular expressions in texts, with built-in functions only, in time that follows the text's length.

Spans are structs of start and end (code points, end exclusive). Arrays of them are folded in chunks of CHUNK, so that a
fold's output is not copied anew for every element: 500,000 spans of one text take seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold appends to one array before a new one is begun, and code points of a text's pieces.
CHUNK, PIECE = 64, 4096
SPAN = "array<struct<start: bigint, end: bigint, value: string>>"
RANGES = "array<struct<start: bigint, end: bigint>>"
FAR = 1 << 60


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used, also inside lambdas. The result is copied once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, zero: int, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before the item, item) of each item in turn; step gives the state after it, a long. kind: type of the result.

    Spark copies a fold's state at each step. So a first fold, whose state is a number, gives the state at the start of
    each chunk, and the chunks then build their outputs, of at most CHUNK elements, on their own.
    """
    long_ = lambda x: x.cast("bigint")

    def whole(chunks: Column) -> Column:
        def after(acc: Column, chunk: Column) -> Column:
            end = F.aggregate(chunk, acc["s"], lambda s, x: long_(step(s, x)))
            return F.struct(end.alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o"))

        states = F.aggregate(chunks, F.struct(long_(F.lit(zero)).alias("s"), F.array().cast("array<bigint>").alias("o")), after)["o"]
        begin = lambda s: F.struct(s.alias("s"), F.array().cast(kind).alias("o"))
        add = lambda a, x: F.struct(long_(step(a["s"], x)).alias("s"), F.concat(a["o"], F.array(emit(a["s"], x))).alias("o"))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), states.alias("s")), lambda z: F.aggregate(z["c"], begin(z["s"]), add)["o"]))

    def cut_up(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(all_) > 0, let(chunks, whole)).otherwise(F.array().cast(kind))

    return let(items, cut_up)


def matches(text: Column, regex: str | Column) -> Column:
    """The leftmost, non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def located(text: Column, found: Column, regex: str | Column) -> Column:
    """Struct(start, end, value) of the matches found: each starts where all pieces and matches before it end."""

    def placed(found: Column) -> Column:
        rows = F.filter(F.arrays_zip(found.alias("m"), F.split(text, regex, -1).alias("p")), lambda x: x["m"].isNotNull())
        sizes = F.transform(rows, lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("n"), x["m"].alias("m")))
        return folded(
            sizes, 0, lambda at, x: at + x["p"] + x["n"],
            lambda at, x: F.struct((at + x["p"]).alias("start"), (at + x["p"] + x["n"]).alias("end"), x["m"].alias("value")), SPAN,
        )

    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast(SPAN)))


def merged(spans: Column) -> Column:
    """Disjoint ranges, in order, that cover the same text as the spans; ranges that only touch stay apart."""
    ranges = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    marked = folded(
        ranges, -1, lambda s, x: F.greatest(s, x["end"]),
        lambda s, x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["start"] >= s).alias("new")), "array<struct<start: bigint, end: bigint, new: boolean>>",
    )
    back = folded(
        F.reverse(marked), 0, lambda s, x: F.when(x["new"], F.lit(0).cast("bigint")).otherwise(F.greatest(s, x["end"])),
        lambda s, x: F.when(x["new"], F.struct(x["start"].alias("start"), F.greatest(s, x["end"]).alias("end"))), RANGES,
    )
    return F.reverse(F.filter(back, lambda x: x.isNotNull()))


def between(ranges: Column, length: Column) -> Column:
    """The ranges of a text of this length that disjoint ranges leave uncovered: one before each of them and one at the end."""
    ends = F.concat(ranges, F.array(F.struct(length.cast("bigint").alias("start"), length.cast("bigint").alias("end"))))
    return folded(ends, 0, lambda s, x: x["end"], lambda s, x: F.struct(s.alias("start"), x["start"].alias("end")), RANGES)


def cut(text: Column, ranges: Column) -> Column:
    """The text of each range, found in pieces of PIECE code points: a far place costs no more than a near one."""

    def part(pieces: Column, r: Column) -> Column:
        from_, to = (lambda c: F.greatest(r["start"] - c * PIECE, F.lit(0))), (lambda c: F.least(r["end"] - c * PIECE, F.lit(PIECE)))
        some = F.sequence(F.floor(r["start"] / PIECE), F.floor((r["end"] - 1) / PIECE))
        inside = F.transform(some, lambda c: F.substring(F.get(pieces, c.cast("int")), (from_(c) + 1).cast("int"), (to(c) - from_(c)).cast("int")))
        return F.when(r["end"] > r["start"], F.array_join(inside, "")).otherwise("")

    return let(matches(text, "(?s).{1,%d}" % PIECE), lambda p: F.transform(ranges, lambda r: part(p, r)))


def tagged(spans: Column, kind: str, place: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of a kind whose values pass; `place` orders kinds that start together."""
    return F.transform(
        F.filter(spans, lambda x: keep(x["value"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")),
    )


TAGGED = "array<struct<start: bigint, place: int, kind: string, end: bigint, value: string>>"


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def clear_of(spans: Column, others: Column, place: int) -> Column:
    """Those tagged spans that overlap none of the others; `place` is the spans' own, and beyond that of the others."""
    kind = "array<struct<x: struct<start: bigint, place: int, kind: string, end: bigint, value: string>, bad: boolean>>"
    flag = lambda x, bad: F.struct(x.alias("x"), bad.alias("bad"))
    one_way = folded(
        F.array_sort(F.concat(others, spans)), 0, lambda s, x: F.when(x["place"] < place, F.greatest(s, x["end"])).otherwise(s),
        lambda s, x: flag(x, x["start"] < s), kind,
    )
    both = folded(
        F.reverse(one_way), FAR, lambda s, y: F.when(y["x"]["place"] < place, F.least(s, y["x"]["start"])).otherwise(s),
        lambda s, y: flag(y["x"], y["bad"] | (y["x"]["end"] > s)), kind,
    )
    return F.reverse(F.transform(F.filter(both, lambda y: (y["x"]["place"] >= place) & ~y["bad"]), lambda y: y["x"]))
