"""Spans of regular expressions as columns, without Python.

`regexp_extract_all` gives the matches and `split` the text between them, so the
lengths of both, added up, are the places. All places are code points, the end
is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str | Column, kind: str, group: int = 0) -> Column:
    """array<struct<kind, start, end, body>> of the leftmost non-overlapping matches, in order.

    `body` is the given group. A pattern must not match the empty string.
    """
    raw = F.lit(pattern)
    whole = F.transform(F.regexp_extract_all(text, raw, 0), F.length)
    bodies = F.regexp_extract_all(text, raw, group)
    gaps = F.transform(F.split(text, raw, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: g + w)
    places = F.zip_with(running(steps), whole, lambda e, w: F.struct((e - w).alias("start"), e.alias("end")))
    return F.zip_with(
        places,
        bodies,
        lambda p, b: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), b.alias("body")),
    )


def running(numbers: Column) -> Column:
    """The sum up to each number, itself included.

    An array grows by being copied, so sums are made in blocks as long as there are blocks: n^1.5 copies, not n^2.
    """

    def summed(some: Column, first: Column) -> Column:
        return F.aggregate(some, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def made(values: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(values))).cast("int")
        starts = F.sequence(F.lit(0), F.size(values) - 1, block)
        totals = F.transform(starts, lambda s: F.aggregate(F.slice(values, s + 1, block), F.lit(0), lambda acc, x: acc + x))
        before = summed(totals, F.lit(0))
        return F.flatten(F.transform(starts, lambda s, i: F.slice(summed(F.slice(values, s + 1, block), F.get(before, i)), F.lit(2), block)))

    none = F.array().cast("array<int>")
    return let(numbers, lambda values: F.when(F.size(values) > 0, made(values)).otherwise(none))


NONE = "array<struct<kind:string,start:int,end:int,body:string>>"


def where_any(text: Column, test: Column, found: Column) -> Column:
    """`found` where the cheap test holds, else no spans."""
    return F.when(test, found).otherwise(F.array().cast(NONE))


def said(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(found: Column, kinds: tuple[str, ...], by_kind_first: bool) -> Column:
    """Spans by start and kind as listed, or the other way round."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")

    def key(s: Column) -> Column:
        parts = [rank(s).alias("k"), s["start"].alias("s")]
        first = parts if by_kind_first else parts[::-1]
        return F.struct(*first, s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"))

    return F.transform(F.array_sort(F.transform(found, key)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body")))


def non_overlapping(found: Column) -> Column:
    """Spans in order of start, joined where they overlap or touch: array<struct<start, end>>."""
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        head = F.slice(acc, 1, F.size(acc) - 1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return (
            F.when(F.size(acc) == 0, F.array(one))
            .when(F.try_element_at(acc, F.lit(-1))["end"] >= s["start"], F.concat(head, F.array(joined)))
            .otherwise(F.concat(acc, F.array(one)))
        )

    return F.aggregate(F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), zero, step)


def replaced(text: Column, found: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each stretch of spans replaced by what `by` gives for the first span in it."""

    def joined(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["by"].alias("by"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    each = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by"))))
    stretches = F.aggregate(each, F.array().cast("array<struct<start:int,end:int,by:string>>"), joined)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, s["by"])).alias("parts"))

    done = F.aggregate(stretches, start, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.concat(done["parts"], F.array(rest)), ""))
