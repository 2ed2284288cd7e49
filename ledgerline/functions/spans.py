"""Matches with their places in a text: found by one pattern in one scan, looked
at with the characters around them, taken out of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, value: string>>"


def spans(c: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in order; start is the
    number of characters before it. What lies between the matches is what a
    split by the same pattern gives. No match may be empty."""
    between, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda b, h: F.struct(b.alias("b"), h.alias("h")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["b"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value")))).alias("out"))

    return F.aggregate(pairs, state, step, lambda s: s["out"])


def before(c: Column, start: Column, n: int) -> Column:
    """Up to n characters in front of a place."""
    return F.substring(c, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def after(c: Column, end: Column, n: int) -> Column:
    """Up to n characters behind a place."""
    return F.substring(c, end + 1, F.lit(n))


def line_of(c: Column, start: Column) -> Column:
    """Number of the line, from 0, that a place is in."""
    return F.size(F.split(F.substring(c, F.lit(1), start), "\n", -1)) - 1


def without(c: Column, values: Column) -> Column:
    """A text without some values, wherever they occur, case aside; null and
    empty ones are none. The longest goes first, so no part of it goes before."""
    kept = F.filter(values, lambda v: F.coalesce(v != "", F.lit(False)))
    longest = F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(F.size(kept) > 0, F.regexp_replace(c, F.concat(F.lit("(?i)(?:"), F.array_join(quoted, "|"), F.lit(")")), F.lit(""))).otherwise(c)
