"""Stamp blocks: what the stamp on a page says, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, titled

# Wording that shows a stamp, and denominations in words.
STAMP_WORDS = "hundred rupees|100 ?rs|rs\\. ?100|stamp|serial|purchased by|sold to"
IN_WORDS = {"hundred rupees": "Rs. 100", "fifty rupees": "Rs. 50", "twenty rupees": "Rs. 20", "ten rupees": "Rs. 10"}

_DIGITS = r"[0-9]{1,3}\s*,\s*[0-9]{3}|[0-9]{4,6}"
_SERIAL = rf"(?i)(?<!C\.)\b(?:serial|sl\.?|s)\s*\.?\s*(?:no\.?|number)?\s*[:-]?\s*({_DIGITS})\b"


def serial(c: Column) -> Column:
    """A serial as it is written with thousands parted; null stays null."""
    digits = F.regexp_replace(c, r"[\s,]", "")
    return F.when(digits != "", F.format_number(digits.try_cast("long"), 0))


def stamp_blocks(lines: DataFrame) -> DataFrame:
    """(doc, page, ordinal, text) -> doc, page, serial, labelled, denomination,
    purchased_by, for_whom, score: one row per page that shows a stamp.

    Every figure is that of the page's first line that gives one. A number
    without a label stands for the serial only where no line of that page has
    a labelled one, so a neighbouring page's stamp never lends its number. A
    purchaser has two words at least; it is for oneself unless said."""
    text = F.col("text")
    low = F.lower(text)
    some = lambda c: F.nullif(c, F.lit(""))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("ordinal", c.alias("v"))))["v"]
    stop = r"(?i)\s+(?:s/o|w/o|d/o|r/o|for whom|for)\b.*$"
    buyer = F.btrim(F.regexp_replace(F.regexp_extract(text, r"(?i)purchased\s+by\s*[:.-]?\s*(.+)", 1), stop, ""), F.lit(" .,;:-"))
    buyer = F.when(F.size(F.split(collapse(buyer), " ")) >= 2, titled(collapse(buyer)))
    whom = some(F.btrim(F.regexp_extract(text, r"(?i)for\s+whom\s*[:.-]?\s*(.+)", 1), F.lit(" .,;:-")))
    worded = F.coalesce(*[F.when(low.contains(w), F.lit(v)) for w, v in IN_WORDS.items()])
    figure = F.concat(F.lit("Rs. "), some(F.coalesce(some(F.regexp_extract(low, r"\brs\.?\s*([0-9]{2,5})\b", 1)), some(F.regexp_extract(low, r"\b([0-9]{2,5})\s*rs\b", 1)))))
    out = lines.groupBy("doc", "page").agg(
        F.bool_or(low.rlike(STAMP_WORDS)).alias("stamp"), first(some(F.regexp_extract(text, _SERIAL, 1))).alias("told"),
        first(some(F.regexp_extract(text, rf"\b({_DIGITS})\b", 1))).alias("bare"), first(F.coalesce(figure, worded)).alias("denomination"),
        first(buyer).alias("purchased_by"), first(whom).alias("for_whom"),
    ).where("stamp")
    return out.select(
        "doc", "page", serial(F.coalesce("told", "bare")).alias("serial"), F.col("told").isNotNull().alias("labelled"), "denomination", "purchased_by",
        F.coalesce("for_whom", F.lit("Self")).alias("for_whom"), F.round(1.0 - (F.col("page") - 1) * 0.02, 4).alias("score"),
    )
