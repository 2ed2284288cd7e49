"""Dates as deeds write them; null where nothing fits, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted orders of year, month and day, and how each looks.
NUMERIC_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# An execution clause, and three numbers that can be a date.
CLAUSE = r"(?:executed|execution|execute|entered\s+into|made|deed\s+of\s+sale)\s+(?:on\s+)?(?:this\s+)?(?:the\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+day\s+of\s+([a-z]+)[\s\-/,]+(\d{4})"
TOKEN = r"(\d{1,2})\D+(\d{1,2})\D+(\d{2,4})"


def numeric_date(c: Column) -> Column:
    """Date of a text in one of the four numeric forms. Only the form that a
    text looks like is parsed, since each failure costs an exception."""
    bare = F.trim(c)
    return F.coalesce(*[F.when(bare.rlike(look), F.try_to_timestamp(bare, F.lit(f))) for f, look in NUMERIC_FORMATS.items()]).cast("date")


def _month(name: Column) -> Column:
    """Two digits of a month's name, of its first three letters, or of a way in
    which scans misread October; null of other words."""
    word = F.translate(F.lower(name), "0", "o")
    whole = F.array_position(F.array(*map(F.lit, MONTHS)), word)
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.when(word == "sept", "sep").otherwise(word))
    misread = F.when(word.rlike("oct|ocl|act"), 10)
    return F.lpad(F.coalesce(F.nullif(whole, F.lit(0)), F.nullif(short, F.lit(0)), misread).cast("string"), 2, "0")


def _joined(day: Column, month: Column, year: Column) -> Column:
    """dd-MM-yyyy where the day can be one; the calendar isn't consulted further."""
    fits = day.try_cast("int").between(1, 31) & month.isNotNull()
    return F.when(fits, F.concat_ws("-", F.lpad(day, 2, "0"), month, year))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


# day, "th", "day of" or "of", a word, a year
_SPOKEN = r"(?i)\b\d{1,2}\s*(?:st|nd|rd|th)?\s*(?:day\s+of|day|of)?\s*[a-z0]+[ ,.\-]+\d{4}\b"
_NUMBERS = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"


def written_date(c: Column) -> Column:
    """dd-MM-yyyy of the first date in words in a text: "15th day of October,
    2003", "15th October 2003" or "15 Oct 2003"; underscores are blanks. Days
    beyond 31 and words that are no month are passed over."""

    def spoken(x: Column) -> Column:
        form = r"(?i)^(\d{1,2})\s*(?:st|nd|rd|th)?\s*(?:day\s+of|day|of)?\s*([a-z0]+)[ ,.\-]+(\d{4})$"
        return _joined(F.regexp_extract(x, form, 1), _month(F.regexp_extract(x, form, 2)), F.regexp_extract(x, form, 3))

    return _first(F.transform(F.regexp_extract_all(F.translate(c, "_", " "), F.lit(_SPOKEN), F.lit(0)), spoken))


def any_date(c: Column) -> Column:
    """A date in words, else the first in numbers."""

    def numeric(x: Column) -> Column:
        part = F.split(x, "[-/.]")
        return F.when(part[1].try_cast("int").between(1, 12), _joined(part[0], F.lpad(part[1], 2, "0"), part[2]))

    return F.coalesce(written_date(c), _first(F.transform(F.regexp_extract_all(c, F.lit(_NUMBERS), F.lit(0)), numeric)))


def execution_date(c: Column) -> Column:
    """dd-MM-yyyy of the clause that says when a deed was executed, entered
    into or made; null if its blanks were never filled."""
    day, month, year = (F.regexp_extract(F.translate(c, "_", " "), f"(?i){CLAUSE}", i) for i in (1, 2, 3))
    return _joined(day, _month(month), year)


def date_token(c: Column) -> Column:
    """dd-MM-yyyy of the first three numbers that can be day, month and year;
    years of two digits are of this century."""
    day, month, year = (F.regexp_extract(c, TOKEN, i) for i in (1, 2, 3))
    return F.when(c.rlike(TOKEN), F.concat_ws("-", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))


def labelled_date(c: Column, *labels: str) -> Column:
    """`date_token` within twenty characters after the first label that has one."""
    found = [F.nullif(F.regexp_extract(c, rf"(?i)\b{label}\b[^\d]{{0,20}}(\d{{1,2}}\D+\d{{1,2}}\D+\d{{2,4}})", 1), F.lit("")) for label in labels]
    return F.coalesce(*[date_token(x) for x in found])


def document_date(c: Column) -> Column:
    """A labelled date, else the first numeric one anywhere."""
    return F.coalesce(labelled_date(c, "dated", "date"), date_token(F.nullif(F.regexp_extract(c, _NUMBERS, 0), F.lit(""))))


def utc_time(c: Column) -> Column:
    """Instant of an ISO text; without a zone it is UTC. Null if it is none."""
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, c).otherwise(F.concat(c, F.lit("Z"))))


def shown(ts: Column) -> Column:
    """struct(day, time) as screens show them; a dash where there is none."""
    return F.struct(F.coalesce(F.date_format(ts, "dd MMM yyyy"), F.lit("-")).alias("day"), F.coalesce(F.date_format(ts, "HH:mm"), F.lit("-")).alias("time"))


def full_year(c: Column) -> Column:
    """d-m-yy and d-m-yyyy tokens with any of . / - between, as d-m-yyyy; years
    of two digits are of this century."""
    form = r"^\s*(\d{1,2})[-./](\d{1,2})[-./](\d{2}|\d{4})\s*$"
    day, month, year = (F.regexp_extract(c, form, i) for i in (1, 2, 3))
    return F.when(c.rlike(form), F.concat_ws("-", day, month, F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))
