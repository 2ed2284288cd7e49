"""Dominant script of a line, by counts of characters in Unicode ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges in the order in which ties are decided.
SCRIPTS = {
    "Telugu": "[ఀ-౿]",
    "Devanagari": "[ऀ-ॿ]",
    "Kannada": "[ಀ-೿]",
    "Tamil": "[஀-௿]",
    "Arabic": "[؀-ۿ]",
    "Latin": "[A-Za-z]",
}


_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Languages of scripts, and the orders in which pages and documents list them.
LANGUAGE = {"Telugu": "Telugu", "Devanagari": "Hindi", "Kannada": "Kannada", "Tamil": "Tamil", "Arabic": "Urdu", "Latin": "English"}
DOCUMENT_LANGUAGES = ("Telugu", "Hindi", "Kannada", "Tamil", "English")


def script_counts(c: Column) -> Column:
    """Characters of each script, in the order of SCRIPTS; 0 of a null text. A
    text of single bytes is Latin only, so the other scripts aren't looked for."""
    c = F.coalesce(c, F.lit(""))
    latin = F.length(c) - F.length(F.translate(c, _LATIN, ""))
    others = [F.regexp_count(c, F.lit(r)) for name, r in SCRIPTS.items() if name != "Latin"]
    none = F.array(*[F.lit(0)] * len(others))
    return F.concat(F.when(F.octet_length(c) == F.length(c), none).otherwise(F.array(*others)), F.array(latin))


def dominant_script(c: Column) -> Column:
    return largest_script(script_counts(c))


def largest_script(counts: Column) -> Column:
    """The script of most characters, ties by order; Unknown where none has any."""
    most = F.array_max(counts)
    names = F.array(*map(F.lit, SCRIPTS))
    return F.when(most == 0, "Unknown").otherwise(F.element_at(names, F.array_position(counts, most).cast("int")))


def language_of(script: Column, context: Column) -> Column:
    """Language of a line's script; Devanagari is Marathi where the context
    says so, and Hindi else."""
    named = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    marathi = (script == "Devanagari") & F.coalesce(F.lower(context).rlike("marathi|maharashtra"), F.lit(False))
    return F.when(marathi, "Marathi").otherwise(F.coalesce(F.try_element_at(named, script), F.lit("Unknown")))


def page_languages(counts: Column, context: Column) -> Column:
    """struct(languages, primary) of a page's summed script counts."""
    names = list(SCRIPTS)
    present = F.array_compact(F.array(*[F.when(counts[i] > 0, language_of(F.lit(n), context)) for i, n in enumerate(names)]))
    return F.struct(present.alias("languages"), language_of(largest_script(counts), context).alias("primary"))


def document_languages(counts: Column) -> Column:
    """The listed languages of a document: five, Devanagari always as Hindi."""
    at = {LANGUAGE[n]: i for i, n in enumerate(SCRIPTS)}
    return F.array_compact(F.array(*[F.when(counts[at[n]] > 0, n) for n in DOCUMENT_LANGUAGES]))


def extractor_language(c: Column) -> Column:
    """te if any Telugu character occurs, else en."""
    return F.when(F.coalesce(c.rlike(SCRIPTS["Telugu"]), F.lit(False)), "te").otherwise("en")


def told_value(value: Column, context: Column) -> Column:
    """struct(value, script, language) of a field's value."""
    script = dominant_script(value)
    return F.struct(value.alias("value"), script.alias("script"), language_of(script, context).alias("language"))
