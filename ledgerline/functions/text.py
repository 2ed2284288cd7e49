"""Text expressions over OCR lines and record fields; all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for "nothing" in record fields and identifiers.
NULL_WORDS = ("none", "null", "n/a", "not specified", "unknown", "")
ID_SENTINELS = ("", "none", "null", "unknown", "na", "notfound", "nil", "unnumbered")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column) -> Column:
    """Lower case, anything but letters, digits and underscores a space, collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


def meaningful(c: Column) -> Column:
    """Trimmed, null where the value only says that there is none."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def identifier(c: Column, shortest: int = 1) -> Column:
    """Letters and digits only, lower case; null for sentinels and short ones."""
    bare = F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    return F.when(~bare.isin(*ID_SENTINELS) & (F.length(bare) >= shortest), bare)


def first_present(*columns: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def agrees(a: Column, b: Column) -> Column:
    """Equal once comparable, or one within the other."""
    return F.coalesce(comparable(a).contains(comparable(b)) | comparable(b).contains(comparable(a)), F.lit(False))


def masked(c: Column) -> Column:
    """Twelve-digit identity numbers masked; never emitted."""
    return F.regexp_replace(c, r"\d{4}[ -]?\d{4}[ -]?\d{4}", "[MASKED]")


# Words of a company's name that don't tell it from others, how
# legal forms are written, and spellings of an identity number's label.
COMPANY_STOP_WORDS = ("m", "s", "pvt", "private", "ltd", "limited", "company", "homes", "developers", "builders")
LEGAL_FORMS = {"pvt": "PVT.", "private": "Private", "ltd": "LTD.", "limited": "Limited"}
IDENTITY_LABELS = ("aadhar", "aadhaar", "adhar", "aadahar", "aadhr")
# Baseline rules of four fields, applied in this order, case ignored.
FIELD_RULES = {
    "survey_number": ((r"\b(?:Sy\.?\s*No\.?|S\.No\.?|SY\.?\s*NOS?)\b", "Survey No"), (r"(?<=\d)\s*\|\s*(?=\d)", ", "), (r"\s+", " ")),
    "property_area": ((r"\b(\d+)O(\d*)\b", "$10$2"), (r"\bO(\d+)\b", "0$1")),
    "document_number": ((r"(\d{3,6})\s*\|\s*(\d{1,4})", "$1/$2"),),
    "mandal": ((r"^GHATKOSAR$", "Ghatkesar"), (r"^QUTBULLAPUR$", "Quthbullapur")),
}


def upper_collapsed(c: Column) -> Column:
    return F.upper(collapse(c))


def titled(c: Column) -> Column:
    """Title case: a letter after anything but a letter is a capital."""
    chars = F.split(F.lower(c), "")
    before = F.concat(F.array(F.lit(" ")), chars)
    return F.array_join(F.zip_with(chars, F.slice(before, F.lit(1), F.size(chars)), lambda x, b: F.when(b.rlike(r"^\p{L}$"), x).otherwise(F.upper(x))), "")


def clean_field(c: Column, title: bool = False) -> Column:
    """Without blanks and separators at the ends, null if nothing is left."""
    bare = F.nullif(F.btrim(c, F.lit(" ,.;:-")), F.lit(""))
    return titled(bare) if title else bare


def clean_address(c: Column) -> Column:
    """Up to an identity number's label or a bracket, house numbers as H.No."""
    label = "|".join(IDENTITY_LABELS)
    cut = F.substring_index(F.regexp_replace(collapse(c), rf"(?i)\b({label})\b", "("), "(", 1)
    return clean_field(F.replace(F.replace(cut, F.lit("H. No."), F.lit("H.No.")), F.lit("H.No.."), F.lit("H.No.")), title=True)


def smart_number(c: Column) -> Column:
    """Without spaces, bars read as slashes."""
    return F.translate(F.regexp_replace(c, r"\s", ""), "|", "/")


def relation(c: Column) -> Column:
    """Title case, with S/o, W/o and D/o however they were written."""
    out = titled(collapse(c))
    for letter in "SWD":
        out = F.regexp_replace(out, rf"\b{letter}/O\.?", f"{letter}/o")
    return F.btrim(out, F.lit(" ,.;:-"))


def first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that gives one; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def core_tokens(c: Column) -> Column:
    """Words of a company's name, without those that most have."""
    words = F.array_distinct(F.split(comparable(c), " "))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMPANY_STOP_WORDS))


def company(c: Column) -> Column:
    """Words in title case, legal forms as they are written, M/s. in front once."""
    bare = F.regexp_replace(collapse(c), r"(?i)^m\s*/\s*s\.?\s*", "")
    forms = F.create_map(*[F.lit(x) for kv in LEGAL_FORMS.items() for x in kv])
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))
    words = F.transform(F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(forms, F.lower(F.rtrim(w, F.lit(".,")))), capital(w)))
    return F.concat(F.lit("M/s. "), F.array_join(words, " "))


def shortened(c: Column, length: int, tail: int = 0) -> Column:
    """The first `length` characters, dots, and the last `tail` of longer texts."""
    end = F.substring(c, -tail, tail) if tail else F.lit("")
    return F.when(F.length(c) > length + tail, F.concat(F.substring(c, 1, length), F.lit("..."), end)).otherwise(c)


def ruled(field: Column, value: Column) -> Column:
    """A value after the baseline rules of its field; fields without rules keep it."""
    out = F.trim(value)
    for name, rules in FIELD_RULES.items():
        fixed = F.trim(value)
        for pattern, new in rules:
            fixed = F.trim(F.regexp_replace(fixed, f"(?i){pattern}", new))
        out = F.when(field == name, fixed).otherwise(out)
    return out


def number_noise(c: Column) -> Column:
    """Upper case, with the characters that scans confuse in numbers repaired."""
    return F.translate(F.upper(c), "OI|\\", "01//")


def file_slug(c: Column) -> Column:
    """Letters and digits kept, anything else a hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def embedded_json(c: Column) -> Column:
    """The object in a model's answer: what stands between the first two fences
    if it is one, else from the first brace to the last, else an empty one."""
    fence = F.lit("```")
    inside = F.trim(F.get(F.split(c, "```"), F.lit(1)))
    inside = F.trim(F.when(F.lower(inside).startswith("json"), F.substring(inside, 5, 2**31 - 1)).otherwise(inside))
    fenced = (F.size(F.split(c, "```")) > 2) & inside.startswith("{") & inside.endswith("}") & F.contains(c, fence)
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    outer = F.when((first > 0) & (last > first), F.substring(c, first, last - first + 1)).otherwise("{}")
    return F.when(fenced, inside).otherwise(outer)
