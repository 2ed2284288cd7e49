"""Canonical payloads of extracted records, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from .checks import check, critical

# What the canonical payload holds, and where it is looked for besides its own place.
DOCUMENT_FIELDS = ("document_type", "document_number", "document_date", "execution_date", "stamp_number", "stamp_value")
PROPERTY_FIELDS = ("survey_number", "area", "village", "district", "mandal")
STAMP_FIELDS = ("stamp_number", "stamp_value", "sold_to")
PARTY_ALIASES = {
    "name": ("name", "party_name", "full_name"), "relation": ("relation", "father_name", "spouse_name"),
    "role": ("role", "party_role", "type"), "address": ("address", "residence"),
}
CORE_FIELDS = (
    "document_type", "document_number", "survey_number", "sub_survey_number", "property_area", "village", "mandal", "district",
    "stamp_serial_number", "stamp_value", "stamp_sold_to", "document_date", "execution_date",
)
PRESENCE_ONLY = ("property_area", "stamp_value")  # a zero counts here


_PLACES = ", ".join(f"{f}: string" for f in PROPERTY_FIELDS)
_STAMPS = ", ".join(f"{f}: string" for f in STAMP_FIELDS)
_TOP = dict.fromkeys((*DOCUMENT_FIELDS, *PROPERTY_FIELDS, *[f"property_{f}" for f in PROPERTY_FIELDS], *STAMP_FIELDS, *[f"stamp_{f}" for f in STAMP_FIELDS], "parties", "parties_list"))
# All that is ever looked for in a raw record; values of other types come as their JSON text.
RAW = f"struct<{', '.join(f'{f}: string' for f in _TOP)}, property: struct<{_PLACES}>, stamp_information: struct<{_STAMPS}>>"


def field_value(raw: Column, *paths: str) -> Column:
    """The first of some dotted paths of a parsed record that is there and
    isn't blank, trimmed."""

    def at(path: str) -> Column:
        c = raw
        for name in path.split("."):
            c = c[name]
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(*map(at, paths))


_PARTY = "struct<" + ", ".join(f"{a}: string" for names in PARTY_ALIASES.values() for a in names) + ">"


def parties(record: Column) -> Column:
    """array<struct<name, relation, role, address>> of a record's parties: a
    list, a list written as text, or lists by role, whose name is the role of
    parties that don't say; anything else is an empty list."""
    raw = F.coalesce(record["parties"], record["parties_list"])
    listed = F.from_json(F.when(F.trim(raw).startswith("["), raw), f"array<{_PARTY}>")
    by_role = F.from_json(F.when(F.trim(raw).startswith("{"), raw), f"map<string, array<{_PARTY}>>")
    named = lambda p, names: F.coalesce(*[F.nullif(F.trim(p[n]), F.lit("")) for n in names])

    def party(p: Column, role: Column) -> Column:
        found = {k: named(p, names) for k, names in PARTY_ALIASES.items()}
        # a role that is there but blank isn't taken from the list's name
        own = F.when(p["role"].isNull(), role).otherwise(found["role"])
        return F.struct(*[(F.coalesce(found["role"], own) if k == "role" else v).alias(k) for k, v in found.items()])

    flat = F.flatten(F.transform(F.map_entries(by_role), lambda e: F.transform(e["value"], lambda p: party(p, e["key"]))))
    none = F.array().cast("array<struct<name: string, relation: string, role: string, address: string>>")
    return F.coalesce(F.transform(listed, lambda p: party(p, F.lit(None).cast("string"))), flat, none)


def payload(json: Column) -> Column:
    """The canonical payload of a raw record: document fields, parties,
    property and stamp_information. Stamp numbers and values are found at the
    top or in stamp_information, and are the same in both places.

    The text is parsed once: the record is bound by a `transform` over one
    element, since a struct of `from_json` would be parsed again, pruned, for
    each of its fields. Text that is no object has none of them; looking at it
    first also keeps what builds it out of the `transform`."""
    records = F.array(F.from_json(F.when(F.ltrim(json).startswith("{"), json), RAW))
    return F.get(F.transform(records, _payload), F.lit(0))


def _payload(raw: Column) -> Column:
    place = {f: field_value(raw, f"property.{f}", f, f"property_{f}") for f in PROPERTY_FIELDS}
    top = {f: field_value(raw, f, *([f"stamp_information.{f}"] if f in STAMP_FIELDS else [])) for f in DOCUMENT_FIELDS}
    stamp = {f: field_value(raw, f"stamp_information.{f}", f, f"stamp_{f}") for f in STAMP_FIELDS}
    for f in set(top) & set(stamp):
        top[f], stamp[f] = F.coalesce(top[f], stamp[f]), F.coalesce(stamp[f], top[f])
    struct = lambda d: F.struct(*[d[k].alias(k) for k in sorted(d)])
    return struct(top | {"parties": parties(raw), "property": struct(place), "stamp_information": struct(stamp)})


def canonical(p: Column) -> Column:
    """JSON of a payload, keys sorted, nulls kept: the bytes that are sealed."""
    return F.to_json(p, {"ignoreNullFields": "false"})


def populated(values: dict[str, Column], party_count: Column) -> Column:
    """Names of the fields that a record has, in order, parties last."""
    has = lambda name, c: c.isNotNull() if name in PRESENCE_ONLY else F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    names = [F.when(has(n, values[n]), F.lit(n)) for n in CORE_FIELDS if n in values]
    return F.array_compact(F.array(*names, F.when(party_count > 0, F.lit("parties"))))


def is_land_record(values: dict[str, Column], party_count: Column) -> Column:
    """Whether any core field is there; parties alone never make a land record."""
    return F.size(F.array_remove(populated(values, party_count), "parties")) > 0


def missing_fields(p: Column) -> Column:
    """Required fields that a payload lacks, in order."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wanted = [
        ("document_type", blank(p["document_type"])), ("document_number", blank(p["document_number"])), ("parties", F.size(p["parties"]) == 0),
        ("property.survey_number", blank(p["property"]["survey_number"])), ("property.area", p["property"]["area"].isNull()),
        ("property.village", blank(p["property"]["village"])), ("property.district", blank(p["property"]["district"])),
    ]
    return F.array_compact(F.array(*[F.when(lacks, F.lit(name)) for name, lacks in wanted]))


def doubtful(check_id: str, ok: Column) -> Column:
    return check(check_id, F.when(ok, "PASS").otherwise("WARNING"), F.lit("non-critical"))


def checklist(p: Column, duplicate: Column, land: Column, signed: Column) -> Column:
    """The nine checks of a payload, in order. Geographic consistency can't be
    verified here and always warns; a signature counts as seen unless it is
    said that none was."""
    made, executed = (dates.numeric_date(p[f]) for f in ("document_date", "execution_date"))
    area, survey = p["property"]["area"].try_cast("double"), F.trim(p["property"]["survey_number"])
    plain = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    buyer = p["stamp_information"]["sold_to"]
    known = F.exists(p["parties"], lambda x: F.contains(plain(buyer), plain(x["name"])) | F.contains(plain(x["name"]), plain(buyer)))
    has_survey = F.coalesce(survey != "", F.lit(False))
    return F.array(
        critical("duplicate_document_check", ~duplicate),
        check("land_document_classification", F.when(land, "PASS").otherwise("FAIL"), F.when(land, "normal").otherwise("critical")),
        critical("required_fields", F.size(missing_fields(p)) == 0),
        critical("area_validation", F.coalesce(area > 0, F.lit(False))),
        doubtful("date_validation", F.coalesce(executed >= made, F.lit(False))),
        check(
            "survey_number_validation",
            F.when(~has_survey, "FAIL").when(survey.rlike(r"^[0-9a-zA-Z\-/,\s&]+$"), "PASS").otherwise("WARNING"),
            F.when(has_survey & ~survey.rlike(r"^[0-9a-zA-Z\-/,\s&]+$"), "non-critical").otherwise("critical"),
        ),
        doubtful("geographic_consistency", F.lit(False)),
        doubtful("signature_detection", F.coalesce(signed, F.lit(True))),
        doubtful("internal_consistency", buyer.isNull() | (F.size(p["parties"]) == 0) | known),
    )
