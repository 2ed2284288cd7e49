"""Cross-audit of two independent extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import agrees


# The audited fields, under what names the rules' side has them,
# and roles of parties that stand for two of them.
AUDITED = {
    "document_type": ("document_type",), "document_number": ("document_number",), "document_date": ("document_date",), "survey_number": ("survey_number",),
    "sub_survey_number": ("sub_survey_number",), "property_area": ("property_area",), "village": ("village",), "mandal": ("mandal",), "district": ("district",),
    "vendor": ("vendor", "executant"), "purchaser": ("purchaser", "claimant"), "consideration_amount": ("consideration_amount", "stamp_value"),
}
ROLES = {"vendor": "vendor|seller|executant", "purchaser": "purchaser|buyer|claimant"}


def canonical_fields(rows: DataFrame) -> DataFrame:
    """(doc, fields map, property map, stamp map, parties array<struct<role,
    name>>) -> (doc, field, value): the twelve audited fields of every doc.

    A field is the first of its names that the record has at the top; a party's
    is else the name of the first party of its role, and the others are else
    in the property; the amount is else the stamp's value. Null where none is."""
    at = lambda m, name: F.try_element_at(F.col(m), F.lit(name))

    def value(field: str) -> Column:
        top = F.coalesce(*[at("fields", n) for n in AUDITED[field]])
        if field in ROLES:
            own = F.filter(F.coalesce("parties", F.array().cast("array<struct<role: string, name: string>>")), lambda p: F.coalesce(F.lower(p["role"]).rlike(ROLES[field]), F.lit(False)))
            return F.coalesce(top, F.get(own, F.lit(0))["name"])
        held = F.coalesce(*[at("property", n) for n in AUDITED[field]])
        return F.coalesce(top, held, at("stamp", "stamp_value")) if field == "consideration_amount" else F.coalesce(top, held)

    each = [F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in AUDITED]
    return rows.select("doc", F.inline(F.array(*each)))


def audit_fields(semantic: DataFrame, neural: DataFrame) -> DataFrame:
    """(doc, field, value) of both sides -> a status per document and field."""
    both = semantic.withColumnRenamed("value", "semantic").join(neural.withColumnRenamed("value", "neural"), ["doc", "field"], "full_outer")
    s, n = F.col("semantic"), F.col("neural")
    status = F.when(s.isNull() & n.isNull(), "BOTH_MISSING").when(s.isNull(), "SEMANTIC_MISSING").when(n.isNull(), "NEURAL_MISSING").when(agrees(s, n), "AGREEMENT").otherwise("DISCREPANCY_ADVISORY")
    return both.withColumn("status", status)


def audit_summary(audited: DataFrame) -> DataFrame:
    """Counts per document and agreements over comparable fields (1.0 of none)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    n = audited.groupBy("doc").agg(is_("AGREEMENT").alias("agree"), is_("DISCREPANCY_ADVISORY").alias("conflict"), is_("SEMANTIC_MISSING").alias("semantic_missing"), is_("NEURAL_MISSING").alias("neural_missing"))
    return n.withColumn("ratio", F.round(F.coalesce(F.try_divide("agree", F.col("agree") + F.col("conflict")), F.lit(1.0)), 3))
