"""Validation checklist as one struct expression per check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check(check_id: str, status: Column, severity: Column) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), status.alias("status"), severity.alias("severity"))


def critical(check_id: str, ok: Column) -> Column:
    return check(check_id, F.when(ok, "PASS").otherwise("FAIL"), F.lit("critical"))


def advisory(check_id: str, ok: Column) -> Column:
    return check(check_id, F.when(ok, "PASS").otherwise("WARNING"), F.when(ok, "normal").otherwise("warning"))


def overall_status(checks: Column, duplicate: Column) -> Column:
    """DUPLICATE over FAIL (a critical failure) over NEEDS_REVIEW (any warning
    or failure) over READY_FOR_APPROVAL."""
    fails = F.exists(checks, lambda c: (c["status"] == "FAIL") & (c["severity"] == "critical"))
    doubts = F.exists(checks, lambda c: c["status"].isin("WARNING", "FAIL"))
    return F.when(duplicate, "DUPLICATE").when(fails, "FAIL").when(doubts, "NEEDS_REVIEW").otherwise("READY_FOR_APPROVAL")


def pass_count(checks: Column) -> Column:
    return F.size(F.filter(checks, lambda c: c["status"] == "PASS"))


def is_land_document(populated: dict[str, Column], core: list[str]) -> Column:
    """Whether any core field is populated; others alone never qualify."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in populated.items()]))
    return F.arrays_overlap(names, F.array(*map(F.lit, core)))
