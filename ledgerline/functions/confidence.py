"""Confidence arithmetic of rules and provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed values in this module: weights, reductions, caps and steps of the scores.


def rule_confidence(evidence: Column) -> Column:
    """0.80 at two pieces of evidence, 0.05 more for each, at most 0.95."""
    return F.when(evidence >= 5, 0.95).when(evidence == 4, 0.90).when(evidence == 3, 0.85).when(evidence == 2, 0.80).otherwise(0.0)


def final_confidence(ocr: Column, rule: Column) -> Column:
    return F.least(F.lit(0.95), F.greatest(ocr, rule))


def provenance_confidence(ocr: Column, semantic: Column, corrected: Column, review: Column, conflict: Column, found: Column) -> Column:
    """Confidence of a shown field: both figures weighed, then a reduction and a
    cap for a correction, a pending review, a conflict and a missing line."""
    c = 0.6 * ocr + 0.4 * semantic
    c = F.when(corrected, c * 0.82).otherwise(c)
    c = F.when(corrected | review, F.least(c, F.lit(0.78))).otherwise(c)
    c = F.when(conflict, F.least(c * 0.75, F.lit(0.65))).otherwise(c)
    c = F.when(found, c).otherwise(F.least(c * 0.80, F.lit(0.70)))
    return F.least(F.lit(0.98), F.greatest(F.lit(0.20), c))


def party_confidence(given: Column, line: Column, corrected: Column) -> Column:
    """struct(score, needs_review) of a party: the extractor's own figure, else
    that of its line (null where none was found), less for a correction."""
    c = F.coalesce(given, F.when(line.isNull(), 0.60).otherwise(F.least(F.lit(0.98), F.greatest(F.lit(0.50), line))))
    review = line.isNull() | (c < 0.85)
    score = F.when(corrected, F.least(c * 0.85, F.lit(0.78))).when(review, F.least(c, F.lit(0.82))).otherwise(c)
    return F.struct(F.round(score, 4).alias("score"), (corrected | review).alias("needs_review"))


def best_known(*scores: Column) -> Column:
    """The first score that is neither null nor 0, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(*[F.when(s != 0, s) for s in scores]))


def document_confidence(field_mean: Column, page_mean: Column, guess: Column) -> Column:
    """Of a document: the mean of its fields' scores, else that of its pages'
    where they have any above 0, else a guess (`document_heuristic`)."""
    return F.round(F.coalesce(field_mean, F.when(page_mean > 0, page_mean), guess), 3)


def document_heuristic(status: Column, filled: Column, checks: Column) -> Column:
    """Confidence of a document without scores, from the shares of its key
    fields that are filled and of its checks that pass."""
    mean = (filled + checks) / 2
    c = (
        F.when(status.isin("FAIL", "REJECTED", "DUPLICATE"), 0.35 + 0.20 * checks)
        .when(status.isin("APPROVED", "SEALED"), 0.88 + 0.10 * mean)
        .when(status.isin("READY_FOR_APPROVAL", "UNDER_REVIEW"), 0.80 + 0.12 * mean).otherwise(0.70 + 0.18 * mean)
    )
    return F.round(c, 3)
