"""Normalisation rules learned from verified corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.confidence import final_confidence, rule_confidence

KEYS = ["field", "doc_type", "language", "raw"]


def induce_rules(feedback: DataFrame, least: int = 2) -> DataFrame:
    """Verified corrections (KEYS, corrected, status, ts) -> rules with two or
    more pieces of evidence. Rows count, not distinct documents."""
    good = feedback.where((F.col("status") == "verified") & (F.trim("raw") != "") & (F.trim("corrected") != ""))
    good = good.withColumns({"language": F.lower("language"), "raw": F.trim("raw"), "corrected": F.trim("corrected")})
    rules = good.groupBy(*KEYS, "corrected").agg(F.count("*").alias("evidence"), F.min("ts").alias("first_ts"), F.max("ts").alias("created"))
    return rules.where(F.col("evidence") >= least).withColumn("rule_confidence", rule_confidence(F.col("evidence")))


# Types and languages that no rule applies to.
UNSCOPED = ("", "unknown", "null", "none")


def apply_rules(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values (KEYS, ocr) with the rule of earliest evidence for their key, else
    the baseline rules of their field. Types and languages are compared without
    regard to case; where one is blank or unknown no learned rule applies. The
    raw value and its confidence stay as they are; a null value is null with
    confidence 0."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    scoped = rules.withColumns({"doc_type": plain("doc_type"), "language": plain("language")})
    w = Window.partitionBy(*KEYS).orderBy("first_ts", "corrected")
    first = scoped.withColumn("r", F.row_number().over(w)).where("r = 1").select(*[F.col(k).alias(f"rule_{k}") for k in KEYS], "corrected", "rule_confidence")
    asked = values.withColumns({"ask_type": plain("doc_type"), "ask_language": plain("language")})
    same = (
        (F.col("field") == F.col("rule_field")) & (F.col("ask_type") == F.col("rule_doc_type")) & (F.col("ask_language") == F.col("rule_language"))
        & (F.trim("raw") == F.col("rule_raw")) & ~F.col("ask_type").isin(*UNSCOPED) & ~F.col("ask_language").isin(*UNSCOPED)
    )
    joined = asked.join(first, same, "left")
    fixed = text.ruled(F.col("field"), F.col("raw"))
    is_fixed = F.col("corrected").isNull() & (fixed != F.trim("raw"))
    final = (
        F.when(F.col("raw").isNull(), 0.0).when(F.col("corrected").isNotNull(), final_confidence(F.col("ocr"), F.col("rule_confidence")))
        .when(is_fixed, final_confidence(F.col("ocr"), F.lit(0.90))).otherwise(F.col("ocr"))
    )
    kind = F.when(F.col("corrected").isNotNull(), "learned_correction").when(is_fixed, "deterministic_normalization").otherwise("raw_ocr")
    out = joined.withColumns({"value": F.coalesce("corrected", F.when(is_fixed, fixed), "raw"), "final": final, "kind": kind})
    return out.select(*values.columns, "value", "final", "kind")


def stage(feedback: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Pending feedback to keep: entries that are blank or change nothing are
    skipped, and of several for one key the latest stays. Decided rows all stay."""
    useful = (F.trim("corrected") != "") & ~F.trim("corrected").eqNullSafe(F.trim("raw"))
    is_pending = F.col("status") == "pending_approval"
    return latest_pending(feedback.where(is_pending & useful), keys, ts, tie).select(*feedback.columns).unionByName(feedback.where(~is_pending))


def settle(feedback: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Pending feedback of a record becomes verified or rejected with it; rows
    already decided don't change. decisions: (key, approved boolean), one a key."""
    told = decisions.select(F.col(key).alias("decided"), "approved")
    joined = feedback.join(told, F.col(key) == F.col("decided"), "left")
    now = F.when(F.col("status") != "pending_approval", F.col("status")).when(F.col("approved"), "verified").when(~F.col("approved"), "rejected").otherwise(F.col("status"))
    return joined.withColumns({"settled": F.col("approved").isNotNull() & (F.col("status") == "pending_approval"), "status": now}).drop("decided", "approved")


def learning_stats(feedback: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: feedback by status, rules, and the sorted fields and languages."""
    of = lambda s: F.count_if(F.col("status") == s)
    n = feedback.agg(
        F.count("*").alias("feedback"), of("pending_approval").alias("pending"), of("verified").alias("verified"), of("rejected").alias("rejected"),
        F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"), F.array_join(F.sort_array(F.collect_set(F.lower("language"))), ",").alias("languages"),
    )
    return n.crossJoin(rules.agg(F.count("*").alias("rules")))  # one row each


def latest_pending(feedback: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The latest row per key: combined before the shuffle, no window."""
    rest = [c for c in feedback.columns if c not in (*keys, ts, tie)]
    top = F.max(F.struct(ts, tie, *rest)).alias("top")
    return feedback.groupBy(*keys).agg(top).select(*keys, "top.*")
