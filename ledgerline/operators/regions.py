"""Handwriting regions of pages, and words from a recogniser's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# Wording of seals, signatures, headings and printed clauses, and
# the zones and bounds of the passes.
SEAL_WORDS = ("SUB", "REGISTRAR", "EX.OFFICIO", "OFFICIO", "VENDOT", "VENDOR", "GOVERNMENT", "JUDICIAL", "RUPEES", "DENOMINATION", "STAMP", "SEAL", "S.R.O", "SRO")
SIGNATURE_WORDS = ("SIGNATURE", "THUMB", "LTI", "MARK", "EXECUTANT", "WITNESS", "SIGN")
HEADINGS = ("DEED OF", "SALE DEED", "GIFT DEED", "MORTGAGE", "INDIA NON JUDICIAL", "GOVERNMENT", "ANDHRA", "TELANGANA")
PRINTED = ("HEREINAFTER", "CALLED", "VENDOR", "PURCHASER", "SCHEDULE", "SITUATED", "BOUNDARIES", "WITNESSETH")
TOP, BOTTOM, DOUBTFUL, SHORTEST, LONGEST = 0.16, 0.82, 0.72, 3, 70


def _any(c: Column, words: tuple) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def detection(text: Column, score: Column, y_rel: Column) -> Column:
    """What the passes say of a line: 'seal', 'signature', 'margin', 'doubtful'
    or null. The first pass that takes a line keeps it, so a seal is never
    handwriting however badly it was read."""
    upper = F.upper(collapse(text))
    tokens = F.array_distinct(F.regexp_extract_all(upper, F.lit(r"\b[A-Z]+\b"), F.lit(0)))
    of = lambda words: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))
    size = F.length(F.trim(text))
    return (
        F.when((of(SEAL_WORDS) >= 2) | upper.contains("NON JUDICIAL"), "seal")
        .when((of(SIGNATURE_WORDS) > 0) & (y_rel >= BOTTOM), "signature")
        .when((y_rel <= TOP) & upper.rlike("[0-9]") & ~_any(upper, HEADINGS), "margin")
        .when((score < DOUBTFUL) & size.between(SHORTEST, LONGEST) & ~_any(upper, PRINTED), "doubtful")
    )


def handwriting_regions(lines: DataFrame) -> DataFrame:
    """(doc, page, ordinal, text, score, x_min, y_min, x_max, y_max,
    page_height) -> doc, page, ordinal, found_by, box array<int>, confidence of
    the regions that may be handwriting. Each pass bounds its own confidence."""
    middle = (F.col("y_min") + F.col("y_max")) / 2
    found = lines.withColumn("found_by", detection(F.col("text"), F.col("score"), middle / F.col("page_height"))).where("found_by in ('margin', 'doubtful')")
    margin = F.least(F.lit(0.85), F.greatest(F.lit(0.40), 1.0 - F.col("score") * 0.4))
    sure = F.round(F.when(F.col("found_by") == "margin", margin).otherwise(F.least(F.lit(0.65), F.col("score"))), 4)
    box = F.array(*[F.col(c).cast("int") for c in ("x_min", "y_min", "x_max", "y_max")])
    return found.select("doc", "page", "ordinal", "found_by", box.alias("box"), sure.alias("confidence"))


def handwriting_metadata(regions: DataFrame, docs: DataFrame, recognised: Column | None = None) -> DataFrame:
    """doc, detected, recognised_regions, unrecognised_regions, needs_review,
    pages of every doc, from its regions; none of them is recognised unless a
    column says so."""
    read = recognised if recognised is not None else F.lit(False)
    counted = regions.groupBy("doc").agg(
        F.count_if(read).alias("recognised_regions"), F.count_if(~read).alias("unrecognised_regions"), F.sort_array(F.collect_set("page")).alias("pages")
    )
    rows = docs.select("doc").distinct().join(counted, "doc", "left")
    detected = F.col("pages").isNotNull()
    return rows.select(
        "doc", detected.alias("detected"), F.coalesce("recognised_regions", F.lit(0)).cast("long").alias("recognised_regions"),
        F.coalesce("unrecognised_regions", F.lit(0)).cast("long").alias("unrecognised_regions"), detected.alias("needs_review"),
        F.coalesce("pages", F.array().cast(regions.schema["page"].dataType.simpleString().join(("array<", ">")))).alias("pages"),
    )


def recognised_words(pages: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """(doc, page, rec_texts, rec_scores, rec_polys) -> doc, page, ordinal, text,
    score, x_min, y_min, x_max, y_max, y_center, height: a row per word that
    all three arrays have; the arrays end where the shortest does, and words of
    blanks are none. `scale` is what the page was enlarged by before."""
    n = F.least(F.size("rec_texts"), F.size("rec_scores"), F.size("rec_polys"))
    cut = [F.slice(F.col(c), F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in ("rec_texts", "rec_scores", "rec_polys")]
    words = pages.select("doc", "page", F.posexplode(F.arrays_zip(*cut)).alias("ordinal", "w"))
    scale = F.lit(scale) if isinstance(scale, float) else scale
    side = lambda i, f: F.round(f(F.transform("w.rec_polys", lambda p: p[i])) / scale).cast("int")
    rows = words.select(
        "doc", "page", "ordinal", collapse(F.col("w.rec_texts")).alias("text"), F.col("w.rec_scores").cast("double").alias("score"),
        side(0, F.array_min).alias("x_min"), side(1, F.array_min).alias("y_min"), side(0, F.array_max).alias("x_max"), side(1, F.array_max).alias("y_max"),
    )
    y = (F.col("y_min") + F.col("y_max")) / 2
    return rows.where("text <> ''").withColumns({"y_center": y, "height": F.col("y_max") - F.col("y_min")})
