"""Two extractions of one document made one by a policy for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import agrees

AGREED, MOST = 0.05, 0.98


def merged_extractions(rules: DataFrame, model: DataFrame, policy: DataFrame) -> DataFrame:
    """rules, model: (doc, field, value, score); policy: (field, wins, noise,
    cut) -> doc, field, value, source, score, needs_review, other.

    wins is 'rules' or 'model' and says whose value holds where both have one
    and they differ; the other value is kept beside it and a review is needed.
    Where they agree the rules' spelling holds and the surer score gains a
    little. Where one has none the other fills in. A rules' value that the
    pattern `noise` finds is none; what `cut` finds is taken out of the model's
    value. Fields without a policy are the rules'. Blank values are none; a
    field without any value has source 'none' and score 0."""
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = rules.select("doc", "field", F.col("value").alias("va"), F.col("score").alias("sa"))
    b = model.select("doc", "field", F.col("value").alias("vb"), F.col("score").alias("sb"))
    rows = a.join(b, ["doc", "field"], "full_outer").join(F.broadcast(policy), "field", "left")
    noisy = F.coalesce(F.regexp_like("va", F.col("noise")), F.lit(False))
    rows = rows.withColumns({
        "va": F.when(~noisy, trimmed(F.col("va"))), "vb": trimmed(F.coalesce(F.regexp_replace("vb", F.col("cut"), F.lit("")), F.col("vb"))),
    })
    mine, theirs = F.col("va").isNotNull(), F.col("vb").isNotNull()
    same = F.coalesce(agrees(F.col("va"), F.col("vb")), F.lit(False))
    over = F.coalesce(F.col("wins") == "model", F.lit(False))
    source = (
        F.when(~mine & ~theirs, "none").when(mine & theirs & same, "both").when(mine & theirs, F.when(over, "model").otherwise("rules"))
        .when(mine, "rules").otherwise("model")
    )
    sa, sb = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("sa", "sb"))
    score = F.when(source == "both", F.least(F.lit(MOST), F.greatest(sa, sb) + AGREED)).when(source == "rules", sa).when(source == "model", sb).otherwise(0.0)
    apart = mine & theirs & ~same
    return rows.select(
        "doc", "field", F.when(source == "model", F.col("vb")).otherwise(F.col("va")).alias("value"), source.alias("source"), F.round(score, 4).alias("score"),
        (apart | (source == "none")).alias("needs_review"), F.when(apart, F.when(over, F.col("va")).otherwise(F.col("vb"))).alias("other"),
    )
