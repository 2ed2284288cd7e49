"""Registry aggregates: progress, KPIs, trends and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import written


def share_text(part: Column, whole: Column) -> Column:
    """Whole percent, half to even, as text; 0% of nothing."""
    return F.concat(F.coalesce(F.bround(F.try_divide(part * 100.0, whole), 0), F.lit(0.0)).cast("int").cast("string"), F.lit("%"))


def jurisdiction_progress(records: DataFrame, state: str, district: str, status: str, sealed: list, flagged: list) -> DataFrame:
    """Totals by state and district at three levels (level 0: district, 1:
    state, 3: all). A record that isn't sealed or flagged is pending."""
    is_sealed, is_flagged = F.col(status).isin(*sealed), ~F.col(status).isin(*sealed) & F.col(status).isin(*flagged)
    return (
        records.withColumns({
            "state": F.coalesce(F.nullif(F.trim(state), F.lit("")), F.lit("Unclassified")),
            "district": F.coalesce(F.nullif(F.trim(district), F.lit("")), F.lit("Unclassified")),
        })
        .rollup("state", "district")
        .agg(
            F.grouping_id().cast("long").alias("level"), F.count("*").alias("total"), F.count_if(is_sealed).alias("sealed"),
            F.count_if(is_flagged).alias("flagged"), F.count_if(~is_sealed & ~is_flagged).alias("pending"),
        )
    )


def registry_kpis(records: DataFrame, status: str, matched: Column) -> DataFrame:
    """One row: on_file, sealed, desk, rejected and two rates as text."""
    n = records.agg(
        F.count("*").alias("on_file"), F.count_if(F.col(status) == "APPROVED").alias("sealed"),
        F.count_if(~F.col(status).isin("APPROVED", "REJECTED")).alias("desk"),
        F.count_if(F.col(status) == "REJECTED").alias("rejected"), F.count_if(matched).alias("matched"),
    )
    return n.select("on_file", "sealed", "desk", "rejected", share_text(F.col("sealed"), F.col("on_file")).alias("seal_rate"),
                    share_text(F.col("matched"), F.col("on_file")).alias("gis_rate"))


def field_confidence(scores: DataFrame, review_below: float = 0.85) -> DataFrame:
    """(field, confidence) long form -> mean, count and review flag per field;
    confidences above 1 count as 1, missing ones not at all."""
    mean = F.avg(F.least("confidence", F.lit(1.0)))
    return scores.where("confidence is not null").groupBy("field").agg(
        mean.alias("mean_confidence"), F.count("*").alias("n"), (mean < review_below).alias("needs_review")
    )


def velocity(events: DataFrame, ts: str, sealed: Column, today: Column, days: int = 7) -> DataFrame:
    """Intake and sealed counts of the last `days` days with running totals.
    Older rows fall into the first bucket; rows without a date or in the
    future into the last. Only `days` rows reach the window."""
    age = F.datediff(today, F.to_date(ts))
    bucket = F.when(age.isNull() | (age < 0), days - 1).otherwise(F.greatest(F.lit(days - 1) - age, F.lit(0)))
    counts = events.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("intake"), F.count_if(sealed).alias("sealed"))
    every = events.sparkSession.range(days).withColumnRenamed("id", "bucket")
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = every.join(F.broadcast(counts), "bucket", "left").na.fill(0)
    return filled.withColumns({"intake_total": F.sum("intake").over(running), "sealed_total": F.sum("sealed").over(running)})


def queue_wait(records: DataFrame, since: str, now: Column, urgent_hours: int = 2) -> DataFrame:
    """Adds wait_hours, an urgent flag and the wait as days or hours text."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 3600)
    text = F.when(hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("d"))).otherwise(F.concat(hours.cast("string"), F.lit("h")))
    return records.withColumns({"wait_hours": hours.cast("long"), "urgent": hours >= urgent_hours, "wait_text": text})


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """`rows` with `nth`, from 1, within each group in some order, and `of`, the
    group's size. A group may be most of the table: rows are sorted over all
    tasks, written, and numbered from the counts of what each task holds of a
    group, so no group meets in one task. Groups must not be null."""
    sorted_ = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("at", 33))
    held = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(group)  # one row per task that holds any of the group
    held = held.withColumns({"before": F.sum("n").over(own.orderBy("part")) - F.col("n"), "of": F.sum("n").over(own)})
    joined = placed.join(F.broadcast(held.drop("n")), [group, "part"])
    return joined.withColumn("nth", F.col("before") + F.col("at") - F.col("first") + 1).drop("at", "part", "first", "before")
