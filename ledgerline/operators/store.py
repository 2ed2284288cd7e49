"""Record store: upserts, snapshots and fingerprints over DataFrames."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: list[str]):
    """SHA-256 of the columns as one JSON object with sorted names and nulls
    kept, so no two different rows have one text."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def canonical_json(c: Column) -> Column:
    """JSON text with keys sorted at every level, no blanks, nulls kept."""
    return F.to_json(F.try_parse_json(c), {"ignoreNullFields": "false"})


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep_old: tuple = (), keep_new: tuple = ()) -> DataFrame:
    """Rows of both, incoming values replacing existing ones; columns in
    `keep_old` keep an existing value, those in `keep_new` keep the existing
    one only where the incoming is null. One full outer join on the key."""
    a, b = existing.alias("a"), incoming.alias("b")
    columns = []
    for c in existing.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == key or c in keep_new:
            chosen = F.coalesce(new, old)
        elif c in keep_old:
            chosen = F.coalesce(old, new)
        else:
            chosen = F.when(F.col(f"b.{key}").isNotNull(), new).otherwise(old)
        columns.append(chosen.alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def immutable_violations(existing: DataFrame, incoming: DataFrame, key: str, status: str, payload: str) -> DataFrame:
    """Keys of approved rows whose payload an upsert would change."""
    a, b = existing.alias("a"), incoming.alias("b")
    changed = ~F.col(f"a.{payload}").eqNullSafe(F.col(f"b.{payload}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where((F.col(f"a.{status}") == "APPROVED") & changed).select(F.col(f"a.{key}").alias(key))


def reconcile(snapshot: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): insert, update or delete, by fingerprints only; rows
    that didn't change are left out."""
    a = snapshot.select(F.col(key).alias("ka"), fingerprint(snapshot, columns).alias("fa"))
    b = current.select(F.col(key).alias("kb"), fingerprint(current, columns).alias("fb"))
    action = F.when(F.col("ka").isNull(), "insert").when(F.col("kb").isNull(), "delete").when(F.col("fa") != F.col("fb"), "update")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), action.alias("action")).where("action is not null")


def restore(backup: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, action): what brings `current` back to the backup: delete what it
    lacks, insert or update the rest; unlike `reconcile` unchanged rows count as
    updates, since a restore writes every row."""
    a, b = backup.select(F.col(key).alias("ka")), current.select(F.col(key).alias("kb"))
    action = F.when(F.col("ka").isNull(), "delete").when(F.col("kb").isNull(), "insert").otherwise("update")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), action.alias("action"))


PART_BYTES = 2**19  # of input files, for each partition


def fine_parts(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in many small partitions, before they are grouped by it:
    groups are mostly single rows, so to group each input partition first would
    hold it whole in one task. More input has more partitions, not larger ones."""
    spark, paths = rows.sparkSession, [unquote(f) for f in rows.inputFiles()]
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] if paths else 0
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES), key)


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two tables has."""
    ids = lambda x, in_a: x.select(key, F.lit(in_a).alias("in_a"))
    both = fine_parts(ids(a, True).unionByName(ids(b, False)), key)
    n = both.groupBy(key).agg(F.bool_or("in_a").alias("left"), F.bool_or(~F.col("in_a")).alias("right"))
    lone = lambda side, other: F.when(F.col(side) & (~F.col(other) | F.col(key).isNull()), F.lit(side))
    return n.select(key, F.explode(F.array_compact(F.array(lone("left", "right"), lone("right", "left")))).alias("side"))


def migrated(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: inserted, updated and skipped (equal) rows of a migration."""
    a = source.select(F.col(key).alias("ka"), fingerprint(source, columns).alias("fa"))
    b = target.select(F.col(key).alias("kb"), fingerprint(target, columns).alias("fb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "left")
    return both.agg(
        F.count_if(F.col("kb").isNull()).alias("inserted"), F.count_if(F.col("fa") != F.col("fb")).alias("updated"),
        F.count_if(F.col("fa") == F.col("fb")).alias("skipped"),
    )


def plain_value(c: Column) -> Column:
    """A value as text that is the same however it was typed: numbers without
    trailing noughts, JSON with sorted keys, blank or empty JSON as null."""
    told = F.trim(c.cast("string"))
    number = F.regexp_replace(told.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    number = F.when(told.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$") & (F.length(told) <= 27), F.when(number.isin("", "-"), "0").otherwise(number))
    json = F.when(told.rlike(r"^[\[{]"), canonical_json(told))
    return F.nullif(F.nullif(F.nullif(F.coalesce(number, json, told), F.lit("")), F.lit("{}")), F.lit("[]"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """(key, field, value, left_rows, right_rows): the values that one table
    has more often than the other, per key and field. Keys may repeat; a field
    that a table lacks is null there, or its default. `plain_value` decides
    what is equal. A record that only one side has differs in the field `key`
    and in all that aren't null."""

    def told(rows: DataFrame, left: int) -> DataFrame:
        of = lambda f: F.col(f) if f in rows.columns else F.lit(None).cast("string")
        given = lambda f: F.coalesce(of(f).cast("string"), (defaults or {})[f].cast("string")) if f in (defaults or {}) else of(f).cast("string")
        each = [F.struct(F.lit(f).alias("field"), given(f).alias("raw")) for f in fields]
        own = F.struct(F.lit(key).alias("field"), F.col(key).cast("string").alias("raw"))
        return rows.select(F.col(key), F.lit(left).alias("left"), F.array(own, *each).alias("told"))

    both = fine_parts(told(left, 1).unionByName(told(right, 0)), key).select(key, "left", F.inline("told"))
    both = both.withColumn("value", plain_value(F.col("raw")))
    n = lambda c: F.sum(c.cast("long"))
    counted = both.groupBy(key, "field", "value").agg(n(F.col("left")).alias("left_rows"), n(1 - F.col("left")).alias("right_rows"))
    # a null on one side only says that the record is missing there, which the key's row says
    lone = F.col("value").isNull() & (F.least("left_rows", "right_rows") == 0)
    there = F.max(F.when(F.col("field") == key, F.least("left_rows", "right_rows"))).over(Window.partitionBy(key))
    return counted.withColumn("there", there).where((F.col("left_rows") != F.col("right_rows")) & ~(lone & (F.col("there") == 0))).drop("there")
