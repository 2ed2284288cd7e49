"""Registered queries of stored tables: each writes versions of a table in the
shared folder, has a write refused, and reads back what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import saving
from ..sources import versions
from .places import _ERRORS, _given
from .registry import query, t

# Orders as records: the status decides what may change.
_STORED = """
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS status,
    '{"area":' || (o_custkey % 90) || ',"number":"' || o_orderkey || '"}' AS payload, 'read ' || o_custkey AS raw
  FROM orders"""


def _records(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("NEEDS_REVIEW")
    number, area = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 90).cast("string")
    # keys not in order: sealing sorts them
    payload = F.concat(F.lit('{"number": "'), number, F.lit('", "area": '), area, F.lit("}"))
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), payload.alias("document_payload"),
        F.concat(F.lit("read "), F.col("o_custkey").cast("string")).alias("raw_ocr"), F.lit(None).cast("string").alias("field_provenance"),
        F.lit(None).cast("string").alias("canonical_sealed_payload"), F.lit(None).cast("boolean").alias("clerk_submitted"),
    )


def _stored(spark, d, label: str) -> tuple[str, DataFrame]:
    """A stored table of the records, and what it holds."""
    path = versions.new_path(spark, label)
    saving.create(_records(spark, d), path, "id")
    return path, versions.read(spark, path)


def _refused(write) -> bool:
    try:
        write()
    except versions.Refused:
        return True
    return False


def _told(spark, path: str, *columns) -> DataFrame:
    rows = versions.read(spark, path)
    return rows.select("id", "status", F.col("document_payload").alias("payload"), F.col("raw_ocr").alias("raw"), *columns)


@query(f"""
WITH s AS ({_STORED}), saved AS (
  SELECT id, CASE WHEN id % 5 = 1 AND status = 'NEEDS_REVIEW' THEN 'APPROVED' ELSE status END AS status,
    CASE WHEN id % 5 = 1 AND status <> 'APPROVED' THEN '{{"number": "new", "area": 1}}' ELSE replace(replace('{{"number": "' || id || '", "area": @}}', '@', split_part(split_part(payload, ':', 2), ',', 1)), '', '') END AS payload,
    raw, id % 5 = 1 AND status = 'NEEDS_REVIEW' AS sealed_now, payload AS own FROM s
  UNION ALL SELECT -id, 'NEEDS_REVIEW', '{{}}', 'late', false, NULL FROM s WHERE id % 5 = 2)
SELECT id, status, payload, raw, status IN ('APPROVED', 'REJECTED') AND NOT sealed_now AS handed_in,
  CASE WHEN sealed_now THEN '{{"area":1,"number":"new"}}' WHEN status = 'APPROVED' THEN own END AS sealed, 2::BIGINT AS version, true AS refused
FROM saved""")
def stored_upserts(spark, d):
    """A save that is taken, and two that are refused whole: one would change
    an approved payload, one repeats an id."""
    path, rows = _stored(spark, d, "records")
    open_ = (F.col("id") % 5 == 1) & (F.col("status") != "APPROVED")
    changed = rows.where(F.col("id") % 5 == 1).withColumns({
        "status": F.when(F.col("status") == "NEEDS_REVIEW", "APPROVED").otherwise(F.col("status")),
        "document_payload": F.when(open_, '{"number": "new", "area": 1}').otherwise(F.col("document_payload")), "raw_ocr": F.lit("read again"),
    })
    late = rows.where(F.col("id") % 5 == 2).withColumns({
        "id": -F.col("id"), "status": F.lit("NEEDS_REVIEW"), "document_payload": F.lit("{}"), "raw_ocr": F.lit("late"), "canonical_sealed_payload": F.lit(None).cast("string"),
        "clerk_submitted": F.lit(None).cast("boolean"),
    })
    version = saving.save_records(changed.unionByName(late), path, "id")
    tampered = versions.read(spark, path).where("status = 'APPROVED'").withColumn("document_payload", F.lit("{}"))
    twice = late.union(late)
    refused = _refused(lambda: saving.save_records(tampered, path, "id")) and _refused(lambda: saving.save_records(twice, path, "id"))
    more = F.col("clerk_submitted").alias("handed_in"), F.col("canonical_sealed_payload").alias("sealed"), F.lit(version).cast("long").alias("version"), F.lit(refused).alias("refused")
    return _told(spark, path, *more)


@query(f"""
WITH s AS ({_STORED})
SELECT CASE part WHEN 'late' THEN -id ELSE id END AS id, CASE part WHEN 'theirs' THEN 'DUPLICATE' ELSE status END AS status,
  CASE part WHEN 'mine' THEN 'mine' WHEN 'late' THEN 'theirs' ELSE CASE WHEN id % 10 = 6 THEN 'added' ELSE 'stored' END END AS word
FROM (SELECT *, unnest(CASE WHEN id % 10 = 5 THEN ['kept', 'late'] WHEN id % 10 = 7 AND status <> 'APPROVED' THEN ['mine'] WHEN id % 10 = 8 AND status <> 'APPROVED' THEN ['theirs'] ELSE ['kept'] END) AS part FROM s)
WHERE id % 10 <> 9""")
def stored_snapshots(spark, d):
    """Two writers of one version: the second stores its stale snapshot, which
    neither undoes what the first wrote nor deletes what it added."""
    path = versions.new_path(spark, "snapshots")
    rows = _records(spark, d).withColumn("document_payload", F.lit("stored"))
    saving.create(rows.where("id % 10 <> 6"), path, "id")
    mine, free, k = versions.read(spark, path), F.col("status") != "APPROVED", F.col("id") % 10
    theirs = mine.where((k == 8) & free).withColumn("status", F.lit("DUPLICATE"))
    late = mine.where(k == 5).withColumns({"id": -F.col("id"), "document_payload": F.lit("theirs"), "canonical_sealed_payload": F.lit(None).cast("string")})
    saving.save_records(theirs.unionByName(late), path, "id")
    added = saving.with_defaults(rows.where("id % 10 = 6").withColumn("document_payload", F.lit("added")))
    edited = mine.where(k != 9).withColumn("document_payload", F.when((k == 7) & free, "mine").otherwise(F.col("document_payload")))
    saving.save_snapshot(edited.unionByName(added.select(*edited.columns)), 1, path, "id")
    return versions.read(spark, path).select("id", "status", F.col("document_payload").alias("word"))


@query(f"""
WITH s AS ({_STORED}) SELECT id, status, raw, 3::BIGINT AS version, true AS refused, 0::BIGINT AS differences FROM s""")
def stored_restore(spark, d):
    """A table that lost rows, got others and had approved ones altered by an
    earlier restore, brought back to the backup; a backup that repeats ids is
    refused."""
    path, rows = _stored(spark, d, "restored")
    wrecked = rows.where("id % 3 <> 0").withColumns({"id": F.when(F.col("id") % 3 == 1, -F.col("id")).otherwise(F.col("id")), "raw_ocr": F.lit("wrecked")})
    saving.restore_table(wrecked, path, "id")
    refused = _refused(lambda: saving.restore_table(rows.union(rows), path, "id"))
    backup = saving.with_defaults(_records(spark, d))
    version, differences = saving.restore_table(backup, path, "id")
    found = versions.read(spark, path).select("id", "status", F.col("raw_ocr").alias("raw"))
    return found.withColumns({"version": F.lit(version).cast("long"), "refused": F.lit(refused), "differences": F.lit(differences.count()).cast("long")})


@query(f"""
{_ERRORS}
SELECT dataset, count(*) AS features, count(DISTINCT feature) AS ids, max(lng) AS east, count(*) FILTER (kind = 'Point') AS points
FROM (SELECT unnest(['d4', 'd4 again']) AS dataset, feature, max(kind) AS kind, max(lng) AS lng FROM g WHERE dataset = 'd4' AND lat <= 90 GROUP BY feature)
GROUP BY dataset""")
def installed_datasets(spark, d):
    """The given datasets have errors and are refused together; one of them,
    cleaned, is installed, a second time only under another name."""
    given, path = _given(spark, d), versions.new_path(spark, "datasets")
    rest = ("level", "name", "state", "geometry_type", "vertices", "lng", "lat")
    clean = given.where("dataset = 'd4' and lat <= 90").groupBy("dataset", "feature").agg(*[F.max(c).alias(c) for c in rest])
    saving.install_datasets(given, path)
    saving.install_datasets(clean, path)
    saving.install_datasets(clean.withColumn("level", F.lit("state")), path)
    saving.install_datasets(clean.withColumns({"dataset": F.lit("d4 again"), "feature": F.col("feature") + 5000}), path)
    rows = versions.read(spark, path)
    return rows.groupBy("dataset").agg(
        F.count("*").alias("features"), F.count_distinct("feature").alias("ids"), F.max("lng").alias("east"), F.count_if(F.col("geometry_type") == "Point").alias("points")
    )
