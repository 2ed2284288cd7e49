"""Writes to a stored record table: upserts, snapshots, restores and datasets.
Each is one commit of `sources.versions`, checked before it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from . import gis, store

# Statuses of records that a clerk has handed in, and columns that
# keep their stored value, or keep it unless a new one is given.
HANDED_IN = ("APPROVED", "REJECTED", "DUPLICATE")
KEEP_OLD = ("created_at", "raw_ocr", "field_provenance")
KEEP_NEW = ("canonical_sealed_payload",)
ATTEMPTS = 5


def with_defaults(records: DataFrame) -> DataFrame:
    """Records as they are stored: those without a status are ready for
    approval, `clerk_submitted` follows the status where it isn't said, and an
    approved payload without sealed bytes is sealed as canonical JSON."""
    status = F.coalesce("status", F.lit("READY_FOR_APPROVAL"))
    found = {"status": status, "clerk_submitted": F.coalesce("clerk_submitted", F.upper(status).isin(*HANDED_IN))}
    if "canonical_sealed_payload" in records.columns:
        sealed = F.when(F.upper(status) == "APPROVED", store.canonical_json(F.col("document_payload")))
        found["canonical_sealed_payload"] = F.coalesce("canonical_sealed_payload", sealed)
    return records.withColumns(found)


def _guard(before: DataFrame | None, key: str) -> Callable[[DataFrame], None]:
    """Refuses rows that repeat or lack a key or change an approved payload."""

    def check(after: DataFrame) -> None:
        odd = after.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
        if not odd.isEmpty():
            raise versions.Refused(f"{key} is missing or repeated")
        if before is not None and not store.immutable_violations(before, after, key, "status", "document_payload").isEmpty():
            raise versions.Refused("an approved payload would change")

    return check


def _retried(spark: SparkSession, path: str, change: Callable[[DataFrame, int], tuple[DataFrame, Callable[[DataFrame], None]]]) -> int:
    """Applies a change to the newest version, anew if another writer was first."""
    for _ in range(ATTEMPTS):
        base = versions.versions(spark, path)[-1]
        rows, check = change(versions.read(spark, path, base), base)
        try:
            return versions.commit(rows, path, base, check)
        except versions.Overtaken:
            continue
    raise versions.Overtaken(path)


def create(records: DataFrame, path: str, key: str) -> int:
    """A new stored table; an error if there is one already."""
    return versions.commit(with_defaults(records), path, 0, _guard(None, key))


def _merged(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    own = lambda names: tuple(c for c in names if c in current.columns)
    return store.upsert(current, incoming.select(*current.columns), key, own(KEEP_OLD), own(KEEP_NEW))


def save_records(incoming: DataFrame, path: str, key: str) -> int:
    """Upserts records. Refused as a whole if one of them lacks a key, repeats
    one or changes the payload of an approved record."""
    ready = with_defaults(incoming)
    _guard(None, key)(ready)
    return _retried(incoming.sparkSession, path, lambda current, _: (_merged(current, ready, key), _guard(current, key)))


def save_snapshot(snapshot: DataFrame, loaded: int, path: str, key: str) -> int:
    """Stores what a reader of version `loaded` made of the table: rows that it
    took out are deleted, rows that it changed or added are upserted, and all
    others stay as they are now, whoever wrote them since. An empty snapshot
    deletes everything. Refused like `save_records`; the version it was loaded
    from must still be kept."""
    spark, columns = snapshot.sparkSession, snapshot.columns
    empty = snapshot.isEmpty()

    def change(current: DataFrame, base: int):
        if empty:
            return current.where("false"), _guard(None, key)
        was = versions.read(spark, path, loaded)
        actions = store.reconcile(was, snapshot, key, columns)
        gone = actions.where("action = 'delete'").select(key)
        written = snapshot.join(actions.where("action <> 'delete'").select(key), key, "left_semi")
        kept = current.join(gone, key, "left_anti")
        return _merged(kept, with_defaults(written), key), _guard(current, key)

    return _retried(spark, path, change)


def restore_table(backup: DataFrame, path: str, key: str) -> tuple[int, DataFrame]:
    """Makes the table what the backup says, approved rows too: (version, ids
    on one side only, of which there are none). Refused if the backup repeats
    or lacks a key, or if the written ids aren't the backup's."""
    spark = backup.sparkSession

    def check(after: DataFrame) -> None:
        _guard(None, key)(after)
        if not store.id_differences(backup, after, key).isEmpty():
            raise versions.Refused("the written ids are not the backup's")

    version = _retried(spark, path, lambda current, _: (backup.select(*current.columns), check))
    return version, store.id_differences(backup, versions.read(spark, path), key)


def install_datasets(features: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Takes in the datasets of `features` (dataset, feature, ...) that have no
    error and aren't stored below `root` yet, unless forced: `gis.onboarding`
    rows. All or none: if any is at fault nothing is stored. One table holds
    them all, so one commit shows them together."""
    spark = features.sparkSession
    there = versions.versions(spark, root)
    stored = versions.read(spark, root) if there else None
    known = stored.select("dataset").distinct() if stored is not None else features.select("dataset").where("false")
    errors = gis.dataset_errors(features)
    told = gis.onboarding(features, errors, known, force)
    if not told.where("not taken").isEmpty():
        return told.withColumn("taken", F.lit(False))
    named = features.select("dataset").distinct()
    rows = features if stored is None else stored.join(named, "dataset", "left_anti").unionByName(features)
    versions.commit(rows, root, there[-1] if there else 0)
    return told

