"""Stored tables: what a failing, refused or late write leaves behind."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import saving
from ledgerline.sources import files, versions

RECORD = "id string, status string, document_payload string, raw_ocr string, field_provenance string, canonical_sealed_payload string, clerk_submitted boolean, created_at string"


def records(spark, *rows):
    return spark.createDataFrame([(i, s, p, raw, None, None, None, at) for i, s, p, raw, at in rows], RECORD)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "records")
    saving.create(records(spark, ("a", "APPROVED", '{"n": 1}', "raw a", "t1"), ("b", "NEEDS_REVIEW", '{"n": 2}', "raw b", "t2"), ("c", None, "{}", None, "t3")), path, "id")
    return path


def told(spark, path, *columns):
    return sorted(tuple(r) for r in versions.read(spark, path).select("id", *columns).collect())


def test_defaults_and_sealing(spark, stored):
    assert told(spark, stored, "status", "clerk_submitted", "canonical_sealed_payload") == [("a", "APPROVED", True, '{"n":1}'), ("b", "NEEDS_REVIEW", False, None), ("c", "READY_FOR_APPROVAL", False, None)]


def test_upsert_keeps_first_reading_and_refuses_sealed_changes(spark, stored):
    saving.save_records(records(spark, ("b", "APPROVED", '{"n": 9}', "read again", "t9"), ("d", "REJECTED", "{}", "raw d", "t4")), stored, "id")
    assert told(spark, stored, "document_payload", "raw_ocr", "created_at") == [("a", '{"n": 1}', "raw a", "t1"), ("b", '{"n": 9}', "raw b", "t2"), ("c", "{}", None, "t3"), ("d", "{}", "raw d", "t4")]
    before = told(spark, stored, "document_payload", "status")
    for bad in (
        [("c", "APPROVED", "{}", None, "t"), ("b", "APPROVED", '{"n": 10}', None, "t")], [("e", None, "{}", None, "t"), ("e", None, "{}", None, "t")],
        [(None, None, "{}", None, "t")],
    ):
        with pytest.raises(versions.Refused):
            saving.save_records(records(spark, *bad), stored, "id")
    assert told(spark, stored, "document_payload", "status") == before and versions.versions(spark, stored) == [1, 2]
    saving.save_records(records(spark, ("a", "REVOKED", '{"n": 1}', None, "t")), stored, "id")  # the same payload may get another status
    assert ("a", "REVOKED") in told(spark, stored, "status")


def test_failing_job_leaves_the_table(spark, stored):
    broken = versions.read(spark, stored).withColumn("raw_ocr", F.when(F.col("id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("raw_ocr")))
    with pytest.raises(Exception, match="lost"):
        saving.restore_table(broken, stored, "id")
    assert len(told(spark, stored)) == 3 and versions.versions(spark, stored) == [1]


def test_readers_of_the_version_before_go_on(spark, stored):
    old = versions.read(spark, stored)
    saving.save_records(records(spark, ("b", "REJECTED", "{}", None, "t")), stored, "id")
    assert old.where("status = 'NEEDS_REVIEW'").count() == 1 and versions.read(spark, stored).where("status = 'NEEDS_REVIEW'").count() == 0


def test_stale_snapshot(spark, stored):
    mine = versions.read(spark, stored)
    saving.save_records(records(spark, ("b", "DUPLICATE", '{"n": 2}', None, "t"), ("new", None, "{}", None, "t")), stored, "id")
    saving.save_snapshot(mine.where("id <> 'c'"), 1, stored, "id")
    assert told(spark, stored, "status") == [("a", "APPROVED"), ("b", "DUPLICATE"), ("new", "READY_FOR_APPROVAL")]
    with pytest.raises(versions.Refused):
        saving.save_snapshot(versions.read(spark, stored).withColumn("document_payload", F.lit("{}")), versions.versions(spark, stored)[-1], stored, "id")
    saving.save_snapshot(mine.where("false"), 1, stored, "id")
    assert told(spark, stored) == []


def test_two_writers_at_once_lose_nothing(spark, stored):
    errors = []

    def save(name):
        try:
            saving.save_records(records(spark, (name, None, "{}", None, "t")), stored, "id")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=save, args=(f"w{i}",)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and told(spark, stored) == [(i,) for i in ("a", "b", "c", "w0", "w1", "w2")]
    with pytest.raises(versions.Overtaken):
        versions.commit(versions.read(spark, stored), stored, base=1)
    with pytest.raises(versions.Overtaken):
        saving.create(records(spark), stored, "id")


def test_restore_and_its_checks(spark, stored):
    backup = saving.with_defaults(records(spark, ("a", "NEEDS_REVIEW", "{}", None, "t"), ("z", "APPROVED", "{}", None, "t")))
    version, differences = saving.restore_table(backup, stored, "id")
    assert (version, differences.collect(), told(spark, stored, "status")) == (2, [], [("a", "NEEDS_REVIEW"), ("z", "APPROVED")])
    with pytest.raises(versions.Refused):
        saving.restore_table(backup.union(backup), stored, "id")


def test_json_store_can_replace_itself(spark, tmp_path):
    path = str(tmp_path / "store")
    files.write_json_store(spark.range(4), path)
    read = files.read_json_store(spark, path, "id long")
    files.write_json_store(read.where("id > 1"), path)
    assert sorted(r.id for r in files.read_json_store(spark, path, "id long").collect()) == [2, 3]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))
