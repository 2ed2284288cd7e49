"""Stored tables that are replaced as a whole: numbered versions in one folder.

    <path>/version=00000007/part-*.parquet

A write goes to a folder of its own below `<path>/_staged`, is read back and
checked there, and becomes the next version by one rename, which fails if that
version is there already. Readers take the newest version, so they see the old
table or the new one, whatever happens to the writing job; the version before
it stays for those that have begun to read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

KEPT = 2
_local: list[str] = []


class Refused(ValueError):
    """A check of the rows to be stored failed; the table is as it was."""


class Overtaken(RuntimeError):
    """Another writer made the next version first; the table has theirs."""


def sharedfolder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names: a folder that the driver and all
    executors share. Without it only a local master gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='ledgerline-')}")
    return _local[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{sharedfolder(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, oldest first; none if nothing is stored."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def folder(path: str, version: int) -> str:
    """Where a version's files are."""
    return f"{path}/version={version:08d}"


def read(spark: SparkSession, path: str, version: int | None = None, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """A stored table, in its newest version if none is named."""
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(path)
    reader = spark.read.format(form)
    if schema:
        reader = reader.schema(schema)
    return reader.load(folder(path, there[-1] if version is None else version))


def commit(rows: DataFrame, path: str, base: int | None = None, check: Callable[[DataFrame], None] | None = None, form: str = "parquet") -> int:
    """Stores `rows` as the version after `base` (the newest, if not given; 0:
    the table must be new) and returns its number. `check` gets the rows as
    they were written and raises `Refused` to leave the table as it was."""
    spark = rows.sparkSession
    if base is None:
        base = (versions(spark, path) or [0])[-1]
    staged, (_, fs) = f"{path}/_staged/{uuid.uuid4().hex}", _path(spark, path)
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, folder(path, base + 1)))
    try:
        rows.write.format(form).save(staged)
        if check:
            check(spark.read.format(form).schema(rows.schema).load(staged))
        if base != (versions(spark, path) or [0])[-1]:
            raise Overtaken(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
        never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, never_replace)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(target):
                raise Overtaken(path) from e
            raise
    finally:
        fs.delete(source, True)
    for old in versions(spark, path)[:-KEPT]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder(path, old)), True)
    return base + 1


def written(rows: DataFrame, label: str) -> DataFrame:
    """`rows` written once in the shared folder and read back, for what several
    parts of a plan read; survives lost executors."""
    path = new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
