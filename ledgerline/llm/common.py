"""Helpers shared by the training-data operators: tables, shared-folder
materialisation, row keys and column-safe filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000  # whole texts in an Arrow batch
BROADCAST_ROWS = 1_000_000  # 24 MB of row keys
ROW_KEY = ("key_id", "key_a", "key_b")

_made: list[list[DataFrame]] = []  # tables written inside each open `temporaries`
_local_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the cluster
    names in spark.checkpoint.dir. Without that setting only a local master
    gets a folder of its own; elsewhere each executor would write to its own
    disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    if not _local_folder:
        _local_folder.append(f"file://{tempfile.mkdtemp(prefix='ledgerline-')}")
    return _local_folder[0]


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back. A `lasting`
    table isn't removed at the end of `temporaries`.

    Cuts the lineage in a way that survives lost executors, gives AQE exact
    sizes and a plain exchange above the scan (so skewed joins can be split),
    and keeps Python stages from running twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    if _made and not lasting:
        _made[-1].append(read)
    return read


def materialise_texts(df: DataFrame, label: str) -> DataFrame:
    """`materialise` of a Python step over whole texts, with fewer rows in an
    Arrow batch than usual: 10,000 texts take tens of MB on both sides of a
    worker. The session's setting is put back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_ROWS))
    try:
        return materialise(df, label)
    finally:
        conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ledgerline/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporaries(*done: DataFrame) -> Iterator[None]:
    """Removes, once the block has ended well, the tables that were written in
    it and those in `done`; what leaves the block must not read them any more."""
    _made.append([])
    try:
        yield
    finally:
        made = _made.pop()
    for df in (*made, *done):
        discard(df)


def lowest(rows: DataFrame, mark: Column, tie: str, limit: int) -> DataFrame:
    """The `limit` rows of least `mark`, an evenly spread 64-bit hash. A sorted
    limit alone takes `limit` rows of every task to one place; here the rows are
    counted first, and those beyond about twice the limit never leave theirs.
    Rows must not repeat one mark often: it would be taken whole or not at all."""
    n, wanted = rows.count(), 2 * limit + 64
    if n > wanted:
        rows = rows.where(mark < F.lit(int(2**64 * (wanted / n)) - 2**63))
    return rows.orderBy(mark, tie).limit(limit)


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def row_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the doc_id and a 128-bit hash of the text (null
    as empty) and of whether the doc_id is null. Never null itself, so plain
    joins find it. Rows of one key have one text and one doc_id."""
    unnamed, text = docs["doc_id"].isNull(), text_or_empty(docs)
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias(ROW_KEY[0]),
        F.xxhash64(unnamed, text).alias(ROW_KEY[1]),
        F.xxhash64(F.lit(1), unnamed, text).alias(ROW_KEY[2]),
    ]


def row_order() -> Column:
    """Order of rows with doc_id and key: by doc_id, null last, then by text hash."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), *ROW_KEY)


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns, kept apart whatever they are called), others (as JSON,
    without the text) and ROW_KEY of every row."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    others = F.struct(*[docs[c] for c in docs.columns if c.lower() != "text"])
    return docs.select(whole.alias("row"), F.to_json(others).alias("others"), *row_key(docs))


def _met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join by ROW_KEY. Keys are counted; up to BROADCAST_ROWS
    they are broadcast and no text moves, beyond that one shuffle by key does."""
    keys = keys.select(*[F.col(c).alias(f"of_{c}") for c in ROW_KEY])
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, [F.col(c) == F.col(f"of_{c}") for c in ROW_KEY], how)


def without_keys(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows of some keys; rows that repeat another key stay
    as often as they are."""
    gone = materialise(gone.select(*ROW_KEY).distinct(), "gone")
    return _met(_keyed(docs).drop("others"), gone, "left_anti").select("row.*")


def keep_judged(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of `docs` of which `judged` (ROW_KEY, kept) keeps one, columns
    as in `docs` whatever they are called. Of rows that repeat a kept key, one
    stays: that whose other columns come first as JSON."""
    verdict = judged.groupBy(*ROW_KEY).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    verdict = materialise(verdict, "verdicts")
    repeated = verdict.where("kept and n > 1")
    rows = _met(_keyed(docs), verdict.where("not kept"), "left_anti")
    if repeated.isEmpty():
        return rows.select("row.*")
    # combined before the shuffle, so a key repeated very often moves one row a task
    once = _met(rows, repeated, "left_semi").groupBy(*ROW_KEY).agg(F.min_by("row", "others").alias("row"))
    return _met(rows, repeated, "left_anti").select("row.*").unionByName(once.select("row.*"))
