"""Exact dedup by content-defined chunk recipes.

A text (white space runs made one space) is cut where a rolling gear hash of
its last 32 bytes meets a mask, so equal passages give equal chunks. A chunk's
identifier is its 64-bit hash and length, verified over the whole corpus: the
copies of an identifier must agree on their SHA-256, else identifiers fall
back to the SHA-256 itself. Documents are equal if their ordered identifier
lists are. Only recipes are shuffled; a text is read once and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, keep_judged, materialise, materialise_texts, row_key, row_order, text_or_empty

WINDOW_STEPS = (1, 2, 4, 8, 16)  # doubling: a window of 32 bytes
MASK = np.uint32(0xFFE00000)  # 11 bits: about one cut in 2048 bytes
MIN_CHUNK = 512
MAX_CHUNK = 65536
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = b" \t\n\x0b\x0c\r"
_SEGMENT = 1 << 20


def normalise(text: str) -> bytes:
    """UTF-8 of the text with each run of [\\x20\\x09-\\x0D] as one space."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes.split() splits at just these characters
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _SPACE else b"") + b" ".join(words) + (b" " if raw[-1] in _SPACE else b"")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of `data`, the last one len(data)."""
    n = len(data)
    ends: list[int] = []
    start = 0
    if n > 2 * MIN_CHUNK:
        for begin in range(0, n, _SEGMENT):  # bounded memory for very long texts
            lead = min(begin, 32)
            h = GEAR[np.frombuffer(data, np.uint8, min(_SEGMENT, n - begin) + lead, begin - lead)]
            for s in WINDOW_STEPS:
                h[s:] += h[:-s] << np.uint32(s)
            for at in (np.flatnonzero((h & MASK) == 0) + (begin - lead + 1)).tolist():
                if at <= begin and begin:
                    continue
                while at - start > MAX_CHUNK:
                    start += MAX_CHUNK
                    ends.append(start)
                if at - start >= MIN_CHUNK and n - at >= MIN_CHUNK:
                    ends.append(at)
                    start = at
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return [*ends, n]


_CHUNK_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("sha", pa.binary())]))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, row key, text_sha256 of the normalised text, n_bytes, and the
    ordered chunks (hash, length, sha) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, sizes, lists = [], [], []
            for text in batch.column(0):
                data = normalise(text.as_py())
                shas.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
                chunks, start = [], 0
                for end in cut_points(data):
                    piece = data[start:end]
                    code = np.uint64(xxhash.xxh64_intdigest(piece)).astype(np.int64)
                    chunks.append({"hash": int(code), "length": end - start, "sha": hashlib.sha256(piece).digest()})
                    start = end
                lists.append(chunks)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(shas), pa.array(sizes, pa.int64()), pa.array(lists, _CHUNK_TYPE)],
                ["doc_id", *ROW_KEY, "text_sha256", "n_bytes", "chunks"],
            )

    rows = docs.select(text_or_empty(docs).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs))
    return rows.mapInArrow(
        run,
        "doc_id long, key_id long, key_a long, key_b long, text_sha256 string, n_bytes long, "
        "chunks array<struct<hash: long, length: int, sha: binary>>",
    )


def chunk_store(cooked: DataFrame) -> DataFrame:
    """The distinct chunks of `recipes`: hash, length, copies, and whether all
    copies agree on their SHA-256 (`verified`)."""
    chunks = cooked.select(F.explode("chunks").alias("c")).select("c.*")
    return chunks.groupBy("hash", "length").agg(
        F.count("*").alias("copies"), (F.min("sha") == F.max("sha")).alias("verified")
    )


def _with_groups(docs: DataFrame, *figures: Column) -> DataFrame:
    """The rows of `recipes` joined with figures of their group of equals."""
    cooked = materialise_texts(recipes(docs), "recipes")
    if chunk_store(cooked).where("not verified").isEmpty():
        identifiers = F.transform("chunks", lambda c: F.struct(c["hash"], c["length"]))
    else:
        identifiers = F.transform("chunks", lambda c: c["sha"])
    rows = cooked.select("doc_id", *ROW_KEY, "text_sha256", identifiers.alias("recipe"))
    groups = materialise(rows.groupBy("recipe").agg(*figures), "recipe-groups")
    # the hot group's rows are on one side of a plain equi-join: AQE splits them
    return rows.join(groups, "recipe")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (smallest doc_id of the equal texts), group_size, kept,
    text_sha256 of every row.

    Null text counts as empty; empty texts are equal to each other. Of rows
    repeating one doc_id and text all are `kept` if that doc_id is the
    smallest. A null doc_id comes after all others: a group of nulls alone has
    a null keep_id and its rows are `kept`. An empty table gives an empty
    result; other columns are not read."""
    rows = _with_groups(docs, F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, columns as in `docs`: of equal texts
    one row stays, of smallest doc_id (null after all others), then least text
    hash. Rows are told apart by doc_id and text, so a repeated or null doc_id
    loses no other text; of rows alike in both one stays (see `keep_judged`). A
    null text is an empty one. An empty table stays empty."""
    rows = _with_groups(docs, F.min(row_order()).alias("first"))
    return keep_judged(docs, rows.select(*ROW_KEY, (row_order() == F.col("first")).alias("kept")))
