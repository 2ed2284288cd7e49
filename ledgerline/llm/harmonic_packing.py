"""Harmonic packing of token ids into sequences of fixed capacity.

With capacity C, class k takes pieces of length in (C/(k+1), C/k] and each of
its bins takes exactly k of them. Documents may be cut anywhere, so a document
is cut greedily into lengths floor(C/k), the largest first; those classes have
one length each. What is left under C/64 tokens stays one piece, of one of a
few classes of lengths: (top - width, top], with floor(C/top) pieces a bin. A
piece's bin follows from its rank within the class alone. Ranks are counted per
(class, block) and shifted by the counts of the blocks before, so no class
gathers in one task. The last, part-filled bin of each class (fewer than k
pieces, a constant number in all, whatever the corpus) is dissolved; those
pieces are packed together, decreasing, first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, materialise_texts, text_or_empty
from .wordbpe import id_encoder, vocabulary_path

CAPACITY = 4096
CLASSES = 64
SMALL_CLASSES = 8  # of the lengths below capacity / classes
END_ID = 2
ROWS_PER_BLOCK = 20_000


def piece_lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths that `n` tokens are cut into: floor(capacity/k) for k up to
    `classes`, the largest first, and one remainder below the last of them."""
    cut = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = -(-capacity // rest)  # smallest k with capacity/k <= rest
        length = capacity // k
        if k > classes:
            cut.append(rest)
            break
        cut.append(length)
        rest -= length
    return cut


def class_top(length: Column, capacity: int, classes: int) -> Column:
    """The greatest length of a piece's class, which names it."""
    limit = capacity // classes - 1  # the longest remainder
    width = max(1, -(-limit // SMALL_CLASSES))
    top = F.least(F.ceil(length / width) * width, F.lit(max(1, limit)))
    return F.when(length > limit, length).otherwise(top).cast("long")


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int, classes: int, end_id: int) -> DataFrame:
    """One row per piece of each document, cut in the scan's own partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            texts = batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = encode(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, capacity, classes):
                    doc.append(doc_id)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    at += size
            columns = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(run, _PIECE)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros(0, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        fits = np.flatnonzero(room >= lengths[i])
        if len(fits) == 0:
            room = np.append(room, capacity)
            fits = [len(room) - 1]
        bins[i], offsets[i] = fits[0], capacity - room[fits[0]]
        room[fits[0]] -= lengths[i]
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    end_id: int = END_ID,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null text counts as empty: one piece, the end id alone. Very long texts
    are cut; rows repeating a doc_id, or without one, are packed each; an empty
    table gives an empty result; other columns are not read."""
    path = path or vocabulary_path()
    top = class_top(F.col("length"), capacity, classes)
    # numbered once, in a written table: rows alike in all columns are still dealt apart, and ranks are stable
    cut = pieces(docs, path, capacity, classes, end_id).withColumns({"top": top, "piece": F.monotonically_increasing_id()})
    cut = materialise_texts(cut, "pieces")
    blocks = max(16, cut.count() // rows_per_block)
    cut = cut.withColumns(
        {
            "block": F.pmod(F.xxhash64("piece"), F.lit(blocks)).cast("int"),
            "k": F.floor(F.lit(capacity) / F.col("top")).cast("long"),
        }
    )
    counts = cut.groupBy("top", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    shift = counts.withColumn("before", before)
    # one row per class: classes + SMALL_CLASSES and a few of them
    bins = counts.groupBy("top").agg(F.sum("n").alias("all"))
    bins = bins.withColumn("bins", F.floor(F.col("all") / F.floor(F.lit(capacity) / F.col("top"))).cast("long"))
    full = {r.top: r.bins for r in bins.collect()}
    base, first = {}, 0
    for k in sorted(full, reverse=True):
        base[k] = first
        first += full[k]
    if not full:
        return docs.sparkSession.createDataFrame([], _PIECE + ", sequence_id long, offset long")
    base_of = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    full_of = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("top", "block").orderBy("piece")) - 1
    ranked = cut.withColumn("own", rank).join(shift.drop("n"), ["top", "block"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("k")).cast("long"))
    ranked = materialise(
        ranked.select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "top", "rank",
            F.when(F.col("bin") < full_of[F.col("top")], base_of[F.col("top")] + F.col("bin")).alias("sequence_id"),
            ((F.col("rank") % F.col("k")) * F.col("length")).alias("slot"),
        ),
        "ranked",
    )
    columns = [c.split()[0] for c in (_PIECE + ", sequence_id long, offset long").split(", ")]
    # where a class has one length a piece's place is known; elsewhere a bin's k pieces are summed up
    exact = F.col("length") >= capacity // classes
    filled = ranked.where("sequence_id is not null")
    placed = filled.where(exact).withColumn("offset", F.col("slot"))
    in_bin = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    small = filled.where(~exact).withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))

    def tail(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "top", "rank"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=bins + first, offset=offsets)[columns]

    # fewer than k pieces of each class are left: a constant, not a share of the corpus
    left = ranked.where("sequence_id is null").withColumn("group", F.lit(0))
    rest = left.groupBy("group").applyInPandas(tail, _PIECE + ", sequence_id long, offset long")
    return placed.select(columns).unionByName(small.select(columns)).unionByName(rest)
