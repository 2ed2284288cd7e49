"""Order MinHash document fingerprints.

The k-mers of a text (12 code points) are numbered by occurrence, so repeats
count. For each of 64 hash functions the two k-mers of least hash are chosen,
put back into text order, and hashed as a tuple. Signatures agree in a place
only if both k-mers and their order do, so likeness follows edit distance and
not just shared content.

To compare each text with the next by doc_id, rows are range-partitioned and
sorted, and a task walks its rows once. Only the last row of a task lacks its
neighbour: it is paired, by a second small step, with the first row of the
next task that has any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise_texts, text_or_empty

K = 12
FUNCTIONS = 64
TUPLE = 2
ENTRY_HEX = 4
_BLOCK = 1 << 20
_SPOT_BITS = np.uint64(24)
_B1, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: a 64-bit mixer
_B2, _B4 = (np.uint64(pow(int(_B1), e, 2**64)) for e in (2, 4))
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer in text order; a shorter text is one k-mer."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < K:
        h = np.uint64(len(code) + 1)
        with np.errstate(over="ignore"):
            for c in code:
                h = h * _B1 + c
        return _mixed(np.array([h]))
    h = code + np.uint64(1)
    h = h[:-1] * _B1 + h[1:]
    h4 = h[:-2] * _B2 + h[2:]
    h8 = h4[:-4] * _B4 + h4[4:]
    return _mixed(h8[:-4] * _B4 + h4[8:])


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hash of (k-mer, occurrence number) for each place, in text order."""
    n = len(h)
    if n < 1 << 24:
        packed = np.sort((h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
        same = packed >> _SPOT_BITS
    else:
        order = np.argsort(h, kind="stable")
        same = h[order] >> _SPOT_BITS
    new = np.ones(n, bool)
    new[1:] = same[1:] != same[:-1]
    if new.all():
        return (h >> np.uint64(32)).astype(np.uint32)
    place = np.arange(n)
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty(n, np.uint64)
    out[order] = occurrence.astype(np.uint64)
    repeated = out > 0
    h = h.copy()
    h[repeated] = _mixed(h[repeated] + out[repeated] * _B1)
    return (h >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> np.ndarray:
    """The signature: one 16-bit tuple hash per function."""
    u = numbered(kmer_hashes(text))
    n = len(u)
    if n < TUPLE:
        tuples = _mixed(u.astype(np.uint64) + _ADD.astype(np.uint64) * _B1)
        return (tuples >> np.uint64(48)).astype(np.uint16)
    first, second = np.empty(FUNCTIONS, np.int64), np.empty(FUNCTIONS, np.int64)
    rows = max(1, _BLOCK // n)
    for begin in range(0, FUNCTIONS, rows):
        part = slice(begin, min(FUNCTIONS, begin + rows))
        h = (u[None, :] ^ _ADD[part, None]) * _MULTIPLY[part, None]
        at = np.arange(h.shape[0])
        first[part] = i = h.argmin(axis=1)
        h[at, i] = np.uint32(0xFFFFFFFF)
        j = h.argmin(axis=1)
        second[part] = np.where(j == i, (i + 1) % n, j)
    low, high = np.minimum(first, second), np.maximum(first, second)
    tuples = _mixed(_mixed(u[low].astype(np.uint64) + _B1) * _B1 + u[high] + _ADD)
    return (tuples >> np.uint64(48)).astype(np.uint16)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half (floor) replaced by as many first code
    points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _compared(doc_id: int, text: str, own: np.ndarray, following: str, its: np.ndarray) -> dict:
    changed = edited(text, following)
    print_ = own if changed == text else sketch(changed)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": written(own), "edited_fingerprint": written(print_), "near_edited": likeness(own, print_),
        "near_next": likeness(own, its),
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    Null text counts as empty, whose signature is that of no symbols. Repeated
    ids order by a hash of the text, and may lie in several tasks. The last
    row's next is the first; a single row is its own. A null doc_id comes first.
    An empty table gives an empty result; other columns are not read."""
    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    place = ["doc_id", "tie", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # deals apart rows that are alike
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
    inner = pa.schema([*_ARROW, ("task", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                own = sketch(text)
                if held is None:
                    out.append({"task": task, "first_text": text})  # an edge row
                else:
                    out.append(_compared(*held, text, own))
                held = doc_id, text, own
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, inner)
                    out = []
        if held is not None:
            out.append({"doc_id": held[0], "task": task, "last_text": held[1]})  # an edge row
            yield pa.RecordBatch.from_pylist(out, inner)

    columns = _RESULT + ", task long, first_text string, last_text string"
    found = materialise_texts(ordered.mapInArrow(walk, columns), "order-minhash")
    # Tasks are numbered in order of their rows. Only these numbers, one a task
    # that had rows, meet in a window; texts meet by joins.
    edges = found.where("task is not null")
    starts = edges.where("first_text is not null").select("task", "first_text")
    named = Window.orderBy("task")
    following = F.coalesce(
        F.lead("task").over(named), F.first("task").over(named.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    after = starts.select("task").withColumn("upcoming", following)
    texts = starts.select(F.col("task").alias("upcoming"), F.col("first_text").alias("next_text"))
    lasts = edges.where("last_text is not null").join(after, "task").join(texts, "upcoming").select("doc_id", "last_text", "next_text")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [
                    _compared(r["doc_id"], r["last_text"], sketch(r["last_text"]), r["next_text"], sketch(r["next_text"]))
                    for r in batch.to_pylist()
                ]
                yield pa.RecordBatch.from_pylist(found, _ARROW)

    closed = lasts.mapInArrow(join_edges, _RESULT)
    return found.where("task is null").drop("task", "first_text", "last_text").unionByName(closed)
