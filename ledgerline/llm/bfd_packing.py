"""Best-fit-decreasing packing into binary id matrices.

Documents are tokenised, cut losslessly at the capacity where they are longer,
and packed best fit decreasing: a segment tree over remaining capacities holds
how many open bins have each, and finds the least capacity that still takes a
piece in log2(capacity) steps. Packing runs inside each partition over buffers
of bounded size, so nothing is shuffled and memory doesn't grow with the data;
only the last bins of a buffer are part-filled.

A row is one packed sequence: its ids as a fixed-width little-endian matrix
row, the cumulative segment lengths, and where positions restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_texts, text_or_empty
from .wordbpe import id_encoder, largest_id, vocabulary_path

CAPACITY = 4096
END_ID = 2
BUFFER_TOKENS = 4_000_000
_OUT_ROWS = 128


class CapacityTree:
    """Multiset of remaining capacities 0..capacity with a best-fit search."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int = 1) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def best_fit(self, need: int) -> int:
        """The least remaining capacity of `need` or more, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:  # up to the first right sibling with a bin, then down to its leftmost
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into `lengths`; equal lengths in order of index, and of
    bins with equal room the one that came to it last."""
    tree, bins = CapacityTree(capacity), []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.best_fit(need)
        if room < 0:
            at, room = len(bins), capacity
            bins.append([])
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        bins[at].append(i)
        if left := room - need:
            by_room.setdefault(left, []).append(at)
            tree.add(left)
    return bins


SCHEMA = (
    "sequence_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, "
    "doc_ids array<long>, doc_starts array<long>, position_resets array<int>"
)
_ARROW = pa.schema(
    [
        ("sequence_id", pa.string()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
        ("position_resets", pa.list_(pa.int32())),
    ]
)


def pack_matrices(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pad_id: int = 0,
    id_bytes: int = 2,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """One row per sequence, written to the shared folder and read from there.

    ids: `capacity` ids of `id_bytes` bytes each, padded with `pad_id` after
    n_tokens. cu_seqlens: 0 and the end of each segment. doc_ids and
    doc_starts: which token of which document begins each segment.
    position_resets: offsets at which a position count restarts at 0 (the
    segments that begin a document; a continued piece of a cut document counts
    on from its doc_start).

    Null text counts as empty: the end id alone. Repeated rows are packed
    each, null ids among them; an empty table gives an empty result; other
    columns are not read. Ids that `id_bytes` bytes can't hold are an error."""
    path = path or vocabulary_path()
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    if max(largest_id(path), end_id, pad_id) >= 256**id_bytes:
        raise ValueError(f"ids of {path} need more than {id_bytes} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = id_encoder(path), TaskContext.get().partitionId()
        held: list[tuple[int, int, bytes]] = []  # doc_id, start, ids of a piece
        tokens, made = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, tokens
            bins = best_fit_decreasing([len(p[2]) // id_bytes for p in held], capacity)
            for begin in range(0, len(bins), _OUT_ROWS):
                rows = []
                for segment in bins[begin : begin + _OUT_ROWS]:
                    parts = [held[i] for i in segment]
                    ends = np.cumsum([0, *(len(p[2]) // id_bytes for p in parts)]).tolist()
                    pad = np.full(capacity - ends[-1], pad_id, kind).tobytes()
                    rows.append(
                        {
                            "sequence_id": f"{task:06d}-{made:08d}", "n_tokens": ends[-1], "n_segments": len(parts),
                            "ids": b"".join([*(p[2] for p in parts), pad]), "cu_seqlens": ends,
                            "doc_ids": [p[0] for p in parts], "doc_starts": [p[1] for p in parts],
                            "position_resets": [e for e, p in zip(ends, parts, strict=False) if p[1] == 0],
                        }
                    )
                    made += 1
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
            held, tokens = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py()), "<u4"), np.uint32(end_id)).astype(kind)
                for start in range(0, len(ids), capacity):
                    held.append((doc_id, start, ids[start : start + capacity].tobytes()))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return materialise_texts(rows.mapInArrow(run, SCHEMA), "packed-matrices")
