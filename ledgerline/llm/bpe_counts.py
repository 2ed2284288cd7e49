"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a linked list of byte symbols, the last one marked as a
word end. A heap holds the adjacent pairs by (rank, position); the lowest is
popped, stale entries are skipped, the pair is joined in the list and its new
neighbours are pushed. The count is the initial symbols minus the merges, so
no identifiers are made. Texts with special-token strings are cut at those
strings (one token each); normal form and lower case follow the vocabulary.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_texts, text_or_empty
from .wordbpe import WordPieces, byte_symbols, merge_ranks, vocabulary_path

# Fixed values of the public vocabulary: special strings and the word-end mark.
SPECIAL_STRINGS = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"

_counters: dict[str, WordPieces] = {}

_BYTE_SYMBOLS = byte_symbols()


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens of one pre-token, given as the symbols of its bytes."""
    n = len(symbols)
    if n == 0:
        return 0
    symbols[-1] += WORD_END
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := rank_of((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or rank_of((symbols[i], symbols[j])) != rank:
            continue  # one side has been merged since this entry was pushed
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := rank_of((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


def token_counter(path: str) -> WordPieces:
    """Text -> number of tokens; one counter, with its memo, per worker."""
    if path not in _counters:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        normal, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        ranks = merge_ranks(path)
        special = regex.compile("|".join(map(regex.escape, SPECIAL_STRINGS)))

        def count(word: str) -> int:
            return merged_count([_BYTE_SYMBOLS[b] for b in word.encode("utf-8")], ranks)

        def whole(text: str) -> int:
            parts = special.split(text)
            # the vocabulary's pre-tokens come as the symbols of their bytes
            words = (list(word) for part in parts for word, _ in split(normal(part)))
            return sum(merged_count(word, ranks) for word in words) + len(parts) - 1

        _counters[path] = WordPieces(count, sum, whole)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) per row.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
    each, null ids among them; an empty table gives an empty result; other
    columns are not read. Runs in the scan's own partitions: no shuffle at any size."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [count(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty(docs).alias("text"),
        F.octet_length(text_or_empty(docs)).cast("long").alias("n_bytes"),
    )
    counted = materialise_texts(rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long"), "token-counts")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
