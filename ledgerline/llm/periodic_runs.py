"""Periodic runs of the words of whole texts, by difference-cover LCE.

A run is a stretch of words that repeats with a smallest period, at least twice
and over at least 12 words, and that no neighbouring word extends. For every
period the anchors of a harmonic grid (multiples of the period) meet their
neighbour one period on; how far both agree forwards and backwards gives the
run they lie in, and all periods together have n log n anchors.

How far two places agree (LCE): the first few words are compared directly, up to
the shift at which both places fall on the difference cover; only suffixes that
begin on the cover (4 of 13) are sorted, and the rest of the answer is the
least entry of their LCP array between both, from a sparse table. Most anchors
differ within those few words, so the sorting covers only the texts where some
anchor doesn't.

The work of a text stays in its task; nothing is shuffled. Memory follows the
longest text, or BATCH_WORDS words of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise_texts, text_or_empty

PERIOD = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 occurs between two of these
MIN_WORDS = 12
BATCH_WORDS = 200_000  # words of short texts that are searched together
BLOCK_ANCHORS = 1 << 19  # anchors in memory at once
WORD = r"[^\x20\x09-\x0D]+"

IN_COVER = np.isin(np.arange(PERIOD), COVER)
# SHIFT[x, y]: the least d for which x + d and y + d are both in the cover
SHIFT = np.array([[next(d for d in range(PERIOD) if IN_COVER[(x + d) % PERIOD] and IN_COVER[(y + d) % PERIOD]) for y in range(PERIOD)] for x in range(PERIOD)])


class Words:
    """Some texts' word numbers (from 1) one after another, each followed by
    PERIOD zeros; places are (text, word number in it)."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + PERIOD)])[:-1].astype(np.int64)
        self.words = np.zeros(int((self.sizes + PERIOD).sum()), np.int32)
        for start, t in zip(self.starts.tolist(), texts, strict=True):
            self.words[start : start + len(t)] = t

    def compared(self, text: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(agreeing words, unsettled): direct comparison up to the shift at
        which both places are on the cover. Places differ within a text."""
        a, b = self.starts[text] + x, self.starts[text] + y
        shift = SHIFT[x % PERIOD, y % PERIOD]
        agree, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(PERIOD):
            alive = alive[shift[alive] > step]
            if not len(alive):
                break
            here = self.words[a[alive] + step]
            alive = alive[(here == self.words[b[alive] + step]) & (here != 0)]
            agree[alive] += 1
        ended = (self.words[a + agree] == 0) | (self.words[b + agree] == 0)  # a text's end is within its zeros
        return agree, (agree == shift) & ~ended


class CoverSuffixes:
    """LCE of the suffixes on the cover: sorted by prefix doubling, LCP of
    neighbours, and a sparse table for the least LCP of a range."""

    def __init__(self, w: Words):
        self.w = w
        text = np.repeat(np.arange(len(w.sizes)), w.sizes)
        local = np.arange(len(text)) - np.repeat(np.cumsum(w.sizes) - w.sizes, w.sizes)
        on = IN_COVER[local % PERIOD]
        self.text, self.local = text[on], local[on]
        self.place = w.starts[self.text] + self.local
        self.index = np.full(len(w.words), -1, np.int64)
        self.index[self.place] = np.arange(len(self.place))
        levels = self._levels()
        self.rank = levels[-1]
        self.table = self._sparse(self._neighbours(levels))

    def _levels(self) -> list[np.ndarray]:
        """Ranks of the suffixes by their text and first PERIOD * 2**k words,
        for k = 0, 1, ... until all differ."""
        m, bits = len(self.place), max(1, int(self.w.words.max()).bit_length())
        fit, keys = 63 // bits, [self.text]
        for begin in range(0, PERIOD, fit):
            key = np.zeros(m, np.int64)
            for d in range(begin, min(PERIOD, begin + fit)):
                key = (key << bits) | self.w.words[self.place + d]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels, width = [rank], PERIOD
        while m and rank.max() < m - 1:
            within = self.local + width < self.w.sizes[self.text]
            then = np.zeros(m, np.int64)
            then[within] = rank[self.index[self.place[within] + width]] + 1
            key = rank * (m + 1) + then
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            levels.append(rank)
            width *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """LCP of each suffix in sorted order with the one before it."""
        order = np.argsort(self.rank)
        lcp = np.zeros(len(order), np.int32)
        same = np.flatnonzero(self.text[order[1:]] == self.text[order[:-1]])
        x, y = self.place[order[same]], self.place[order[same + 1]]
        n = np.zeros(len(same), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            i, j = self.index[x + n], self.index[y + n]
            both = (i >= 0) & (j >= 0)  # -1: the text has ended
            n[both] += np.where(levels[k][i[both]] == levels[k][j[both]], PERIOD << k, 0).astype(np.int32)
        for _ in range(PERIOD - 1):
            here = self.w.words[x + n]
            n += (here == self.w.words[y + n]) & (here != 0)
        lcp[same + 1] = n
        return lcp

    @staticmethod
    def _sparse(lcp: np.ndarray) -> list[np.ndarray]:
        table, span = [lcp], 1
        while 2 * span <= len(lcp):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
            span *= 2
        return table

    def lce(self, text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Agreeing words from two places on the cover of one text."""
        start = self.w.starts[text]
        r, s = self.rank[self.index[start + x]], self.rank[self.index[start + y]]
        low, high = np.minimum(r, s) + 1, np.maximum(r, s)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            on = level == k
            t = self.table[k]
            out[on] = np.minimum(t[low[on]], t[high[on] - (1 << int(k)) + 1])
        return out


def _extended(texts: list[np.ndarray], text: np.ndarray, agree: np.ndarray, open_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`agree`, with the rest of the unsettled answers from sorted suffixes of
    the texts that have any."""
    if not open_.any():
        return agree
    some, at = np.unique(text[open_], return_inverse=True)
    suffixes = CoverSuffixes(Words([texts[t] for t in some]))
    agree = agree.copy()
    agree[open_] += suffixes.lce(at, x[open_] + agree[open_], y[open_] + agree[open_])
    return agree


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor, period) in blocks. A run of period p has at least
    max(p, MIN_WORDS - p) words that equal the one p on, so one such word
    lies on multiples of that stride."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    stride = np.maximum(period, MIN_WORDS - period)
    count = (sizes[text] - period - 1) // stride + 1
    upto = np.cumsum(count)
    begin = 0
    while begin < len(text):
        before = upto[begin] - count[begin]
        end = max(begin + 1, int(np.searchsorted(upto, before + BLOCK_ANCHORS)))
        c = count[begin:end]
        row = np.repeat(np.arange(begin, end), c)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        yield text[row], nth * stride[row], period[row]
        begin = end


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text of word numbers (from 1) its runs: rows of start, length and
    period, by start, then period."""
    w, back = Words(texts), Words([t[::-1] for t in texts])
    found = [np.zeros((0, 4), np.int64)]
    wide = np.array([len(t) if len(t) >= MIN_WORDS else 0 for t in texts], np.int64)
    for text, i, p in _grid(wide):
        at = w.starts[text] + i
        hit = w.words[at] == w.words[at + p]
        text, i, p = text[hit], i[hit], p[hit]
        need = np.maximum(MIN_WORDS, 2 * p)
        ahead, open_a = w.compared(text, i, i + p)
        n = w.sizes[text]
        behind, open_b = back.compared(text, n - i, n - i - p)
        may = open_a | open_b | (ahead + behind + p >= need)
        text, i, p, need, n = text[may], i[may], p[may], need[may], n[may]
        ahead = _extended(texts, text, ahead[may], open_a[may], i, i + p)
        behind = _extended([t[::-1] for t in texts], text, behind[may], open_b[may], n - i, n - i - p)
        length = ahead + behind + p
        is_run = length >= need
        found.append(np.unique(np.stack([text, i - behind, length, p], axis=1)[is_run], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # one stretch found with a multiple of its period too: rows are sorted, the smallest period comes first
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(1, len(texts)))
    return [part[:, 1:] for part in np.split(rows, cuts)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> (by start,
    then period) and collapsed (the text's words, without those that a run
    repeats, joined by one space) of every row.

    Null, empty and wordless texts have no words and no runs and collapse to
    the empty string; repeated rows and null doc_ids stay rows of their own; an
    empty table gives an empty result; other columns are not read."""

    def searched(held: list[tuple[object, list[bytes]]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        codes = [np.array([number.setdefault(x, len(number) + 1) for x in words], np.int32) for _, words in held]
        runs = runs_of(codes)
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        texts = [collapsed(words, r).decode("utf-8") for (_, words), r in zip(held, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in held], pa.int64()), pa.array([len(c) for c in codes], pa.int64()), pa.ListArray.from_arrays(ends, parts).cast(_RUNS), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, list[bytes]]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().encode("utf-8").split()
                held.append((doc_id.as_py(), words))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield searched(held)
                    held, size = [], 0
        if held:
            yield searched(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    kinds = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, kinds)


def plant_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic endings planted in a tenth of the rows, by
    the hash of the doc_id: from word a on, words repeat with period p. A null
    doc_id hashes as the empty string; null texts stay null."""
    h = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    planted = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p"))))
    some = F.coalesce(n > 0, F.lit(False))
    rows = rows.withColumns({"a": F.when(some, a)}).withColumn("p", F.when(some, p))
    return rows.select("doc_id", F.when(some, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs of `find_runs` told in figures: their number, the longest one
    (ties: smallest start, then period) and hashes of all runs and of the
    collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", _best(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def _best(runs: Column) -> Column:
    """Runs come by start, then period, so the first of the greatest length."""
    top = F.array_max(F.transform(runs, lambda r: r["length"]))
    return F.get(F.filter(runs, lambda r: r["length"] == top), F.lit(0))


def runs_of_planted(docs: DataFrame) -> DataFrame:
    """`digest` of the runs of `docs` with planted repeats."""
    return digest(materialise_texts(find_runs(plant_repeats(docs)), "runs"))
