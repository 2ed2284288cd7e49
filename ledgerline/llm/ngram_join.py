"""Jaccard self-join of three-word shingle sets by vertical partitioning.

Shingles have a global order, that of their 64-bit hashes. It is cut into
fragments, and each text's set into segments, one per fragment.

Candidates: two sets of Jaccard 0.9 differ in at most D shingles, so with D + 2
fragments at least two of their segments are equal; texts of like size meet by
the hashes of their segments. A segment is a chance sample of the whole text,
so texts that only share passages, however common, hardly ever meet.

Links: for the candidates, partial overlaps are counted fragment by fragment,
each (pair, fragment) on its own, and summed per pair.

No group is expanded into all its pairs. Equal sets are one class from the start.
In each group that shares a segment, all members first meet two of them (the
least and the greatest), which links most groups of near copies as stars. Only
where a group then still holds sets of different components do these meet each
other, and a pair must pass exact bounds on its size and on the bits of a
parity map (each differing shingle flips one bit) to be emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BROADCAST_ROWS, discard, materialise, materialise_texts, text_or_empty
from .simhash_vptree import connected_components

SHINGLE_WORDS = 3
PERCENT = 90
SPARE = 2  # fragments beyond the greatest difference
OVERLAP_FRAGMENTS = 8
PARITY_LONGS = 8
_MEMO_WORDS = 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (constants of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, memo: dict[bytes, int], seed: int = 0) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a whole text: of three words
    (A-Z lower-cased), or of the whole sequence if it has fewer."""
    words = text.encode("utf-8").lower().split()  # bytes: lower-cases A-Z only, splits at \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > _MEMO_WORDS:
        memo.clear()
    codes = []
    for w in words:
        code = memo.get(w)
        if code is None:
            code = memo[w] = xxh64_intdigest(w, seed)
        codes.append(code)
    h = np.array(codes, np.uint64)
    width = min(SHINGLE_WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k : k + n])
    return np.unique(out)


def size_classes(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(class, greatest size in it) of the classes that sets of n shingles take
    part in: their own, and the next if a set in that may link with them.
    Classes grow by half."""
    low, number = 1, 0
    while True:
        high = max(low, low * 3 // 2)
        if n <= high:
            break
        low, number = high + 1, number + 1
    own = [(number, high)]
    if 100 * n >= percent * (high + 1):
        own.append((number + 1, max(high + 1, (high + 1) * 3 // 2)))
    return own


def greatest_difference(total: int, percent: int = PERCENT) -> int:
    """Most shingles in one of two linked sets alone, their sizes summing to `total`."""
    return total - 2 * -(-percent * total // (100 + percent))


def segment_keys(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of (size class, fragment, segment). Empty segments have none,
    unless so many are empty that two linked sets might share no other."""
    found = [np.zeros(0, np.uint64)]
    if len(grams):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams))])
        for number, high in size_classes(len(grams), percent):
            most = max(greatest_difference(t, percent) for t in (2 * high, 2 * high - 1))
            if most == 0:
                continue  # only equal sets link, and these are one class already
            pieces = most + SPARE
            step = -(-(2**64) // pieces)
            cuts = np.searchsorted(grams, np.array([step * f for f in range(1, pieces)], np.uint64))
            cuts = np.concatenate([[0], cuts, [len(grams)]])
            filled = cuts[1:] > cuts[:-1]
            if (~filled).sum() >= SPARE:
                filled[:] = True
            where = _mixed(np.uint64(number << 32) + np.arange(pieces, dtype=np.uint64))
            found.append(_mixed((sums[cuts[1:]] - sums[cuts[:-1]]) ^ where)[filled])
    return np.concatenate(found)


def set_hashes(grams: np.ndarray) -> list[int | None]:
    """Two signed 64-bit hashes of a set, None if it is empty."""
    if not len(grams):
        return [None, None]
    sums = np.array([_mixed(grams).sum(dtype=np.uint64), _mixed(~grams).sum(dtype=np.uint64)], np.uint64)
    return _mixed(sums + np.uint64(len(grams))).view(np.int64).tolist()


_LONGS = pa.list_(pa.int64())


def sketches(docs: DataFrame, seed: int = 0, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n (shingles), a and b (two hashes of the set, null if
    it is empty), parity array<long>, segments array<long>, of every row.

    A set that a batch holds again has its segments only once in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            a, b, sizes, parities, segments, seen = [], [], [], [], [], set()
            for text in batch.column(0):
                grams = shingle_hashes(text.as_py(), memo, seed)
                sizes.append(len(grams))
                both = set_hashes(grams)
                a.append(both[0])
                b.append(both[1])
                odd = np.bincount((grams & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                segments.append(segment_keys(grams, percent).view(np.int64) if both[0] not in seen else [])
                seen.add(both[0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(parities, _LONGS), pa.array(segments, _LONGS)],
                ["doc_id", "text_hash", "n", "a", "b", "parity", "segments"],
            )

    text = text_or_empty(docs)
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, a long, b long, parity array<long>, segments array<long>")


def _few(rows: DataFrame) -> DataFrame:
    """Small rows, broadcast if they are counted and at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _segments_of(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(a, fragment, grams) of the sets that `wanted` (a, row) names, computed
    again from the text of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        step = np.uint64(-(-(2**64) // OVERLAP_FRAGMENTS))
        inner = np.arange(1, OVERLAP_FRAGMENTS, dtype=np.uint64) * step
        for batch in batches:
            of, numbers, parts = [], [], []
            for text, a in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                grams = shingle_hashes(text.as_py(), memo, seed)
                if set_hashes(grams)[0] != a:
                    continue  # another text of the same text hash
                for f, part in enumerate(np.split(grams, np.searchsorted(grams, inner))):
                    of.append(a)
                    numbers.append(f)
                    parts.append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, _LONGS)], ["a", "fragment", "grams"])

    text = text_or_empty(docs)
    rows = docs.select(text.alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("of_id"), F.xxhash64(text).alias("of_hash"))
    names = wanted.select("a", F.coalesce("row.doc_id", F.lit(0)).alias("of_id"), F.col("row.text_hash").alias("of_hash"))
    met = rows.join(_few(names), ["of_id", "of_hash"]).select("text", "a").mapInArrow(run, "a long, fragment int, grams array<long>")
    found = materialise_texts(met, "ngram-segments")
    if found.count() == OVERLAP_FRAGMENTS * names.count():
        return found
    once = materialise(found.dropDuplicates(["a", "fragment"]), "ngram-segments-once")  # a row that repeats doc_id and text
    discard(found)
    return once


def _may_link(percent: int) -> Column:
    """Exact bounds on a pair with sizes nx, ny and parity maps px, py."""
    total = F.col("nx") + F.col("ny")
    flips = sum((F.bit_count(F.get("px", F.lit(k)).bitwiseXOR(F.get("py", F.lit(k)))) for k in range(PARITY_LONGS)), F.lit(0))
    sized = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    return sized & ((100 + percent) * flips <= (100 - percent) * total)


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, seed: int, percent: int) -> DataFrame:
    """The (x, y, nx, ny) of `pairs` whose overlaps, counted by fragment and
    summed, reach the threshold. Written."""
    named = pairs.select(F.col("x").alias("a")).union(pairs.select(F.col("y").alias("a"))).distinct()
    wanted = materialise(named.join(classes, "a").select("a", "row"), "ngram-wanted")
    segments = _segments_of(docs, wanted, seed)
    at = lambda c, g: segments.select(F.col("a").alias(c), "fragment", F.col("grams").alias(g))
    partial = at("x", "gx").join(_few(pairs), "x").join(at("y", "gy"), ["y", "fragment"])
    partial = partial.select("x", "y", "nx", "ny", F.size(F.array_intersect("gx", "gy")).alias("overlap"))
    summed = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("overlap").alias("overlap"))
    links = materialise(summed.where((100 + percent) * F.col("overlap") >= percent * (F.col("nx") + F.col("ny"))), "ngram-links")
    discard(segments)
    return links


def _with_figures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    of = lambda c, k: classes.select(F.col("a").alias(c), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    return pairs.join(of("x", "x"), "x").join(of("y", "y"), "y")


def _set_links(docs: DataFrame, sketched: DataFrame, classes: DataFrame, seed: int, percent: int) -> DataFrame:
    """(a, b) of linked sets, enough that components are those of all links.
    Removes `sketched`, which nothing reads once the members are written."""
    keyed = sketched.select(F.explode("segments").alias("key"), "a")
    shared = materialise(keyed.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most"), "ngram-shared")
    members = materialise(keyed.join(_few(shared), "key").distinct(), "ngram-members")
    for done in (sketched, shared):
        discard(done)
    ends = F.explode(F.array(F.col("least"), F.col("most")))
    stars = members.select("a", ends.alias("c")).where("a <> c").select(F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y")).distinct()
    stars = materialise(_with_figures(stars, classes).where(_may_link(percent)).select("x", "y", "nx", "ny"), "ngram-stars")
    links = _linked(docs, classes, stars, seed, percent)
    labels = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("v", "a")
    told = members.select("key", "a").join(labels, "a", "left").select("key", "a", F.coalesce("root", "a").alias("root"))
    told = materialise(told, "ngram-told")
    divided = materialise(told.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key"), "ngram-divided")
    rest = told.join(divided, "key").join(classes.select("a", "n", "parity"), "a")
    rest = materialise(rest, "ngram-rest")
    side = lambda c, k: rest.select("key", F.col("a").alias(c), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    met = side("x", "x").join(side("y", "y"), "key").where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & _may_link(percent))
    open_ = materialise(met.select("x", "y", "nx", "ny").distinct().join(stars, ["x", "y"], "left_anti"), "ngram-open")
    more = _linked(docs, classes, open_, seed, percent)
    return links.select("x", "y").union(more.select("x", "y")).toDF("a", "b")


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of the shingle set) and component_id (the
    smallest doc_id that links of `percent` Jaccard reach) of every row.

    Null, empty and wordless texts have an empty set and link with nothing,
    not even each other: their component_id is their own doc_id. Repeated rows
    link like other equal texts; a null doc_id comes after all others, so a
    component of nulls alone has a null component_id; an empty table gives an
    empty result; other columns are not read. Shingles are told apart by 64-bit
    hashes; sets by 64 bits, verified by 64 more (other hashes if two clash)."""
    for seed in range(8):
        sketched = materialise_texts(sketches(docs, seed, percent), "ngram-sketches")
        figures = [F.min("b").alias("b"), F.max("b").alias("c"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("parity").alias("parity")]
        classes = materialise(sketched.where("n > 0").groupBy("a").agg(*figures), "ngram-classes")
        if classes.where("b <> c").isEmpty():
            break
    else:
        raise RuntimeError("set hashes clash under every seed")
    rows = materialise(sketched.select("doc_id", F.col("n").alias("n_shingles"), "a"), "ngram-rows")
    labels = connected_components(_set_links(docs, sketched, classes, seed, percent)).withColumnRenamed("v", "a")
    rooted = materialise(classes.join(labels, "a").select("a", "root", "first"), "ngram-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    reached = materialise(rooted.join(least, "root").select("a", "least"), "ngram-reached")
    found = classes.join(reached, "a", "left").select("a", F.coalesce("least", "first").alias("component_id"))
    some = rows.where("n_shingles > 0").join(found, "a").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
