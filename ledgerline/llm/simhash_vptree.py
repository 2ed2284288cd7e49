"""SimHash near-duplicates through a vantage-point tree.

Fingerprints are 64-bit SimHashes of three-word shingles. Distinct
fingerprints are routed by a vantage-point tree over Hamming distance: a node
holds a pivot and a radius, the inside child the fingerprints within the
radius. The triangle inequality bounds what can lie near a boundary: a pair at
distance `r` or less is split by a node only if its inside member is within
`r` of the boundary, so only such members also visit the outside child, as
queries. Leaves are shards. Each shard runs the same search in memory, on down
to small blocks, and emits one spanning edge per linked fingerprint (never all
pairs of a group). The edges are contracted to components by joins.

Sizes: the depth follows the number of fingerprints, at every size alike. The
top TOP_DEPTH levels are fitted on a bounded sample and sent to all tasks;
each further STEP levels are fitted per leaf, on a bounded sample of it, and
reach the rows by an equi-join. A leaf of many members or many queries is dealt
into tiles of bounded size, so dense groups lose no link and fill no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ROW_KEY, discard, keep_judged, lowest, materialise, materialise_texts, row_key, row_order, text_or_empty

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
LEAF_TARGET = 1024  # fingerprints that live in a leaf, on average
TOP_DEPTH = 12  # levels of the tree that is broadcast: 4,095 nodes
STEP = 4  # levels of each further round
NODE_SAMPLE = 32  # fingerprints of the sample for each leaf to come
OVERSAMPLE = 4  # times that are drawn over all leaves, as leaves differ in size
HOME_BLOCK = 4 * LEAF_TARGET  # members in a tile
QUERY_BLOCK = 32 * LEAF_TARGET  # queries in a tile
_CHUNK = 1 << 16


def simhash(text: str) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 if it has no word."""
    from functools import partial

    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()  # bytes: lower-cases A-Z only, splits at \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - SHINGLE_WORDS + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    hashed = map(partial(xxh64_intdigest, seed=HASH_SEED), shingles)
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, _CHUNK):
        h = np.fromiter(hashed, np.uint64, min(_CHUNK, n - begin))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id long, the `carried` columns and fp long (the fingerprint's bits).
    Null text counts as empty, whose fingerprint is 0."""
    rows = docs.select(text_or_empty(docs).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carried)
    kept = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            fps = np.fromiter((simhash(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], StructField("fp", LongType())]))


# ------------------------------------------------------------------ tree


def _split(sample: np.ndarray, bits: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int]:
    """The pivot and radius, of a few tried, that divide the sample near its
    middle with the fewest members near the boundary."""
    best = None
    for pivot in rng.choice(sample, min(tries, len(sample)), replace=False):
        d = np.bitwise_count(sample ^ pivot)
        radius = int(np.median(d))
        inside = float((d <= radius).mean())
        near = float((np.abs(d.astype(np.int16) - radius) <= bits).mean())
        score = max(inside, 1 - inside) + near
        if best is None or score < best[0]:
            best = (score, pivot, radius)
    return best[1], best[2]


def fit_tree(sample: np.ndarray, depth: int, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and radii of a complete tree in heap order, 2**depth leaves."""
    rng = np.random.default_rng(seed)
    pivots, radii = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.int16)
    at = {0: sample}
    for node in range(2**depth - 1):
        own = at.pop(node)
        if len(own) < 2:
            own = rng.integers(0, 2**64, 16, dtype=np.uint64)
        pivots[node], radii[node] = _split(own, bits, rng)
        d = np.bitwise_count(own ^ pivots[node]) <= radii[node]
        at[2 * node + 1], at[2 * node + 2] = own[d], own[~d]
    return pivots, radii


def route(fps: np.ndarray, home: np.ndarray, tree: np.ndarray, pivots: np.ndarray, radii: np.ndarray, depth: int, bits: int):
    """(index into fps, leaf, is_home): each fingerprint's own leaf, if it is at
    home, and the leaves it must query. Row i goes down tree `tree[i]`, whose
    nodes are that row of `pivots` and `radii`."""
    idx, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), home.astype(bool)
    for _ in range(depth):
        d = np.bitwise_count(fps[idx] ^ pivots[tree[idx], node]).astype(np.int16)
        r = radii[tree[idx], node]
        inside = np.where(home, d <= r, d - bits <= r)
        # an inside member of a home pair queries outside; a query goes where its ball reaches
        outside = np.where(home, d > r, d + bits > r)
        extra = home & (d <= r) & (d + bits > r)
        idx = np.concatenate([idx[inside], idx[outside], idx[extra]])
        node_in, node_out, node_extra = 2 * node[inside] + 1, 2 * node[outside] + 2, 2 * node[extra] + 2
        home = np.concatenate([home[inside], home[outside], np.zeros(int(extra.sum()), bool)])
        node = np.concatenate([node_in, node_out, node_extra])
    return idx, node - (2**depth - 1), home


class _Labels:
    """Connected components over positions 0..n-1, label = smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def flat(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(p, q := p[p]):
            p = q
        self.parent = p
        return p


def _brute(h: np.ndarray, q: np.ndarray, fps: np.ndarray, bits: int, labels: _Labels) -> None:
    """Link every home member to what is within `bits` of it, in chunks."""
    everyone = np.concatenate([h, q])
    x = fps[everyone]
    step = max(1, (1 << 21) // max(1, len(x)))
    for begin in range(0, len(h), step):
        rows = h[begin : begin + step]
        rest = x[begin:]  # members before `begin` have met these rows already
        hit = np.bitwise_count(fps[rows][:, None] ^ rest[None, :]) <= bits
        hit[np.arange(len(rows)), np.arange(len(rows))] = False
        for i in np.flatnonzero(hit.any(axis=1)):
            near = everyone[begin:][hit[i]]
            if len(near) > 16:  # a dense group: merge by labels, not pair by pair
                near = near[np.unique(labels.flat()[near], return_index=True)[1]]
            for j in near:
                labels.union(int(rows[i]), int(j))


def _search(h: np.ndarray, q: np.ndarray, fps: np.ndarray, bits: int, labels: _Labels, rng, level: int = 0) -> None:
    """The shard's own vantage-point recursion, brute force on small blocks."""
    if len(h) == 0 or len(h) + len(q) < 2:
        return
    if len(h) <= 96 or level >= 24:
        return _brute(h, q, fps, bits, labels)
    pivot, r = _split(fps[h[:: max(1, len(h) // 256)]], bits, rng, 4)
    d = np.bitwise_count(fps[h] ^ pivot).astype(np.int16)
    dq = np.bitwise_count(fps[q] ^ pivot).astype(np.int16)
    inside, spawn = d <= r, (d <= r) & (d + bits > r)
    q_in, q_out = q[dq - bits <= r], np.concatenate([q[dq + bits > r], h[spawn]])
    work = inside.sum() * (inside.sum() + len(q_in)) + (~inside).sum() * ((~inside).sum() + len(q_out))
    if inside.all() or not inside.any() or work > 0.95 * len(h) * (len(h) + len(q)):
        return _brute(h, q, fps, bits, labels)  # no pivot divides it: a ball of near copies
    _search(h[inside], q_in, fps, bits, labels, rng, level + 1)
    _search(h[~inside], q_out, fps, bits, labels, rng, level + 1)


def spanning_edges(home: np.ndarray, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each linked member of a shard and its group's representative."""
    fps = np.concatenate([home, query])
    labels = _Labels(len(fps))
    h = np.arange(len(home))
    _search(h, np.arange(len(home), len(fps)), fps, bits, labels, np.random.default_rng(5))
    root = labels.flat()
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


# --------------------------------------------------------------- distributed


_ROUTED = "leaf long, fp long, home boolean"


def _down_top(distinct: DataFrame, depth: int, bits: int) -> DataFrame:
    """(leaf, fp, home) after the first levels, whose tree is broadcast."""
    sample = [r.fp for r in lowest(distinct.select("fp"), F.xxhash64("fp"), "fp", NODE_SAMPLE * 2**depth).collect()]
    tree = distinct.sparkSession.sparkContext.broadcast(fit_tree(np.array(sample, np.int64).view(np.uint64), depth, bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii = tree.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                fps = batch.column(0)[begin : begin + 4096].to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(fps)
                idx, leaf, home = route(fps, np.ones(n, bool), np.zeros(n, np.int64), pivots[None], radii[None], depth, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(fps[idx].view(np.int64)), pa.array(home)], ["leaf", "fp", "home"]
                )

    return distinct.select("fp").mapInArrow(send, _ROUTED)


def _down_further(routed: DataFrame, levels: int, leaves: int, n: int, bits: int, oversample: float) -> DataFrame:
    """(leaf, fp, home) some levels deeper: every leaf gets a small tree of its
    own. A leaf none of whose members is in the sample (it has few, or none)
    stays whole: its rows go to its first child."""
    wanted = NODE_SAMPLE * 2**levels
    share = min(1.0, oversample * wanted * leaves / n)
    mark = F.xxhash64(F.lit(leaves), "fp")
    members = routed.where("home").where(mark < F.lit(min(2**63 - 1, int(2**64 * share) - 2**63)))
    # a leaf may hold very many: the window is salted, and keeps `wanted` rows a leaf at most
    few = Window.partitionBy("leaf", F.pmod(mark, F.lit(wanted // 8))).orderBy("fp")
    members = members.withColumn("nth", F.row_number().over(few)).where("nth <= 8").select("leaf", "fp")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivots, radii = fit_tree(pdf["fp"].to_numpy(np.int64).view(np.uint64), levels, bits)
        return pd.DataFrame({"leaf": [key[0]], "pivots": [pivots.view(np.int64).tolist()], "radii": [radii.tolist()]})

    trees = materialise(members.groupBy("leaf").applyInPandas(fit, "leaf long, pivots array<long>, radii array<int>"), "subtrees")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                whole = part.filter(part.column(3).is_null())
                if whole.num_rows:
                    children = pa.array(whole.column(0).to_numpy(zero_copy_only=False) * 2**levels)
                    yield pa.RecordBatch.from_arrays([children, whole.column(1), whole.column(2)], ["leaf", "fp", "home"])
                leaf, fps, home, pivots, radii = part.filter(part.column(3).is_valid()).columns
                n = len(fps)
                if not n:
                    continue
                leaf = leaf.to_numpy(zero_copy_only=False)
                fps = fps.to_numpy(zero_copy_only=False).view(np.uint64)
                p = pivots.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
                r = radii.flatten().to_numpy(zero_copy_only=False).astype(np.int16).reshape(n, -1)
                idx, low, home = route(fps, home.to_numpy(zero_copy_only=False), np.arange(n), p, r, levels, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[idx] * 2**levels + low), pa.array(fps[idx].view(np.int64)), pa.array(home)],
                    ["leaf", "fp", "home"],
                )

    return routed.join(trees, "leaf", "left").select("leaf", "fp", "home", "pivots", "radii").mapInArrow(send, _ROUTED)


def routed_rows(
    distinct: DataFrame, bits: int = MAX_BITS, leaf_target: int = LEAF_TARGET, top_depth: int = TOP_DEPTH, step: int = STEP, oversample: float = OVERSAMPLE
) -> DataFrame:
    """(leaf, fp, home): each distinct fingerprint at home in one leaf of the
    whole tree, and as a query wherever a partner may live that doesn't come to
    it. Written."""
    n = distinct.count()
    depth = int(max(0, np.ceil(np.log2(max(1, n) / leaf_target))))
    if depth == 0:
        return distinct.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home"))
    done = min(depth, top_depth)
    routed = materialise(_down_top(distinct, done, bits), "routed")
    while done < depth:
        levels, above = min(step, depth - done), routed
        routed = materialise(_down_further(above, levels, 2**done, n, bits, oversample), "routed")
        if (homes := routed.where("home").count()) != n:
            raise RuntimeError(f"{homes} of {n} fingerprints are at home in the tree")
        discard(above)
        done += levels
    return routed


def tiles(routed: DataFrame, home_block: int = HOME_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(leaf, i, j, fp, home): tiles of at most about home_block members and
    query_block queries, in which all pairs of a leaf meet. Members in later
    blocks are queries of the earlier ones."""
    sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("members"), F.count_if(~F.col("home")).alias("queries"))
    blocks = F.ceil(F.col("members") / home_block).cast("int")
    visitors = F.col("queries") + F.when(F.col("members") > home_block, F.col("members")).otherwise(0)
    groups = F.greatest(F.lit(1), F.ceil(visitors / query_block).cast("int"))
    # leaves that only queries reached come along with no block, so their rows end here
    large = sizes.where((F.col("members") > home_block) | (F.col("queries") > query_block) | (F.col("members") == 0))
    large = materialise(large.select("leaf", blocks.alias("blocks"), groups.alias("groups")), "large-leaves")
    if large.isEmpty():
        return routed.select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    rows = routed.join(large, "leaf", "left").select(
        "leaf", "fp", "home", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("groups", F.lit(1)).alias("groups")
    )
    spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "fp"), F.col(n)).cast("int")
    rows = rows.withColumns({"own": F.when(F.col("home"), spot(1, "blocks")).otherwise(F.col("blocks")), "group": spot(2, "groups")})
    tile = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), home.alias("home"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: tile(F.col("own"), j, F.lit(True)))
    visits = F.transform(F.sequence(F.lit(0), F.greatest(F.col("own") - 1, F.lit(0))), lambda i: tile(i, F.col("group"), F.lit(False)))
    none = F.array().cast("array<struct<i: int, j: int, home: boolean>>")
    places = F.concat(F.when(F.col("home"), at_home).otherwise(none), F.when(F.col("own") > 0, visits).otherwise(none))
    return rows.select("leaf", "fp", F.explode(places).alias("t")).select("leaf", "t.i", "t.j", "fp", "t.home")


def linked_edges(distinct: DataFrame, bits: int = MAX_BITS, leaf_target: int = LEAF_TARGET, **levels: int) -> DataFrame:
    """(a long, b long): spanning edges whose components are those of all
    pairs of distinct fingerprints at `bits` or fewer differing bits."""

    def edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
        a, b = spanning_edges(fps[home], fps[~home], bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = routed_rows(distinct, bits, leaf_target, **levels)
    dealt = tiles(routed, HOME_BLOCK * leaf_target // LEAF_TARGET, QUERY_BLOCK * leaf_target // LEAF_TARGET)
    return dealt.groupBy("leaf", "i", "j").applyInPandas(edges, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(v, root) for every vertex of the edge list (a, b).

    Each round every vertex takes the neighbour of least random priority,
    itself included, and the graph is contracted to those; vertices shrink by
    a constant share in expectation, so rounds are logarithmic however long
    the chains are. Minima are combined before the shuffle, and the joins are
    plain equi-joins over written tables, which AQE can split at hubs."""

    def ranked(c: str):
        return F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("v"))

    pairs = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    graph = materialise(edges.where("a <> b").select(pairs.alias("e")).select("e.a", "e.b").distinct(), "graph")
    labels = materialise(graph.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v")), "labels")
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        least = graph.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        up = materialise(least.select(F.col("a").alias("child"), F.least(ranked("a"), "m")["v"].alias("parent")), "up")
        old = labels, graph
        labels = materialise(
            labels.join(up, labels["root"] == up["child"], "left").select("v", F.coalesce("parent", "root").alias("root")),
            "labels",
        )
        left = graph.join(up, graph["a"] == up["child"]).select(F.col("parent").alias("a"), "b")
        both = left.join(up, left["b"] == up["child"]).select("a", F.col("parent").alias("b"))
        graph = materialise(both.where("a <> b").distinct(), "graph")
        for table in (*old, up):
            discard(table)
    else:
        raise RuntimeError("components did not settle")
    return labels


def _components(prints: DataFrame, first: Column, bits: int, leaf_target: int) -> DataFrame:
    """(fp, least): the least `first` of all rows that a fingerprint reaches."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    labels = connected_components(linked_edges(distinct, bits, leaf_target)).withColumnRenamed("v", "fp")
    linked = materialise(labels.join(distinct, "fp"), "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = linked.join(smallest, "root").select("fp", "least")
    of_all = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return materialise(of_all, "simhash-components")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, leaf_target: int = LEAF_TARGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest
    doc_id reachable) of every row.

    Null, empty and wordless texts have fingerprint 0 and link like any other;
    repeated rows share fingerprint and component; a null doc_id comes after
    all others, so a component of nulls alone has a null component_id; an empty
    table gives an empty result; other columns are not read."""
    prints = materialise_texts(fingerprints(docs), "simhash")
    found = _components(prints, F.col("doc_id"), bits, leaf_target)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def keep_representatives(docs: DataFrame, bits: int = MAX_BITS, leaf_target: int = LEAF_TARGET) -> DataFrame:
    """The documents without near copies, columns as in `docs`: of each
    component one row stays, of smallest doc_id (null after all others), then
    least text hash. Rows are told apart by doc_id and text, so a repeated or
    null doc_id loses no unlike text; of rows alike in both one stays (see
    `keep_judged`). A null text is an empty one. An empty table stays empty."""
    prints = materialise_texts(fingerprints(docs, *row_key(docs)), "simhash")
    found = _components(prints, row_order(), bits, leaf_target)
    judged = prints.join(found, "fp").select(*ROW_KEY, (row_order() == F.col("least")).alias("kept"))
    return keep_judged(docs, judged)
