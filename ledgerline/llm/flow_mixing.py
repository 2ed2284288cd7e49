"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). Token capacity flows from each pattern to the quotas of its sources; the
first copy of a token costs nothing, the second 1, the third 3: convex
repetition costs, so repeats are spread before any pattern is repeated again.
The network has one node per pattern and source, not per document. A
pattern's flow then picks documents: whole copies of all of them, and of the
next copy, in the order of a seeded hash, run after run of those that fit the
room left. A boundary is found from sums over ranges of the hash, narrowed
until few rows lie in one. What comes out is one rule per pattern, so rows are
dealt where they are read: no text is joined or shuffled.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 1234
BUCKETS = 4096
MAX_PATTERNS = 200_000  # of all kinds; one rule each is broadcast
MAX_NODES = 20_000  # patterns in the flow network; those of one source alone mostly need none
EDGE_ROWS = 50_000  # rows in a boundary range that are ordered one by one
SPOTS = 2**40


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quotas(sizes: dict, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> dict:
    """Target of each source: 100% of all sizes shared by weight (weights
    repeat over sources in code-point order, null last), no target above
    `max_copies` times the source's size, the excess reshared by weight until
    none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    target, open_ = {}, list(order)
    while open_:
        left = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / share > max_copies * sizes[s]]
        if not above:
            target |= {s: left * weight[s] / share for s in open_}
            break
        for s in above:
            target[s] = float(max_copies * sizes[s])
        open_ = [s for s in open_ if s not in target]
    return target


class Network:
    """Min-cost flow by the primal-dual method: potentials give the least cost
    of a path, and all paths of that cost are filled at once by blocking flows,
    so the rounds follow the few different costs and not the number of arcs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, start: int) -> list:
        """Least costs from `start`; costs are small whole numbers and may be
        negative on the way back, so nodes are taken from a queue until they
        settle."""
        far = [float("inf")] * len(self.out)
        far[start], queue, waiting = 0, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and far[a] + self.cost[e] < far[b]:
                    far[b] = far[a] + self.cost[e]
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        return far

    def _levels(self, start: int, far: list) -> list[int]:
        """Steps from `start` over arcs on cheapest paths."""
        level, queue = [-1] * len(self.out), deque([start])
        level[start] = 0
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and level[b] < 0 and far[a] + self.cost[e] == far[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def _block(self, start: int, end: int, far: list, level: list[int]) -> None:
        """Fill paths of one more level each step until none is left."""
        at = [0] * len(self.out)
        path: list[int] = []
        node = start
        while True:
            if node == end:
                step = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= step
                    self.room[e ^ 1] += step
                cut = next(i for i, e in enumerate(path) if self.room[e] == 0)
                node = self.to[path[cut] ^ 1]
                del path[cut:]
            while at[node] < len(self.out[node]):
                e = self.out[node][at[node]]
                b = self.to[e]
                if self.room[e] > 0 and level[b] == level[node] + 1 and far[node] + self.cost[e] == far[b]:
                    path.append(e)
                    node = b
                    break
                at[node] += 1
            else:
                if not path:
                    return
                e = path.pop()
                node = self.to[e ^ 1]
                at[node] += 1

    def run(self, start: int, end: int) -> None:
        while (far := self._distances(start))[end] < float("inf"):
            while (level := self._levels(start, far))[end] >= 0:
                self._block(start, end, far, level)


def route_flow(capacity: dict, wanted: dict, max_copies: int = MAX_COPIES, max_nodes: int = MAX_NODES) -> dict:
    """Tokens from each pattern to each of its sources, at least cost.

    capacity: pattern (tuple of sources) -> tokens of one copy. wanted: source
    -> tokens. Each pattern offers `max_copies` parallel supplies of its
    capacity at costs 0, 1, 3, ... (convex). What no path can supply stays
    short. A source that no pattern of several sources touches takes from its
    own pattern what it wants, without the network."""
    shared = {s for p in capacity if len(p) > 1 for s in p}
    flow = {}
    for p, tokens in capacity.items():
        if len(p) == 1 and p[0] not in shared and (taken := min(round(wanted[p[0]]), max_copies * tokens)) > 0:
            flow[p, p[0]] = taken
    patterns, sources = [p for p in capacity if shared.intersection(p)], [s for s in wanted if s in shared]
    if len(patterns) > max_nodes:
        raise ValueError(f"more than {max_nodes} membership patterns overlap")
    # nodes: 0 start, then patterns, then sources, then the end
    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    end = 1 + len(patterns) + len(sources)
    net, routes = Network(end + 1), {}
    for i, pattern in enumerate(patterns, 1):
        for copy in range(max_copies):
            net.arc(0, i, capacity[pattern], copy * (copy + 1) // 2)
        for s in pattern:
            routes[pattern, s] = net.arc(i, place[s], max_copies * capacity[pattern], 0)
    for s in sources:
        net.arc(place[s], end, round(wanted[s]), 0)
    net.run(0, end)
    return flow | {key: net.room[e ^ 1] for key, e in routes.items() if net.room[e ^ 1] > 0}


def _placed(docs: DataFrame, memberships: Column | None, seed: int) -> list[Column]:
    """What a rule looks at: size, pattern key, seeded hash and mark of a row."""
    member = (memberships if memberships is not None else F.array(F.col("source"))).cast("array<string>")
    size = word_count(text_or_empty(docs))
    # rows without an id go by their text
    mark = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("unnamed"), text_or_empty(docs)))
    spot = F.pmod(F.xxhash64(F.lit(seed), mark), F.lit(SPOTS))
    # the key keeps null sources, which a join on the array's elements wouldn't
    return [size.alias("size"), member.alias("pattern"), F.to_json(member).alias("key"), spot.alias("spot"), mark.alias("mark")]


_SPOT = "struct<spot: long, mark: long>"


def _rules(rows: DataFrame, weights: tuple, max_copies: int, max_patterns: int) -> DataFrame:
    """One row per pattern: key, source_size, target, whole (copies of every
    row) and runs (ranges of (spot, mark) whose rows up to a size are taken
    once more)."""
    found = rows.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size"))
    found = found.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {r.key: tuple(dict.fromkeys(r.pattern)) for r in found}
    capacity: dict = {}
    sizes: dict = {}
    for r in found:
        capacity[members[r.key]] = capacity.get(members[r.key], 0) + r.size
        for s in members[r.key]:
            sizes[s] = sizes.get(s, 0) + r.size
    total, target = sum(capacity.values()), quotas(sizes, weights, max_copies)
    if sum(sizes.values()) > total:  # each token counts once in what is shared out
        target = {s: t * total / sum(sizes.values()) for s, t in target.items()}
    taken: dict = {}
    for (pattern, _), tokens in route_flow({p: c for p, c in capacity.items() if c}, target, max_copies).items():
        taken[pattern] = taken.get(pattern, 0) + tokens
    plan = {}
    for r in found:
        p = members[r.key]
        # keys that name one set of sources in different ways share its flow by size
        whole, part = divmod(taken.get(p, 0) * r.size // capacity[p], r.size) if r.size else (1, 0)
        plan[r.key] = {"source_size": sizes[p[0]], "target": float(target[p[0]]), "whole": whole, "runs": []}
        if part and whole < max_copies:
            plan[r.key]["room"] = part
    _fill(rows, plan)
    table = [(k, v["source_size"], v["target"], v["whole"], v["runs"]) for k, v in plan.items()]
    return rows.sparkSession.createDataFrame(
        table, f"key string, source_size long, target double, whole long, runs array<struct<after: {_SPOT}, before: {_SPOT}, room: long>>"
    )


def _fill(rows: DataFrame, plan: dict, edge_rows: int = EDGE_ROWS) -> None:
    """Run after run of rows, in order of (spot, mark), each up to the first
    row that doesn't fit the room left. Rows above the room are passed over, so
    a long document at a boundary stays out and the rows beyond it are looked
    at: each boundary row is above the room it leaves, so the room shrinks with
    the size of the rows in question. Rows that repeat a doc_id are one step,
    taken whole or not at all. Each pass begins behind the row at which the one
    before it ended, and they go on until no row that fits is left. A run is
    kept as a rule (its ends and the largest size taken), never as a list."""
    spark, at = rows.sparkSession, F.struct("spot", "mark")
    open_ = {k: (v["room"], (-1, 0)) for k, v in plan.items() if "room" in v}
    while open_:
        limits = F.broadcast(spark.createDataFrame([(k, *v) for k, v in open_.items()], f"key string, room long, start {_SPOT}"))
        fits = rows.join(limits, "key").where((at > F.col("start")) & (F.col("size") <= F.col("room")))
        edges = _edges(fits, {k: v[0] for k, v in open_.items()}, edge_rows)
        for key, (room, start) in list(open_.items()):
            if key not in edges:  # all that fit are taken
                plan[key]["runs"].append((start, (SPOTS, 0), room))
                del open_[key]
                continue
            end, taken = edges[key]
            plan[key]["runs"].append((start, end, room))
            if room > taken:
                open_[key] = (room - taken, end)
            else:
                del open_[key]


def _edges(fits: DataFrame, room: dict, edge_rows: int) -> dict:
    """key -> ((spot, mark) of the first row at which the running sum is over
    the room, the sum before it); no entry where all rows fit. The range in
    which it lies is narrowed by sums until few rows are in it; only those are
    put in order, as one row for each (spot, mark)."""
    spark, found = fits.sparkSession, {}
    ranges, width = dict.fromkeys(room, (0, 0)), SPOTS  # key -> where its range begins, sum below
    while ranges:
        width = max(1, width // BUCKETS)
        table = [(k, begin, below) for k, (begin, below) in ranges.items()]
        table = F.broadcast(spark.createDataFrame(table, "key string, begin long, below long"))
        inside = fits.join(table, "key").where((F.col("spot") >= F.col("begin")) & (F.col("spot") < F.col("begin") + width * BUCKETS))
        bucket = (F.col("spot") - F.col("begin")).cast("long") / width
        sums = inside.groupBy("key", "begin", "below", "room", F.floor(bucket).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n")
        )
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))  # BUCKETS rows a key at most
        over = sums.withColumn("upto", F.col("below") + upto).where("upto > room")
        first = over.groupBy("key").agg(F.min(F.struct("bucket", "begin", F.col("upto") - F.col("size"), "n")).alias("b"))
        ranges, few = {}, []
        for key, (bucket, begin, below, n) in ((r.key, r.b) for r in first.collect()):  # one row a key at most
            if n <= edge_rows or width == 1:
                few.append((key, begin + bucket * width, below))
            else:
                ranges[key] = (begin + bucket * width, below)
        if few:
            table = F.broadcast(spark.createDataFrame(few, "key string, begin long, below long"))
            near = fits.join(table, "key").where((F.col("spot") >= F.col("begin")) & (F.col("spot") < F.col("begin") + width))
            each = near.groupBy("key", "spot", "mark", "room", "below").agg(F.sum("size").alias("size"))
            running = F.col("below") + F.sum("size").over(Window.partitionBy("key").orderBy("spot", "mark"))
            each = each.withColumn("running", running).where("running > room")
            each = each.groupBy("key").agg(F.min(F.struct("spot", "mark", F.col("running") - F.col("size"))).alias("e"))
            found |= {r.key: ((r.e[0], r.e[1]), r.e[2]) for r in each.collect()}
    return found


def _copies(max_copies: int) -> Column:
    at = F.struct("spot", "mark")
    in_run = F.exists("runs", lambda r: (at > r["after"]) & (at < r["before"]) & (F.col("size") <= r["room"]))
    return F.least(F.col("whole") + in_run.cast("long"), F.lit(max_copies))


def mix(
    docs: DataFrame,
    memberships: Column | None = None,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row.

    memberships: array of the sources of a row, by default its `source` alone;
    source_size and target are of the row's first source. Null text has size
    0; a null source is a source of its own, last in order; rows repeating a
    doc_id in a source are dealt alike, rows without one by their text; an empty table gives an
    empty result. More than `max_patterns` membership patterns, or MAX_NODES
    that overlap, raise an error: the flow network is solved on the driver, from
    aggregated rows only."""
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_placed(docs, memberships, seed))
    rows = materialise(placed, "mix-rows")
    rules = _rules(rows, weights, max_copies, max_patterns)
    dealt = rows.join(F.broadcast(rules), "key").withColumn("copies", _copies(max_copies))  # max_patterns rows at most
    return dealt.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def repeat_rows(
    docs: DataFrame,
    memberships: Column | None = None,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """The mixed corpus itself: every row as often as `mix` takes it, with the
    columns of `docs`, whatever they are called. Null texts, sources and ids,
    repeated rows and empty tables as in `mix`."""
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_placed(docs, memberships, seed))
    rows = materialise(placed, "mix-rows")
    rules = _rules(rows, weights, max_copies, max_patterns).select("key", "whole", "runs")
    size, _, key, spot, mark = _placed(docs, memberships, seed)
    whole = F.struct(*[docs[c] for c in docs.columns])  # kept apart, whatever its columns are called
    dealt = docs.select(whole.alias("row"), size, key, spot, mark)
    dealt = dealt.join(F.broadcast(rules), "key").withColumn("copies", _copies(max_copies)).where("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
