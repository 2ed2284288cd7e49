"""Repair of conversation structure by rank-convergence parallel Viterbi.

A repaired conversation's role initials read `(s?(ua)+)?`. Each row is kept,
given another role or deleted, and empty turns may be inserted; a trellis over
four states (nothing yet, after system, user, assistant) has the cost of every
choice. Rows are cut into chunks of bounded size wherever a conversation lies,
so one of any length is many tasks' work:

1. Every chunk computes its backward cost vectors at once, from a speculative
   vector at its end (the true one, if the conversation ends there).
2. Fix-up passes: a chunk whose end vector isn't its successor's first vector,
   up to a constant, runs again from that, and stops as soon as its new vector
   differs from its old one only by a constant, for then all earlier ones do.
   Passes end when every chunk agrees with its successor.
3. The stitched backward costs drive the tracing: from each state, the least
   edit letter (D, I, K, R) that stays cheapest. Chunks trace from all states
   they may be entered in; their short lists of exits are put one after another
   to find the state each one is entered in.

Blank and repeated rows must be deleted at the same cost in every state, so
they shift a vector by a constant and need no step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_BITS = 12  # rows of a chunk, as a power of two
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 10**9
_INSERTED = np.array([USER, USER, ASSISTANT, USER])  # what may be inserted, and the state after it
_KEPT = {("s", NOTHING): SYSTEM, ("a", USER): ASSISTANT} | {("u", s): USER for s in (NOTHING, SYSTEM, ASSISTANT)}
_INITIALS = "sua"
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _then(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (x[:, :, None] + y[None]).min(axis=1)


def _inserting() -> np.ndarray:
    once = np.full((4, 4), _NEVER)
    once[np.arange(4), _INSERTED] = INSERT
    none = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    return np.minimum(np.minimum(none, once), _then(once, once))


def _row_costs(initial: int, unfinished: int) -> np.ndarray:
    step = np.full((4, 4), _NEVER)
    step[np.arange(4), np.arange(4)] = DELETE
    for s in range(4):
        step[s, _INSERTED[s]] = min(step[s, _INSERTED[s]], REROLE + UNFINISHED * unfinished)
        to = _KEPT.get((_INITIALS[initial], s)) if initial < 3 else None
        if to is not None:
            step[s, to] = min(step[s, to], UNFINISHED * unfinished)
    return step


INSERTING = _inserting()
# a row's code: 0 to 3 for initial s, u, a or another, 4 more if its text is unfinished
STEPS = np.array([_then(INSERTING, _row_costs(code % 4, code // 4)) for code in range(8)])
AT_END = np.minimum(INSERTING[:, NOTHING], INSERTING[:, ASSISTANT])


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost from before each row, and after the last, by state."""
    costs = np.empty((len(codes) + 1, 4), np.int64)
    costs[-1] = end
    for i in range(len(codes) - 1, -1, -1):
        costs[i] = (STEPS[codes[i]] + costs[i + 1]).min(axis=1)
    return costs


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether vectors differ only by a constant."""
    d = x - y
    return bool((d == d[0]).all())


def fix_up(codes: np.ndarray, costs: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`backward` from another end, taking over `costs` from where both have
    converged."""
    costs = costs.copy()
    new = end
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            new = (STEPS[codes[i]] + new).min(axis=1)
        if alike(new, costs[i]):
            costs[: i + 1] += new[0] - costs[i][0]
            break
        costs[i] = new
    return costs


def trace(codes: np.ndarray, deletes: np.ndarray, costs: np.ndarray, state: int, last: bool) -> tuple[list[str], list[tuple[int, int]], int, int]:
    """(letters, messages, state after, cost) of a chunk entered in `state`.

    `codes` has -1 for a row that must go, `deletes` how many must go at each
    row (after its first copy, if that is coded). A message is (row or -1 for
    an inserted one, state after it if its role is new, else -1)."""
    letters: list[str] = []
    messages: list[tuple[int, int]] = []
    total = at = 0
    for row, code in enumerate(codes.tolist()):
        if code >= 0:
            while costs[at + 1][state] + DELETE != costs[at][state] and costs[at][_INSERTED[state]] + INSERT == costs[at][state]:
                state = int(_INSERTED[state])
                letters.append("I")
                messages.append((-1, state))
                total += INSERT
            extra = UNFINISHED * (code // 4)
            to = _KEPT.get((_INITIALS[code % 4], state)) if code % 4 < 3 else None
            if costs[at + 1][state] + DELETE == costs[at][state]:
                letters.append("D")
                total += DELETE
            elif to is not None and costs[at + 1][to] + extra == costs[at][state]:
                letters.append("K")
                messages.append((row, -1))
                state, total = to, total + extra
            else:
                state = int(_INSERTED[state])
                letters.append("R")
                messages.append((row, state))
                total += REROLE + extra
            at += 1
        if deletes[row]:
            letters.append("D" * int(deletes[row]))
            total += DELETE * int(deletes[row])
    while last and state not in (NOTHING, ASSISTANT):
        state = int(_INSERTED[state])
        letters.append("I")
        messages.append((-1, state))
        total += INSERT
    return letters, messages, state, total


# --------------------------------------------------------------- distributed


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults planted by the hash of
    conv_id and turn; nulls are one space there and in role and text."""
    space = F.lit(" ")
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(told.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("h <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("h") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def conversation_key(conv_id: Column) -> Column:
    """Never null: a null conv_id is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def in_order(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct rows with their copies, sorted by conversation, turn (null
    first), role and text over all tasks, and numbered: `at` rises in that
    order, `block` is the chunk's number, `fault` the row's own. Written."""
    whole = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keys = ["conv_id", "turn", "role", "text"]
    ordered = whole.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    final = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(final == "", F.lit("blank")).when(~final.isin(".", "!", "?"), F.lit("truncated"))
    triple = ["conv_id", "role", "text"]
    return materialise(
        ordered.withColumns({
            "conv": conversation_key(F.col("conv_id")), "fault": fault, "block": F.shiftright("at", block_bits),
            "a": F.xxhash64(F.col("conv_id").isNull(), *triple), "b": F.xxhash64(F.lit(1), F.col("conv_id").isNull(), *triple),
        }),
        "turns-in-order",
    )


_CHUNK = (
    "conv string, conv_id long, block long, ats array<long>, codes binary, deletes array<long>, costs binary, start array<long>, end array<long>, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string"
)
_LEGAL = ("su", "ua", "au")


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per conversation and block, its backward costs from the
    speculative end (that of a conversation's end). Written."""
    again = materialise(rows.groupBy("a", "b").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1"), "turns-again")
    light = rows.select("conv", "conv_id", "block", "at", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "a", "b")
    light = light.join(again, ["a", "b"], "left").withColumn("later", F.coalesce(F.col("at") > F.col("earliest"), F.lit(False)))
    row = F.struct("at", "initial", "fault", "copies", "later")
    grouped = light.groupBy("conv", "block").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, conv_id, block, rows in batch.itertuples(index=False):
                codes = np.full(len(rows), -1, np.int8)
                deletes = np.zeros(len(rows), np.int64)
                blank = duplicate = truncated = illegal = 0
                before = None
                for k, r in enumerate(rows):
                    initial, fault, n = r["initial"], r["fault"], int(r["copies"])
                    illegal += n - 1 + (before is not None and before + initial not in _LEGAL)
                    before = initial
                    if fault == "blank" or r["later"]:
                        deletes[k] = n
                        blank, duplicate = blank + n * (fault == "blank"), duplicate + n * (fault != "blank")
                        continue
                    deletes[k] = n - 1
                    duplicate += n - 1
                    truncated += fault == "truncated"
                    codes[k] = (_INITIALS.find(initial) if initial and initial in _INITIALS else 3) + 4 * (fault == "truncated")
                costs = backward(codes[codes >= 0], AT_END)
                ats = [r["at"] for r in rows]
                figures = (blank, duplicate, truncated, illegal, rows[0]["initial"], before)
                out.append((conv, conv_id, block, ats, codes.tobytes(), deletes, costs.tobytes(), costs[0], AT_END, *figures))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNK.split(", ")]).astype({"conv_id": "Int64"})

    return materialise(grouped.select("conv", "conv_id", "block", "rows").mapInPandas(run, _CHUNK), "turn-chunks")


def _stitched(chunks: DataFrame) -> tuple[DataFrame, int]:
    """The chunks with the block after theirs (`then`) and costs that agree
    with it up to a constant; and the number of fix-up passes."""
    # no texts or costs in this window: a conversation has one short row per chunk in it
    along = Window.partitionBy("conv").orderBy("block")
    links = chunks.select("conv", "block", F.lead("block").over(along).alias("then"), F.lead("first").over(along).alias("then_first"), (F.count("*").over(Window.partitionBy("conv")) > 1).alias("parted"))
    chunks = materialise(chunks.join(links, ["conv", "block"]), "turn-chunks-linked")
    whole, parted, passes = chunks.where("not parted"), chunks.where("parted"), 0
    same = F.size(F.array_distinct(F.zip_with("end", "wanted", lambda x, y: x - y))) == 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch.index[batch["wanted"].notna()]:
                codes = np.frombuffer(batch.at[i, "codes"], np.int8)
                costs = np.frombuffer(batch.at[i, "costs"], np.int64).reshape(-1, 4)
                costs = fix_up(codes[codes >= 0], costs, np.asarray(batch.at[i, "wanted"], np.int64))
                batch.at[i, "costs"] = costs.tobytes()
                batch.at[i, "start"], batch.at[i, "end"] = costs[0], costs[-1]
            yield batch.drop(columns="wanted")

    while True:
        starts = parted.select("conv", F.col("block").alias("then"), F.col("start").alias("wanted"))
        met = parted.join(starts, ["conv", "then"], "left").select(*parted.columns, F.when(~same, F.col("wanted")).alias("wanted"))
        met = materialise(met, "turn-chunks-met")
        if met.where("wanted is not null").isEmpty():
            return whole.unionByName(parted), passes
        schema = parted.schema
        parted, passes = materialise(met.mapInPandas(run, schema), "turn-chunks-fixed"), passes + 1


def _entered(chunks: DataFrame) -> DataFrame:
    """The chunks with the state they are entered in."""

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, block, codes, deletes, costs in batch.itertuples(index=False):
                codes, costs = np.frombuffer(codes, np.int8), np.frombuffer(costs, np.int64).reshape(-1, 4)
                out.append((conv, block, [trace(codes, deletes, costs, s, False)[2] for s in range(4)]))
            yield pd.DataFrame(out, columns=["conv", "block", "exits"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, states = pdf.sort_values("block"), [NOTHING]
        for of_chunk in pdf["exits"]:
            states.append(int(of_chunk[states[-1]]))
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "state": states[:-1]})

    ways = chunks.where("parted").select("conv", "block", "codes", "deletes", "costs").mapInPandas(exits, "conv string, block long, exits array<int>")
    states = ways.groupBy("conv").applyInPandas(follow, "conv string, block long, state int")
    parted = chunks.where("parted").join(states, ["conv", "block"])
    return chunks.where("not parted").withColumn("state", F.lit(NOTHING)).unionByName(parted)


_EDITS = "conv string, conv_id long, block long, audit string, cost long, messages array<struct<at: long, role: string>>, blank long, duplicate long, truncated long, illegal long"


def edits(rows: DataFrame) -> DataFrame:
    """Per conversation and block of `in_order` rows: audit letters, cost,
    messages (at of the row or null for an inserted one, role if it is new) and
    the counted faults. Written."""
    chunks, _ = _stitched(_chunks(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c in batch.itertuples(index=False):
                codes, costs = np.frombuffer(c.codes, np.int8), np.frombuffer(c.costs, np.int64).reshape(-1, 4)
                last = c.then is None or pd.isna(c.then)
                letters, messages, _, cost = trace(codes, c.deletes, costs, c.state, last)
                told = [{"at": int(c.ats[row]) if row >= 0 else None, "role": _ROLES.get(state)} for row, state in messages]
                illegal = c.illegal + (not last and c.last + c.then_first not in _LEGAL)
                out.append((c.conv, c.conv_id, c.block, "".join(letters), cost, told, c.blank, c.duplicate, c.truncated, illegal))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _EDITS.split("array")[0].split(", ")[:5]] + ["messages", "blank", "duplicate", "truncated", "illegal"]).astype({"conv_id": "Int64"})

    return materialise(_entered(chunks).mapInPandas(run, _EDITS), "turn-edits")


def repaired_turns(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, conv, block, nth, role, text) of the repaired conversations in
    order of block and nth, from `in_order` rows and their `edits`."""
    told = made.select("conv_id", "conv", "block", F.posexplode("messages").alias("nth", "m")).select("conv_id", "conv", "block", "nth", "m.at", F.col("m.role").alias("new"))
    inserted = told.where("at is null").select("conv_id", "conv", "block", "nth", F.col("new").alias("role"), F.lit("").alias("text"))
    kept = told.where("at is not null").join(rows.select("at", "role", "text"), "at")
    return kept.select("conv_id", "conv", "block", "nth", F.coalesce("new", "role").alias("role"), "text").unionByName(inserted)


def text_hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the `role:text` lines of each conversation.

    A hash reads its text from front to end, so each conversation is one
    stream: rows are sorted by Spark, which spills, and a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != held:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], ["conv", "repaired_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    rows = repaired.repartition("conv").sortWithinPartitions("conv", "block", "nth").select("conv", "role", "text")
    return rows.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Per conv_id of `conversations`: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 of its rows in `turns` (conv_id,
    turn, role, text, copies).

    Rows go by turn, a null one first, ties by role, then text. Roles and texts
    must not be null (`damage` makes them one space). A conversation without
    rows in `turns` has zeros, an empty audit and the hash of the empty string;
    a null conv_id is a conversation of its own; an empty table gives an empty
    result; other columns are not read. A conversation's audit is one value."""
    rows = in_order(turns, block_bits)
    made = edits(rows)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    told = made.groupBy("conv").agg(letters.alias("audit"), *[F.sum(c).alias(c) for c in sums])
    numbered = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).withColumn("turn", F.col("turn").cast("decimal(20,0)"))
    gap = (F.max("turn") - F.min("turn") + 1 - F.count("*")).try_cast("long")
    gaps = numbered.groupBy("conv").agg(gap.alias("gaps"))
    hashes = text_hashes(repaired_turns(rows, made))
    named = conversations.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    found = named.join(told, "conv", "left").join(gaps, "conv", "left").join(hashes, "conv", "left")
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *sums)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
