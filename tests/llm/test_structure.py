"""Conversation repair, periodic runs and the shingle join against plain
versions; fingerprint trees of small samples; text parts cut anywhere."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat_parts, ngram_join, periodic_runs, queries, simhash_vptree, turn_repair

SF = "/root/testdata/sf0.001"


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    return sorted(tuple(x for _, x in sorted(zip(columns, row, strict=True))) for row in result.fetchall())


@pytest.mark.parametrize("name", ["op11_rank_viterbi_repair", "op13_vertical_jaccard", "op9_chat_parts", "chat_attachments"])
def test_queries_equal_their_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == by_sql(name)


# ------------------------------------------------------ conversation repair


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        for _ in range((h != 0) + (h == 3)):
            yield conv, (turn, "user" if h == 4 else role, text)


def opened(ways):
    """Ways by last initial, with up to three inserted turns after each."""
    for _ in range(3):
        for last, (cost, audit, said) in list(ways.items()):
            to = "a" if last == "u" else "u"
            way = (cost + 5, audit + "I", (*said, ({"u": "user", "a": "assistant"}[to], "")))
            if to not in ways or way[:2] < ways[to][:2]:
                ways[to] = way
    return ways


def plain_repair(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, counts, ways = set(), dict.fromkeys("bdt", 0), opened({"": (0, "", ())})
    for _, role, text in turns:
        words = text.encode().split()
        fault = "b" if not words else "d" if (role, text) in seen else "t" if words[-1][-1:] not in b".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        then = {}
        for last, (cost, audit, said) in ways.items():
            new = [(last, (cost + 2, audit + "D", said))]
            if fault not in ("b", "d"):
                price, to = 5 * (fault == "t"), "a" if last == "u" else "u"
                new.append((to, (cost + 1 + price, audit + "R", (*said, ({"u": "user", "a": "assistant"}[to], text)))))
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    new.append((role[:1], (cost + price, audit + "K", (*said, (role, text)))))
            for to, way in new:
                if to not in then or way[:2] < then[to][:2]:
                    then[to] = way
        ways = opened(then)
    cost, audit, said = min((w for last, w in ways.items() if last in ("", "a")), key=lambda w: w[:2])
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:], strict=False))
    known = {t[0] for t in turns if t[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, copies string, conv string"


def check_repair(spark, rows, block_bits):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    want = {r[0]: [] for r in rows}
    for conv, turn in damaged(rows):
        want[conv].append(turn)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(df, turn_repair.damage(df), block_bits).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == {conv: plain_repair(turns) for conv, turns in want.items()}


def test_repair_of_odd_turns(spark):
    rng = random.Random(3)
    roles, texts = [None, "", "system", "user", "assistant", "tool", "sys", "uu"], [None, "", " \n", "ok.", "no", "yes!", "what? ", "a b c", "é.", "long " * 20_000 + "."]
    rows = [(rng.choice([None, 1, 2, 3, -5]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    check_repair(spark, rows, 3)
    check_repair(spark, [(4, 13, "user", "x."), (9, None, None, None)], 12)
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair(none, turn_repair.damage(none)).collect() == []


def test_repair_of_one_long_conversation_in_many_chunks(spark):
    rng = random.Random(5)
    check_repair(spark, [(7, i, rng.choice(["user", "assistant", "tool", "system"]), f"{rng.randint(0, 900)}{rng.choice(['.', '', '!'])}") for i in range(1500)], 5)


def test_fix_up_equals_a_whole_run_from_any_end():
    rng = np.random.default_rng(1)
    for _ in range(200):
        codes = rng.integers(0, 8, rng.integers(0, 30)).astype(np.int8)
        end = rng.integers(0, 12, 4)
        fixed, whole = turn_repair.fix_up(codes, turn_repair.backward(codes, turn_repair.AT_END), end), turn_repair.backward(codes, end)
        assert (fixed == whole).all() or all(turn_repair.alike(x, y) for x, y in zip(fixed, whole, strict=True))


# ------------------------------------------------------------ periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_equal_plain_search():
    rng = random.Random(1)
    for _ in range(80):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 11, 12, 13, 30, 100, 300]), rng.choice([1, 2, 2, 3, 50])
            words = [rng.randint(1, k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(words)
        got = periodic_runs.runs_of([np.array(t, np.int32) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [sorted(plain_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_run_digests_of_planted_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 150)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "w " * 5000), (904, "one"), (None, "x y " * 30), (904, "one")]
    df = spark.createDataFrame([(i, t, "r", "w") for i, t in rows], "doc_id long, text string, runs string, w string")
    got = sorted((tuple(r) for r in periodic_runs.runs_of_planted(df).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    want = []
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *told, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=str)
    assert periodic_runs.runs_of_planted(df.where("false")).collect() == []


# ------------------------------------------------------------- shingle join


def plain_links(rows, percent):
    sets, least = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else []))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                least[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), (True, 0)), (doc is None, doc or 0))
    return sorted(((doc is None, doc or 0), len(s), first[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_links_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 30)) for _ in range(rng.choice([3, 8, 15, 25, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(words))
            words[k] = f"x{rng.randint(0, 50)}"
            if rng.random() < 0.3:
                words.insert(k, "y")
        rows.append((rng.choice([None, i, i, i, i - 1]), " ".join(words)))
    rows += [(500, None), (501, ""), (502, " "), (503, "one"), (504, "one"), (505, "one two"), (506, "ONE Two"), (507, "z " * 60_000)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    for percent in (90, 75):
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, (r.component_id is None, r.component_id or 0)) for r in ngram_join.link_components(df, percent).collect())
        assert got == plain_links(rows, percent)
    assert ngram_join.link_components(df.where("false")).collect() == []


def test_linked_sets_share_a_segment_key():
    """The pigeonhole bound, on pairs that only just link."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(10, 400))
        lost = int(rng.integers(0, n // 19 + 1))
        added = 0
        while 100 * (n - lost) >= 90 * (n + added + 1):
            added += 1
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        y = np.concatenate([x[lost:], rng.integers(0, 2**64, added, dtype=np.uint64)])
        assert len(np.intersect1d(ngram_join.segment_keys(np.unique(x)), ngram_join.segment_keys(np.unique(y)))), (n, lost, added)


# ------------------------------------------- trees of small samples, parts


@pytest.mark.parametrize("oversample", [4, 0.02])
def test_leaves_outside_the_sample_keep_their_rows(spark, oversample):
    """A dense ball, a few outliers alone in their leaves, and their partners."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {flipped(centre, 3) for _ in range(3000)}
    far = [rng.getrandbits(64) for _ in range(10)]
    fps |= set(far) | {flipped(x, 2) for x in far}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    options = {"leaf_target": 64, "top_depth": 1, "step": 1, "oversample": oversample}
    assert sorted(r.fp % 2**64 for r in simhash_vptree.routed_rows(df, **options).where("home").collect()) == fps
    root = {x: x for x in fps}
    bits = np.array(fps, np.uint64)
    todo = set(fps)
    while todo:
        start, todo_now = min(todo), [min(todo)]
        while todo_now:
            x = todo_now.pop()
            if x in todo:
                todo.discard(x)
                root[x] = start
                todo_now += [int(y) for y in bits[np.bitwise_count(bits ^ np.uint64(x)) <= 3] if int(y) in todo]
    labels = {r.v % 2**64: r.root for r in simhash_vptree.connected_components(simhash_vptree.linked_edges(df, **options)).collect()}
    groups: dict = {}
    for x in fps:
        groups.setdefault(root[x], set()).add(labels.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_text_parts_cut_anywhere_read_back(spark):
    controls = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "[\\\\/INST]", "<|image:1|>"]
    rows = []
    for text in controls:
        for cut in range(len(text) + 1):
            for how in ("joined", "placed"):
                rows.append((len(rows), text, cut, how))
    df = spark.createDataFrame(rows, "conv_id long, whole string, cut int, how string")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    left, right = part("text", F.expr("left(whole, cut)")), part("text", F.expr("substring(whole, cut + 1)"))
    parts = F.when(F.col("how") == "joined", F.array(left, right, part("text", F.lit(None)))).otherwise(F.array(left, part("image", F.lit(None)), right))
    turns = df.select("conv_id", F.lit(0).alias("turn"), F.lit("assistant").alias("role"), parts.alias("parts"), "whole", "cut", "how")
    out = chat_parts.format_turns(turns).join(df, "conv_id")
    out = out.select("whole", "cut", "how", "formatted", chat_parts.read_back(F.col("formatted")).alias("turns"), chat_parts.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        want = r.whole if r.how == "joined" else f"{r.whole[: r.cut]}<|image:1|>{r.whole[r.cut :]}"
        assert [tuple(t) for t in r.turns] == [("assistant", want)] and r.loss == want
        assert r.formatted.count("<|end|>") == 1 and r.formatted.count("</s>") == 0


# -------------------------------------------------------------- mixing, whole


def test_mix_equals_a_plain_greedy_mix(spark):
    """The whole query on rows of one source each: targets by water filling,
    whole copies, then in seeded order whatever fits the room that is left."""
    from ledgerline.llm import flow_mixing

    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 3, 8, 40, 300])), rng.choice([None, "a", "b", "b", "c", "d", "d", "d"])) for i in range(400)]
    rows += [(7, "same id again " * 5, "b"), (8, "x " * 3000, "a"), (401, None, "c"), (402, "", "only nothing")]
    docs = spark.createDataFrame([(i, " ".join(t) if t and len(set(t)) == 1 else t, s) for i, t, s in rows], "doc_id long, text string, source string")
    placed = docs.select("source", *flow_mixing._placed(docs, None, flow_mixing.SEED)).collect()
    sizes: dict = {}
    for r in placed:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:  # raise all by weight, close those that are full, until none is above
        open_ = [s for s in order if s not in target]
        rest = left - sum(target.values())
        full = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not full:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: float(3 * sizes[s]) for s in full}
    want = []
    for s in order:
        whole, room = divmod(round(target[s]), sizes[s]) if sizes[s] else (1, 0)
        steps: dict = {}
        for r in (r for r in placed if r.source == s):
            steps.setdefault((r.spot, r.mark), []).append(r.size)
        for step in sorted(steps):
            taken = whole < 3 and sum(steps[step]) <= room
            room -= sum(steps[step]) * taken
            want += [(s or "~", step[1], n, min(3, whole + taken) * n) for n in steps[step]]
    got = [(r.source or "~", r.doc_id, r.size, r.taken) for r in flow_mixing.mix(docs).join(docs.select("doc_id", "source", flow_mixing.word_count(F.coalesce("text", F.lit(""))).alias("size")), ["doc_id", "size"]).collect()]
    assert sorted(set(got)) == sorted(set(want))
    assert {round(r.target, 6) for r in flow_mixing.mix(docs).select("target").distinct().collect()} == {round(t, 6) for t in target.values()}
