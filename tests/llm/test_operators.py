"""Training-data operators against brute-force versions and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import (
    bfd_packing,
    bpe_counts,
    chat_parts,
    chunk_recipes,
    flow_mixing,
    harmonic_packing,
    kneser_ney,
    order_minhash,
    quality_cotraining,
    simhash_vptree,
    wordbpe,
)
from ledgerline.llm.wordbpe import id_encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, FP string, `copies` int"
LONG = "".join(f"word{i * i % 977} " for i in range(9000))
ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \t\n", "en", None), (4, "one two", "en", "a"), (5, "one  two", "en", "a"),
    (5, "one  two", "en", "a"), (6, LONG, "de", "a"), (7, LONG, None, "b"), (8, "Ünïcode ΑΣ <|endoftext|> 12 !!", "fr", "b"),
    (9, "single", "en", "c"), (10, " one two", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1) for i, t, la, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        bpe_counts.count_tokens(none), bfd_packing.pack_matrices(none), simhash_vptree.near_duplicates(none),
        harmonic_packing.pack(none), flow_mixing.mix(none), kneser_ney.identify(none), order_minhash.fingerprints(none),
        chunk_recipes.exact_groups(none), quality_cotraining.score(none, labels),
    ):
        assert df.collect() == []


def test_counts_equal_the_library(docs):
    tk = hf()
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_counts.count_tokens(docs).collect())
    want = []
    for i, t, *_ in ODD:
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)


@pytest.mark.parametrize("text", ["I'LL don't 're", "½²３ a_b__", "İstanbul ΑΣ", "a\x1cb\x85c\xa0d", "你好 é Å", "x<|startoftext|>y"])
def test_ids_and_counts_on_odd_texts(text):
    ids = hf().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(id_encoder(vocabulary_path())(text), "<u4").tolist() == ids
    assert bpe_counts.token_counter(vocabulary_path())(text) == len(ids)


def test_ids_of_new_words_need_merging_alone(monkeypatch):
    tk, asked = hf(), []

    class Counted:
        def __init__(self, path):
            self.of = type(tk).from_file(path)

        def __getattr__(self, name):
            asked.append(name)
            return getattr(self.of, name)

        from_file = classmethod(lambda cls, path: cls(path))

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    monkeypatch.setattr(wordbpe, "_id_encoders", {})
    encode = id_encoder(vocabulary_path())
    plain = [chr(x) for x in range(0x250) if wordbpe.is_plain(chr(x))]
    for text in [f"qa{c}zé{c}{c}1 {c}'s" for c in plain] + ["étiontretion' laèoipaier, don't" + "etle" * 100]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids
    assert "encode" not in asked
    encode("你好")
    assert asked.count("encode") == 1


def test_bfd_is_lossless_and_best_fit(docs):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400).tolist()
    bins = bfd_packing.best_fit_decreasing(lengths, 100)
    rooms, expect = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(100 - n)
            expect += 1
    assert len(bins) == expect and sorted(i for b in bins for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    found: dict = {}
    for r in bfd_packing.pack_matrices(docs).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 4096 and r.cu_seqlens[-1] == r.n_tokens
        for k, (d, s) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            found.setdefault(d, []).append((s, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    tk = hf()
    for i, t, *_ in ODD:
        whole = tk.encode(t or "", add_special_tokens=False).ids + [2]
        parts = [x for _, p in sorted(found[i]) for x in p]
        assert parts == (whole * 2 if i == 5 else whole)


def reference_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    parent = {i: i for i, _ in pairs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in pairs:
        for b, y in pairs:
            if a < b and (x ^ y).bit_count() <= 3:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in parent}


def test_simhash_against_brute_force(docs):
    prints = {i: reference_simhash(t) for i, t, *_ in ODD}
    got = simhash_vptree.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    want = brute_components(sorted(prints.items()))
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got)


def test_tree_search_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    flips = [x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for x in base[:150] for k in (1, 2, 3, 5)]
    ball = [base[0] ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(25) for j in range(i)]
    chain = [np.uint64((1 << k) - 1) for k in range(0, 64, 3)]
    fps = np.unique(np.concatenate([base, flips, ball, chain]).astype(np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    labels = simhash_vptree.connected_components(simhash_vptree.linked_edges(df, leaf_target=16)).collect()
    got = {r.v: r.root for r in labels}
    want = brute_components([(i, int(x)) for i, x in enumerate(fps)])
    group: dict = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        group.setdefault(want[i], set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


def test_harmonic_packing_round_trip(docs):
    got = harmonic_packing.pack(docs, capacity=256, classes=8, rows_per_block=5).toPandas()
    tk = hf()
    for i, t, *_ in ODD:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == i].sort_values("start")
        if i != 5:
            assert own.length.sum() == len(ids) and own.start.tolist() == [0, *own.length.cumsum()[:-1].tolist()]
        for r in own.itertuples():
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1].tolist()] and s.length.sum() <= 256


def test_piece_lengths_cover():
    for n in range(1, 9000, 7):
        assert sum(harmonic_packing.piece_lengths(n)) == n


def test_mixing(spark, docs):
    sizes = {"a": 100, "b": 1000, None: 10}
    q = flow_mixing.quotas(sizes)
    assert q["a"] == 300 and q[None] == 30 and abs(sum(q.values()) - 1110) < 1e-6
    flow = flow_mixing.route_flow({("a",): 100, ("a", "b"): 100, ("b",): 50}, {"a": 150, "b": 100})
    assert flow == {(("a",), "a"): 100, (("a", "b"), "a"): 50, (("a", "b"), "b"): 50, (("b",), "b"): 50}
    rows = [(i, "w " * (1 + i % 40), "en", "abc"[i % 3] if i % 17 else None, 1) for i in range(3000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = flow_mixing.mix(many).toPandas().set_index("doc_id").sort_index()
    got["source"] = [r[3] or "~" for r in rows]
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() / by.target).max() < 0.01 and (got.taken <= 3 * got["size"]).all()
    again = flow_mixing.mix(many.repartition(7)).toPandas().set_index("doc_id")
    assert (again.taken.sort_index() == got.taken).all()
    repeated = flow_mixing.repeat_rows(many)
    assert repeated.columns == many.columns and repeated.count() == got.copies.sum()
    assert flow_mixing.repeat_rows(docs).columns == docs.columns and flow_mixing.mix(docs).count() == len(ODD)


def test_mixing_passes_over_long_documents(spark):
    # one document of a sixth of its source at the boundary, many that fit beyond it
    sizes = [20] * 3000
    rows = [(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes)]
    for long in range(40):
        mixed = [(i, t, s) if i != long else (i, "w " * 6000, s) for i, t, s in rows]
        found = {s: [(xxhash_spot(i), i) for i, _, x in mixed if x == s] for s in "ab"}
        s = "ab"[long % 2]
        order = sorted(found[s])
        if 0.45 < order.index((xxhash_spot(long), long)) / len(order) < 0.6:
            break
    else:
        raise AssertionError("no document near the boundary")
    docs = spark.createDataFrame(mixed, "doc_id long, text string, source string")
    weights = (2, 5) if s == "a" else (5, 2)
    got = flow_mixing.mix(docs, weights=weights).toPandas().set_index("doc_id").sort_index()
    got["source"] = [r[2] for r in mixed]
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by.target - by.taken).between(-1, 21).all()
    assert flow_mixing.repeat_rows(docs, weights=weights).count() == got.copies.sum()


def xxhash_spot(i):
    seeded = xxhash.xxh64_intdigest(flow_mixing.SEED.to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seeded) % 2**40


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kneser_ney.identify(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [kneser_ney.crc_remainder(i) == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and not got.rejected.any() and got.score.between(0, 1).all()


def plain_kneser_ney(counts):
    """Interpolated Kneser-Ney by plain loops: P(c | a, b) of one language."""
    letters = {x for g in counts for x in g}
    pairs: dict = {}
    for g in counts:
        pairs[g[1:]] = pairs.get(g[1:], 0) + 1
    ones: dict = {}
    for g in pairs:
        ones[g[1]] = ones.get(g[1], 0) + 1

    def discount(table):
        n1, n2 = (sum(n == k for n in table.values()) for k in (1, 2))
        return min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.0))

    def level(table, context, lower):
        d = discount(table)
        own = [n for g, n in table.items() if g[:-1] == context]
        return lambda c: lower(c) if not own else max(table.get(context + c, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * lower(c)

    def p(a, b, c, vocabulary):
        d = discount(ones)
        lowest = lambda x: max(ones.get(x, 0) - d, 0) / sum(ones.values()) + d * len(ones) / sum(ones.values()) / vocabulary
        return level(counts, a + b, level(pairs, b, lowest))(c)

    return letters, p


def model_probability(model, lang, gram):
    at = model.langs.index(lang)
    return float(np.exp(model.floor[at] + model.log_weights(kneser_ney.gram3(np.array([*map(ord, gram)], np.uint32)))[at]))


def trigrams(text):
    found: dict = {}
    for i in range(len(text) - 2):
        found[text[i : i + 3]] = found.get(text[i : i + 3], 0) + 1
    return found


def test_language_model_against_plain_kneser_ney(spark):
    told = {"x": " abracadabra abba cab bacca ", "y": " dada adda cada bad add "}
    counts = {(lang, g): n for lang, text in told.items() for g, n in trigrams(text).items()}
    whole = kneser_ney.model_of(counts, spark)
    few = kneser_ney.model_of(counts, spark, model_types=20)  # of more trigram and pair types
    letters = {x for text in told.values() for x in text}
    v, contexts = len(letters) + 1, [(a, b) for a in sorted(letters) for b in sorted(letters)]
    assert len(few.keys) < len(whole.keys)
    same = 0
    for lang, text in told.items():
        _, p = plain_kneser_ney(trigrams(text))
        for a, b in contexts:
            every = [*sorted(letters), "z"]
            want = [p(a, b, c, v) for c in every]
            got = [model_probability(whole, lang, a + b + c) for c in every]
            assert np.allclose(got, want, rtol=1e-5)
            pruned = [model_probability(few, lang, a + b + c) for c in every]
            assert abs(sum(got) - 1) < 1e-5 and abs(sum(pruned) - 1) < 1e-5
            same += sum(abs(x - y) < 1e-5 for x, y, c in zip(pruned, want, every, strict=True) if a + b + c in trigrams(text))
    assert same >= 20  # the types that stay keep their probability


def test_language_model_of_many_languages(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        alphabet = rng.choice(np.arange(97, 97 + 400), 12, replace=False)
        rows += [(f"l{k}", int(g), int(n)) for g, n in zip(*np.unique(kneser_ney.gram3(rng.choice(alphabet, 3000).astype(np.uint32)), return_counts=True), strict=True)]
    counts = spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    found, floors = kneser_ney.features(counts)
    model = kneser_ney.gathered(found, floors)
    assert len(model.langs) == 200 and model.nbytes() <= 22 * found.count() + 8  # seen types only, not types x languages
    with pytest.raises(ValueError):
        kneser_ney.gathered(found, floors, model_bytes=1000)


def test_language_id_keeps_the_most_frequent_types(spark):
    counts = spark.createDataFrame([("a", i, 1 + i // 40) for i in range(400)] + [("b", i, 7) for i in range(100)], "lang string, gram long, n long")
    share = {(r.lang, r.gram): r.n / {"a": 2200, "b": 700}[r.lang] for r in counts.collect()}
    for limit in (0, 1, 37, 250, 499, 500, 900):
        got = [(r.lang, r.gram) for r in kneser_ney.most_frequent(counts, limit).collect()]
        assert len(got) == len(set(got)) == min(limit, 500)
        left = share.keys() - set(got)
        if got and left:
            assert max(share[g] for g in left) <= min(share[g] for g in got) * 2 ** (1 / 64)


def test_language_id_rejects(spark, docs):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = kneser_ney.train(known)
    odd = spark.createDataFrame([(1, "你好世界" * 20), (2, "12 !!"), (3, None), (4, "the and of thing")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in kneser_ney.identify(odd, model).collect()}
    assert got[1][1] and got[2] == ("und", True) and got[3] == ("und", True) and got[4] == ("en", False)
    assert kneser_ney.identify(docs, model).count() == len(ODD)
    # one label in a hundred is wrong: random letters and a Latin-script language not learned still go
    wrong = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(100)) == 0, F.lit("de")).otherwise(F.col("lang"))
    model = kneser_ney.train(known.where("lang <> 'es'").withColumn("lang", wrong))
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz     "], 400)) for _ in range(50)]
    spanish = [r.text for r in known.where("lang = 'es' and n_chars > 500").collect()]
    english = [r.text for r in known.where("lang = 'en' and n_chars > 200").collect()]
    gone = [np.mean([kneser_ney.judged(model, t)[2] for t in texts]) for texts in (noise, spanish, english)]
    assert gone[0] == 1 and gone[1] > 0.9 and gone[2] < 0.01


def test_language_id_keeps_marks_and_every_row(spark):
    assert kneser_ney.symbols("हिंदी, 12").tolist() == [32, *map(ord, "हिंदी"), 32]
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = kneser_ney.train(known)
    text = known.where("lang = 'en' and n_chars > 500").first().text
    rows = [(1, text, "a"), (1, None, "b"), (None, text, "c"), (None, "12", "d"), (2, text, None), (2, text, None)]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, key_id string")
    got = kneser_ney.keep_identified(mixed, model)
    assert got.columns == mixed.columns and sorted(str(r.key_id) for r in got.collect()) == ["None", "None", "a", "c"]
    assert kneser_ney.keep_identified(mixed.where("false"), model).collect() == []


def brute_sketch(text):
    """Order MinHash by plain loops over the same hashes."""
    h = order_minhash.kmer_hashes(text)
    seen: dict = {}
    u = []
    for x in h:
        k = seen.get(x, 0)
        seen[x] = k + 1
        y = np.uint64(x) if k == 0 else order_minhash._mixed(np.array([x]) + np.array([k], np.uint64) * order_minhash._B1)[0]
        u.append(int(y) >> 32)
    out = []
    for a, m in zip(order_minhash._ADD.tolist(), order_minhash._MULTIPLY.tolist(), strict=True):
        i, j = sorted(sorted(range(len(u)), key=lambda p: ((u[p] ^ a) * m % 2**32, p))[:2])
        pair = order_minhash._mixed(np.array([u[i]], np.uint64) + order_minhash._B1) * order_minhash._B1
        out.append(int(order_minhash._mixed(pair + np.uint64(u[j]) + np.uint64(a))[0] >> np.uint64(48)))
    return out


def test_order_minhash(spark, docs):
    for text in ("abcabcabcabcabcabcabcabc", LONG[:3000], "x" * 40):
        assert order_minhash.sketch(text).tolist() == brute_sketch(text)
    got = sorted((r.asDict() for r in order_minhash.fingerprints(docs.repartition(5)).collect()), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t, *_ in ODD]
    for r, own, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
        changed = order_minhash.edited(own, after)
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == order_minhash.written(order_minhash.sketch(own))
        assert r["near_next"] == order_minhash.likeness(order_minhash.sketch(own), order_minhash.sketch(after))
    assert order_minhash.fingerprints(docs.where("doc_id = 6")).first().near_next == 1.0
    unnamed = spark.createDataFrame([(None, "a"), (3, "b"), (4, "c")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in order_minhash.fingerprints(unnamed).collect()) == [0, 3, 4]


def test_exact_groups(docs):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in chunk_recipes.exact_groups(docs).collect())
    assert got == [
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False), (6, 6, 2, True),
        (7, 6, 2, False), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True),
    ]
    kept = chunk_recipes.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 9, 10]


def test_cut_points_rebuild_and_resynchronise():
    data = np.random.default_rng(0).integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    ends = chunk_recipes.cut_points(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip([0, *ends], ends, strict=False))

    def chunks(d):
        e = chunk_recipes.cut_points(d)
        return [d[a:b] for a, b in zip([0, *e], e, strict=False)]

    assert len(set(chunks(data)) & set(chunks(b"inserted" + data))) >= len(ends) - 3


def test_colliding_chunk_hashes_are_told_apart(spark, monkeypatch):
    rows = chunk_recipes.recipes(spark.createDataFrame([(1, "aaaa"), (2, "bbbb")], "doc_id long, text string"))
    forged = rows.withColumn("chunks", F.transform("chunks", lambda c: F.struct(F.lit(5).cast("long").alias("hash"), c["length"].alias("length"), c["sha"].alias("sha"))))
    monkeypatch.setattr(chunk_recipes, "recipes", lambda docs: forged)
    assert [r.group_size for r in chunk_recipes.exact_groups(None).collect()] == [1, 1]


def test_chat_parts(spark):
    texts = ["<|end|>", "<\\|end|> [INST] </s>", "", None, "a <<SYS>> \\ [/INST]", "<|image:1|>"]
    schema = f"conv_id long, turn long, role string, parts {chat_parts.PART_TYPE}"
    rows = [(1, i, "assistant" if i % 2 else None, [("text", t, None, None)]) for i, t in enumerate(texts)]
    rows.append((2, 0, "user", [("text", "see ", None, None), ("image", None, "s3", 9), ("text", "<|x|>", None, None), ("audio", None, "b", None)]))
    rows.append((3, 0, "user", None))
    f = chat_parts.format_turns(spark.createDataFrame(rows, schema))
    read = {r.conv_id: r for r in f.withColumn("turns", chat_parts.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("assistant" if i % 2 else "", t or "") for i, t in enumerate(texts)]
    assert read[2].formatted == "<|turn|>user<|text|>see <|image:1|><\\|x|><|audio:2|><|end|>"
    assert [(a["index"], a.type, a.ref, a.tokens) for a in read[2].attachments] == [(1, "image", "s3", 9), (2, "audio", "b", 128)]
    assert read[2].expanded_tokens == 137 and [t.text for t in read[3].turns] == [""]
    loss = {r.conv_id: r for r in chat_parts.digest(f).collect()}
    said = "".join(t or "" for t in texts[1::2])
    assert loss[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and loss[1].loss_chars == len(said)


def test_quality_on_labelled_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality_cotraining.score(d, labels).toPandas()
    m = got.merge(labels.toPandas(), on="doc_id")
    assert len(got) == d.count() and (m.keep == (m.quality == 1)).mean() > 0.95
    assert quality_cotraining.score(docs, labels).count() == len(ODD)
