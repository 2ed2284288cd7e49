"""Names within names against brute force, with a prefix that half of them share."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import names


def test_hot_prefix(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    told = {("new town " if i % 2 else "") + word(rng.randint(4, 9)) for i in range(40_000)}
    asked = set(rng.sample(sorted(told), 150)) | {t[2:-1] for t in rng.sample(sorted(told), 150) if len(t) > 9} | {"nowhere at all", "new town zzzzzzzz"}
    places = spark.createDataFrame([("s", x) for x in told], "state string, outer string")
    queries = spark.createDataFrame([("s", x) for x in asked] + [("other", "new town")], "state string, inner string")
    met = names.candidates(queries, places, ["state"])
    most = met.groupBy("inner").count().agg(F.max("count")).first()[0]
    assert most < 20, most
    got = {(r.inner, r.outer) for r in names.within(queries, places, ["state"]).collect()}
    assert got == {(a, t) for a in asked for t in told if a in t}


def test_short_names_and_dealt_parts(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 10)
    told = [f"a{i}" for i in range(60)] + ["b", "ab", "é"]
    inner = ["a", "a1", "é", "x", "a59"]
    pair = lambda c, values: spark.createDataFrame([(k, x) for k in (1, 2) for x in values], f"k int, {c} string")
    got = sorted((r.k, r.inner, r.outer) for r in names.within(pair("inner", inner), pair("outer", told), ["k"]).collect())
    assert got == sorted((k, a, t) for k in (1, 2) for a in inner for t in told if a in t)
    assert names.within(pair("inner", []), pair("outer", told), ["k"]).collect() == []
