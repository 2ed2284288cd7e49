"""Plots, areas, addresses, stamps, handwriting, words and parties on pages
worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import spans
from ledgerline.operators import parcels, parties, regions, stamps

PAGES = "doc long, page long, text string, scores array<double>"


def pages(spark, *texts):
    rows = [(1, i, t, [0.9] * (t.count("\n") + 1)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, PAGES)


def test_spans_have_their_places(spark):
    text = "Plot 12 and plot 7/B.\nNo plot here; PLOT 9"
    df = spark.createDataFrame([(text,), ("",), (None,), ("no match",)], "s string")
    got = [r[0] for r in df.select(spans.spans(F.col("s"), r"(?i)plot [0-9/B]+")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 7, "Plot 12"), (12, 20, "plot 7/B"), (36, 42, "PLOT 9")]
    assert all(text[a:b] == v for a, b, v in got[0]) and got[1] == [] and not got[2] and got[3] == []
    rng = random.Random(1)
    import re

    texts = ["".join(rng.choice("ab1 \nй") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for t, r in zip(texts, df.select("s", spans.spans(F.col("s"), "a+1?|й")).collect(), strict=True):
        assert [tuple(x) for x in r[1]] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+1?|й", t)]


def test_without_takes_values_out(spark):
    df = spark.createDataFrame([("Ram Kumar, S/o Shyam (x.y) ram", ["ram", None, "", "Ram Kumar", "(x.y)"])], "s string, v array<string>")
    assert df.select(spans.without(F.col("s"), F.col("v"))).first()[0] == ", S/o Shyam  "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the plot Nos. 1056/1, 1056/2 of the layout. Bounded on the NORTH by Plot No. 1046/1 & 1048/2", ["1056/1, 1056/2"]),
        ("Plot No. 12/A and 14/B; EAST : Plot No. 9/9", ["12/A, 14/B"]),
        ("SITE 1023/1, 2 and 3", ["1023/1, 1023/2, 1023/3"]),
        ("plot no 504/A, 07, 2001", ["504/A"]),
        ("Sub-Division Nos. 118, 119 & 1998", ["118, 119"]),
        ("H.No. 5, Flat, Plot 77/1", []),
        ("Plot 40 feet wide road, site no. 361", ["361"]),
        ("Plot No. 7", []),  # too short to be told from noise
    ],
)
def test_plots_by_the_words_around_them(spark, text, want):
    assert [r.value for r in parcels.plots(pages(spark, text)).orderBy("start").collect()] == want


def test_plots_are_resolved(spark):
    rows = parcels.plots(pages(spark, "Plot Nos. 1056/1, 1056/2", "SCHEDULE OF THE PROPERTY\nPlot No. 1056/1", "REGISTRATION PLAN\nPlot 356/1"))
    assert sorted((r.page, r.value, r.score, r.reason) for r in rows.collect()) == [(1, "1056/1, 1056/2", 0.93, "text"), (2, "1056/1", 0.95, "schedule"), (3, "356/1", 1.05, "plan")]
    best = parcels.resolved_plots(rows).first()
    assert (best.value, best.score, best.status, best.needs_review, best.conflicting) == ("1056/1, 1056/2", 0.93, "CONFLICT", True, ["1056/1, 1056/2", "1056/1", "356/1"])
    best = parcels.resolved_plots(rows.where("page < 3")).first()
    assert (best.value, best.status, best.conflicting) == ("1056/1, 1056/2", "EXTRACTED", [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("admeasuring an EXTENT OF 480 Sq.Yards or 401.4 Sq.Mtrs.", ("480 sq. yards (401.4 sq. metres)", 0.98, "schedule extent")),
        ("PLOT AREA: 480 Sq. Yds", ("480 sq. yards (401.3 sq. metres)", 0.92, "plan area")),
        ("piece of land admeasuring 200.5 sq yards", ("200.5 sq. yards (167.6 sq. metres)", 0.93, "piece of land")),
        ("the property sold, 100 sq. yards", ("100 sq. yards (83.6 sq. metres)", 0.95, "sold")),
        ("beside the plot 60 sq.yards", ("60 sq. yards (50.2 sq. metres)", 0.9, "of a plot")),
        ("some 60 sq.yards", ("60 sq. yards (50.2 sq. metres)", 0.6, "alone")),
        ("admeasuring 48@ Sq. Yards", ("480 sq. yards (401.3 sq. metres)", 0.72, "ocr-tolerant repair")),
        ("holding AC. 5-16 GTS in all", ("AC. 5-16 GTS", 0.0, "acres")),
    ],
)
def test_areas_by_the_words_around_them(spark, text, want):
    r = parcels.areas(pages(spark, text)).first()
    assert (r.value, r.score, r.reason) == want


def test_two_areas_of_one_line(spark):
    rows = parcels.areas(pages(spark, "x\nplot area 300 sq.yards (250.8 sq. mtrs), once " + "z " * 90 + "90 sq. yds")).orderBy("start").collect()
    assert [(r.yards, r.metres, r.reason) for r in rows] == [(300.0, 250.8, "plan area"), (90.0, 75.3, "alone")]


def test_residual_address(spark):
    block = "1) Sri. Ram Kumar, S/o Shyam Lal, Age 42 Years, Occupation: Business. R/o. Warangal 506002. H. No. 5-2/A main road. Aadhaar No: XXXX 1234. hereinafter called the VENDOR"
    df = spark.createDataFrame([(block, "Sri. Ram Kumar", "S/o Shyam Lal", "42 Years", "Business"), ("1. A B", "A B", None, "", None), (None,) * 5], "b string, n string, r string, a string, o string")
    got = [r[0] for r in df.select(parcels.residual_address(*map(F.col, "bnrao"))).collect()]
    assert got == ["H.No. 5-2/A Main Road, Warangal 506002", None, None]


def test_stamps_of_neighbouring_pages(spark):
    lines = [
        (1, 1, 1, "INDIA NON JUDICIAL Rs. 100"), (1, 1, 2, "Sl.No. 15893"), (1, 1, 3, "Purchased by: ram kumar S/o Shyam"), (1, 1, 4, "For whom: Self and wife"),
        (1, 2, 1, "HUNDRED RUPEES"), (1, 2, 2, "Number 9,911 or 4 421"), (1, 2, 3, "purchased by Madonna"), (1, 3, 1, "no such thing 12345"), (2, 1, 1, "stamp paper"),
    ]
    got = stamps.stamp_blocks(spark.createDataFrame(lines, "doc long, page long, ordinal long, text string")).orderBy("doc", "page").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "15,893", True, "Rs. 100", "Ram Kumar", "Self and wife", 1.0), (1, 2, "9,911", False, "Rs. 100", None, "Self", 0.98), (2, 1, None, False, None, None, "Self", 1.0),
    ]


def test_handwriting_of_a_page(spark):
    schema = "doc long, page long, ordinal long, text string, score double, x_min int, y_min int, x_max int, y_max int, page_height int"
    line = lambda n, text, score, y: (1, 1, n, text, score, 10, y, 90, y + 10, 1000)
    rows = [
        line(1, "SUB REGISTRAR seal 45", 0.3, 20), line(2, "12736 / 2003", 0.8, 50), line(3, "SALE DEED 12", 0.9, 60), line(4, "scribble", 0.5, 500),
        line(5, "hereinafter blurred", 0.5, 510), line(6, "x" * 71, 0.5, 520), line(7, "ab", 0.1, 530), line(8, "Signature of x", 0.2, 900), line(9, "Signature of x", 0.2, 500),
        line(10, "5", 0.01, 100),
    ]
    found = regions.handwriting_regions(spark.createDataFrame(rows, schema))
    assert [(r.ordinal, r.found_by, r.confidence) for r in found.orderBy("ordinal").collect()] == [(2, "margin", 0.68), (4, "doubtful", 0.5), (9, "doubtful", 0.2), (10, "margin", 0.85)]
    docs = spark.createDataFrame([(1,), (2,)], "doc long")
    got = [tuple(r) for r in regions.handwriting_metadata(found, docs, F.col("ordinal") == 4).orderBy("doc").collect()]
    assert got == [(1, True, 1, 3, True, [1]), (2, False, 0, 0, False, [])]


def test_words_end_with_the_shortest_array(spark):
    box = [[20, 10], [60, 12], [60, 30], [20, 28]]
    rows = [(1, 1, ["a  b", " ", "c", "lost"], [0.9, 0.8, 0.7], [box, box, box, box]), (1, 2, [], [], []), (1, 3, None, [0.1], [box])]
    df = spark.createDataFrame(rows, "doc long, page long, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<int>>>")
    got = [tuple(r) for r in regions.recognised_words(df, 2.0).orderBy("ordinal").collect()]
    assert got == [(1, 1, 0, "a b", 0.9, 10, 5, 30, 15, 10.0, 10), (1, 1, 2, "c", 0.7, 10, 5, 30, 15, 10.0, 10)]


def test_party_passes(spark):
    lines = [(1, 1, 1, "the vendor sunrise builders", 0.95), (1, 2, 1, "by Ram Kumar", 0.9), (1, 3, 2, "Messrs Greenfield Estates Hyderabad", 0.7), (1, 4, 2, "Greenfield", 0.8), (2, 1, 1, "Ram Kumar", 0.9)]
    people = [
        (1, 1, "Sunrise Builders", "Ram Kumar", None, False), (1, 2, "Nobody Known", "ram kumar", None, False), (1, 3, "Greenfield & Estates", None, None, True), (1, 4, "Zed", " ", None, None),
        (1, 5, " ", "Ram Kumar", None, None), (3, 1, "Ram Kumar", None, 0.9, None),
    ]
    got = parties.party_lines(
        spark.createDataFrame(people, "doc long, party long, name string, representative string, given double, corrected boolean"),
        spark.createDataFrame(lines, "doc long, ordinal long, page long, text string, score double"),
    )
    assert sorted((r.doc, r.party, r.found_by, r.ordinal, r.score, r.needs_review) for r in got.collect()) == [
        (1, 1, "name", 1, 0.95, False), (1, 2, "representative", 2, 0.9, False), (1, 3, "words", 3, 0.595, True), (1, 4, "none", None, 0.6, True), (3, 1, "none", None, 0.82, True),
    ]


def plain_groups(names):
    stop = {"m", "s", "pvt", "private", "ltd", "limited", "company", "homes", "developers", "builders"}
    tokens = [{w for w in n.split() if len(w) > 2 and w not in stop} for n in names]
    groups = []
    for i, t in enumerate(tokens):
        for g in groups:
            if tokens[g[0]] & t:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def test_entity_groups_equal_a_plain_loop(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "homes", "pvt", "ab"]
    rows = [(k, [" ".join(rng.sample(words, rng.randint(0, 3))) for _ in range(rng.randint(0, 8))]) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, names array<string>")
    for r in df.select("k", "names", parties.entity_groups(F.col("names")).alias("g")).collect():
        assert [g.members for g in r.g] == plain_groups(r.names), r.names


def test_reconciled_party(spark):
    rows = [
        (1, 1, "Sunrise Homes", None, 0.94), (1, 2, "Moon Estates", "B", 0.96), (1, 3, "M/s Sunrise Builders", "A", 0.5), (1, 4, "Sunrise", " ", 0.9), (2, 1, "Pvt Ltd", None, 0.5),
    ]
    df = spark.createDataFrame(rows, "doc long, ordinal long, name string, representative string, score double")
    got = [tuple(r) for r in parties.reconciled(df).orderBy("doc").collect()]
    assert got == [(1, "M/s Sunrise Builders", "A", 2, True, ["Sunrise Homes", "Moon Estates"]), (2, "Pvt Ltd", None, 1, False, [])]


def test_differences_of_tables(spark):
    from ledgerline.operators import store

    rows = [(1, "5", '{"b":1,"a":2}', None), (1, "5", '{"b":1,"a":2}', None), (2, "5.50", "{}", "x"), (3, " ", "[]", ""), (4, "1", "a", "b")]
    a = spark.createDataFrame(rows, "id long, n string, j string, s string")
    assert store.field_differences(a, a, "id", ["n", "j", "s"]).collect() == []
    assert store.field_differences(a, a.union(a.limit(0)).selectExpr("id", "cast(n as string) n", "j", "s"), "id", ["n", "j", "s", "other"]).collect() == []
    b = spark.createDataFrame([(1, 5.0, '{"a":2, "b":1}'), (2, 5.5, None), (3, None, None), (5, 0.0, None)], "id long, n double, j string")
    got = sorted(tuple(r) for r in store.field_differences(a, b, "id", ["n", "j", "s"]).fillna("-", ["value"]).collect())
    assert got == [
        (1, "id", "1", 2, 1), (1, "j", '{"a":2,"b":1}', 2, 1), (1, "n", "5", 2, 1), (1, "s", "-", 2, 1), (2, "s", "-", 0, 1), (2, "s", "x", 1, 0),
        (4, "id", "4", 1, 0), (4, "j", "a", 1, 0), (4, "n", "1", 1, 0), (4, "s", "b", 1, 0), (5, "id", "5", 0, 1), (5, "n", "0", 0, 1),
    ]
    assert store.field_differences(a.where("id = 4"), b.where("id = 9"), "id", ["n", "z"], {"z": F.lit("d")}).where("field = 'z'").first()[2:] == ("d", 1, 0)


def test_merge_policies(spark):
    from ledgerline.operators import merging

    schema = "doc long, field string, value string, score double"
    rules = spark.createDataFrame([(1, "a", "Town", 0.7), (1, "b", "left", 0.7), (1, "c", "noise", 0.9), (1, "d", " ", 0.9), (1, "e", "own", 0.6)], schema)
    model = spark.createDataFrame([(1, "a", "town.", 0.95), (1, "b", "right", 0.8), (1, "c", "x word", 0.8), (1, "e", "other", None), (2, "a", "only", 0.5)], schema)
    policy = spark.createDataFrame([("a", "rules", None, None), ("b", "model", None, None), ("c", "rules", "nois", " word$"), ("d", "model", None, None)], "field string, wins string, noise string, cut string")
    got = sorted(tuple(r) for r in merging.merged_extractions(rules, model, policy).collect())
    assert got == [
        (1, "a", "Town", "both", 0.98, False, None), (1, "b", "right", "model", 0.8, True, "left"), (1, "c", "x", "model", 0.8, False, None),
        (1, "d", None, "none", 0.0, True, None), (1, "e", "own", "rules", 0.6, True, "other"), (2, "a", "only", "model", 0.5, False, None),
    ]
