"""Every registered registry query against its SQL on the smallest tables."""

import random
from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, geometry, script, text
from ledgerline.operators import duplicates, fields, store
from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(columns, values):
    def cell(x):
        return round(float(x), 6) if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_text_and_script(spark):
    df = spark.createDataFrame([("వన్ x",), ("a-b  c",), (None,)], "s string")
    got = [tuple(r) for r in df.select(text.comparable(F.col("s")), script.dominant_script(F.col("s"))).collect()]
    assert got == [("వన x", "Telugu"), ("a b c", "Latin"), (None, "Unknown")]


def test_doc_equal_pair_skips_stamp_rule(spark):
    schema = "id long, created long, file_hash string, doc_no string, stamp_no string, village string, survey string"
    a = spark.createDataFrame([(1, 1, "h1", "123", "st123456", "v", "s")], schema)
    b = spark.createDataFrame([(2, 2, "h2", "123", "st123456", "w", "t"), (3, 3, "h3", None, "st123456", "w", "t")], schema)
    assert [tuple(r) for r in duplicates.duplicate_of(a, b).collect()] == [(1, 3, "stamp")]


def test_every_document_is_in_the_register(spark, tmp_path):
    long = "x" * 50
    docs = [(11, "a copy", "en", "s1"), (12, "a copy", "fr", "s2"), (13, long + " one", "en", "s3"), (14, long + " two!", "en", "s4"), (15, long + "-one!?", "fr", "s5"), (17, None, None, None)]
    docs += [(21 + i, f"text {i % 7}{'.' * (i % 3)}", "en", f"s{i % 4}") for i in range(40)]
    made = spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(str(tmp_path / "documents.parquet"))

    def keys(r):
        bare = "".join(c for c in r[1] or "" if c.isascii() and c.isalnum()).lower()
        return r[1], None if r[3] is None else f"{r[3]}{len(r[1])}", bare if len(bare) >= 4 else None

    want = {}
    for a in docs:
        for b in docs:
            (fa, da, sa), (fb, db, sb) = keys(a), keys(b)
            named = da and da == db
            reason = "file" if fa and fa == fb else "document" if named and (len(da) >= 4 or a[2] == b[2] or a[3] == b[3]) else "stamp" if sa and sa == sb and not named else None
            if a[0] != b[0] and reason:
                want[a[0]] = min(want.get(a[0], (10**9, "")), (b[0], reason))
    got = {r.id: (r.match_id, r.reason) for r in registry.QUERIES["duplicate_register"](spark, str(tmp_path)).collect()}
    assert got == want and got[11] == (12, "file") and got[12] == (11, "file") and got[13] == (15, "stamp") and 14 not in got


def test_immutable_violation(spark):
    a = spark.createDataFrame([(1, "APPROVED", "p"), (2, "DRAFT", "p")], "id int, status string, payload string")
    b = spark.createDataFrame([(1, "APPROVED", "q"), (2, "DRAFT", "q")], "id int, status string, payload string")
    assert [r.id for r in store.immutable_violations(a, b, "id", "status", "payload").collect()] == [1]


def test_dates_of_odd_texts(spark):
    df = spark.createDataFrame([("9-1-2003",), ("31/02/2001",), ("on the 45th day of May 2001",), ("5 day of March, 1999",), (None,), ("",)], "s string")
    c = F.col("s")
    got = [tuple(map(str, r)) for r in df.select(dates.numeric_date(c), dates.written_date(c), dates.full_year(c)).collect()]
    none = ("None",) * 3
    assert got == [("2003-01-09", "None", "9-1-2003"), ("None", "None", "31-02-2001"), none, ("None", "05-03-1999", "None"), none, none]


def test_dimensions_and_bands(spark):
    df = spark.createDataFrame([("60 ft x 40 m", 0, 112), ("E-W 10, N/S 20", 0, 160), ("none", 5, 5), (None, 0, 1)], "s string, a long, b long")
    got = df.select(geometry.dimensions(F.col("s")).alias("m"), geometry.line_bands(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r.m and (round(r.m.ew, 3), round(r.m.ns, 3)) for r in got] == [(18.288, 40.0), (3.048, 6.096), None, None]
    assert [[tuple(b) for b in r.l] for r in got] == [[(0, 112)], [(0, 75), (75, 150), (150, 160)], [(5, 5)], [(0, 1)]]


def test_spelling_variants(spark):
    pairs = [("Ghatkesar", "Ghatkesar"), ("Ghatkesar", "Ghatkesr"), ("Ramapuram", "East Ramapuram"), ("abc", "xabc y"), ("Plot 12", "Plot 13"), (None, "a"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(fields.spelling_variant("a", "b")).collect()] == [True, True, True, False, False, False, False]


def test_word_lines_follow_slanted_text(spark):
    words = [(1, 1, w, 0.5, x, y, 10) for w, x, y in (("b", 50, 103), ("a", 0, 100), ("c", 99, 110), ("e", 60, 130), ("d", 0, 131))]
    df = spark.createDataFrame([*words, (2, 1, "x", 1.0, 0, 0, 10)], "doc long, page long, text string, score double, x_min int, y_center int, height int")
    assert sorted(tuple(r) for r in fields.word_lines(df).collect()) == [(1, 1, 1, "a b c", 0.5), (1, 1, 2, "d e", 0.5), (2, 1, 1, "x", 1.0)]


def test_word_lines_work_on_batches_of_pages(spark):
    rng = random.Random(5)
    words = [
        (doc, page, f"w{i}", rng.random(), rng.randrange(1000) + i / 100, float(rng.choice((rng.randrange(40), rng.random() * 200))), rng.choice((10, 10, 35)))
        for doc in (None, 0, 1, 2) for page in (0, 1) for i in range(rng.choice((1, 5, 23)))
    ]
    expected = []
    for doc, page in {w[:2] for w in words}:
        own = sorted((w for w in words if w[:2] == (doc, page)), key=lambda w: (w[5], w[4]))
        near, lines = max(12, int(0.8 * median(w[6] for w in own))), []
        for w in own:
            if not lines or w[5] - sum(v[5] for v in lines[-1]) / len(lines[-1]) > near:
                lines.append([])
            lines[-1].append(w)
        for i, line in enumerate(lines, 1):
            line.sort(key=lambda w: w[4])
            expected.append((doc, page, i, " ".join(w[2] for w in line), round(sum(w[3] for w in line) / len(line), 9)))
    rng.shuffle(words)
    df = spark.createDataFrame(words, "doc long, page long, text string, score double, x_min double, y_center double, height int")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for size in (1, 7, 10_000):  # a batch cuts pages, and holds several
        spark.conf.set(name, str(size))
        got = fields.word_lines(df)
        assert {(*r[:4], round(r[4], 9)) for r in got.collect()} == set(expected) and got.count() == len(expected)
    spark.conf.set(name, before)
    assert fields.word_lines(df.limit(0)).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_word_lines_move_pages_not_words(spark, tmp_path):
    text = " ".join(f"v{i}" for i in range(1000))
    docs = [(1, text), (None, "a b"), (2, None), (3, " \t"), (4, "x"), (5, "y"), (5, " ".join("z" * 500))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["word_lines"](spark, str(tmp_path))
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] or 0, *r[1:3]))
    assert len(rows) == 1 + 84 + 1 + 42 and rows[0] == (None, 0, 1, "a b", 0.505)
    assert " ".join(r[3] for r in rows if r[0] == 1) == text and [r[1:3] for r in rows if r[0] == 1][39:42] == [(0, 40), (1, 1), (1, 2)]
    assert sorted(rows[86][3].split()) == ["y"] + ["z"] * 12 and [r[1] for r in rows if r[0] == 5].count(0) == 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Aggregate"), "words are told apart after pages have moved"


def test_number_sets_prefer_the_plan(spark):
    rows = [(1, [278, 281], True, 1.05, 1, 1), (1, [5, 6, 7], False, 0.9, 2, 2), (2, [1, 2], False, 0.9, 1, 1), (2, [2, 3], False, 0.85, 1, 2), (2, [1], False, 0.9, 1, 3)]
    df = spark.createDataFrame(rows, "doc long, numbers array<int>, preferred boolean, score double, page int, ordinal int")
    assert sorted(tuple(r) for r in fields.number_sets(df).collect()) == [(1, [278, 281], False), (2, [1, 2], True)]


def test_decisions(spark):
    rows = [("reject", False, False, None), ("approve", True, True, None), ("approve", False, True, None), ("approve", False, False, ""), (None, False, False, "x")]
    df = spark.createDataFrame(rows, "a string, d boolean, f boolean, r string")
    got = [tuple(r[0]) for r in df.select(fields.decide(*map(F.col, "adfr"))).collect()]
    assert got == [(None, "a reason is needed"), (None, "duplicate"), (None, "critical check failed"), ("APPROVED", "sealed"), (None, "unknown action")]
