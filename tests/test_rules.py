"""Rules on rows worked out by hand: readings of two deeds, selection, learned
rules, places, payloads, accounts and files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, deed, geometry, script, text
from ledgerline.operators import accounts, candidates, duplicates, fields, gis, learning, parties, payload, store
from ledgerline.plans import registry
from ledgerline.sources import files
from ledgerline.streaming import windows

LINES = "doc string, page int, ordinal int, text string, y_rel double"


def read(spark, lines):
    found = candidates.candidates(spark.createDataFrame(lines, LINES))
    best = candidates.select_best(candidates.agreeing_areas(found))
    return {(r.doc, r.field): r for r in best.collect()}


def test_two_deeds_are_read_apart(spark):
    a = [
        (1, "SALE DEED", 0.1), (1, "Doc. No. 12736/2003", 0.1), (1, "Sl.No. 11,676 Dt: 9-10-2003 Rs.100", 0.2), (1, "executed on this 15th day of October 2003", 0.5),
        (2, "Survey Nos. 278, 281, 282", 0.3), (2, "an area of 480 Sq. Yards", 0.4),
    ]
    b = [
        (1, "SALE DEED", 0.1), (1, "Doc No: 18452/25", 0.1), (1, "Sl No. 15,893 dt. 22/08/2024", 0.2), (1, "Rs. 100", 0.2), (1, "made on this 22nd day of August, 2024", 0.5),
        (2, "Sy. Nos. 356, 357 & 358, Plot Nos. 1056/1 and 1056/2", 0.3), (2, "extent 480 sq yds", 0.4), (2, "Mandal: Ghatkosar, District: Medchal", 0.5),
    ]
    lines = [(doc, p, i, line, y) for doc, given in (("A", a), ("B", b)) for i, (p, line, y) in enumerate(given)]
    got = {k: r.value for k, r in read(spark, lines).items()}
    assert got["A", "document_number"] == "12736/2003" and got["B", "document_number"] == "18452/25"
    assert got["A", "survey_number"] == "278, 281, 282" and got["B", "survey_number"] == "356, 357, 358"
    assert got["A", "property_area"] == got["B", "property_area"] == "480" and got["B", "mandal"] == "Ghatkesar"
    assert got["A", "stamp_serial_number"] == "11,676" and got["B", "stamp_serial_number"] == "15,893" and got["B", "stamp_value"] == "100"
    assert got["A", "stamp_purchase_date"] == "09-10-2003" and got["A", "execution_date"] == "15-10-2003"
    assert got["B", "stamp_purchase_date"] == got["B", "execution_date"] == "22-08-2024" and got["B", "sub_survey_number"] == "1056/1, 1056/2"


def test_selection(spark):
    schema = "doc int, field string, value string, score double, page int, ordinal int, reason string"
    rows = [
        (1, "area", "480", 0.95, 2, 1, "x"), (1, "area", "488", 0.90, 3, 2, "x"), (1, "area", "490", 0.71, 3, 3, "x"), (1, "village", "Ghatkesar", 0.95, 2, 1, "x"),
        (1, "village", "Ghatkesr", 0.94, 3, 2, "x"), (1, "buyer", "A", 0.95, 1, 1, "stamp endorsement"), (1, "mandal", "X", 0.80, 1, 1, "x"), (1, "state", "Y", 0.0, 1, 1, "x"),
        (1, "district", "P", 0.9, 3, 1, "x"), (1, "district", "Q", 0.9, 1, 2, "x"),
    ]
    wanted = spark.createDataFrame([(1, f) for f in ("area", "village", "buyer", "mandal", "state", "district")], "doc int, field string")
    got = {r.field: r for r in candidates.select_best(spark.createDataFrame(rows, schema), wanted).collect()}
    assert (got["area"].value, got["area"].status, got["area"].score, got["area"].conflicting) == ("480", "CONFLICT", 0.7, ["480", "488", "490"])
    assert (got["village"].status, got["village"].needs_review, got["village"].score) == ("EXTRACTED", False, 0.95)
    assert got["buyer"].needs_review and got["buyer"].score == 0.76 and got["mandal"].needs_review and got["mandal"].score == 0.76
    assert (got["state"].status, got["state"].value, got["state"].needs_review, got["state"].score) == ("NOT_FOUND", None, True, 0.0)
    assert got["district"].value == "Q" and got["district"].status == "CONFLICT"


def test_learned_rules(spark):
    schema = "field string, doc_type string, language string, raw string, corrected string, status string, ts int"
    told = [("village", "Sale Deed", "EN", " Rampur ", "Rampura", "verified", i) for i in (1, 2)] + [("village", "Sale Deed", "en", "Once", "Twice", "verified", 3)]
    told += [("village", "Sale Deed", "en", "No", "Not", "rejected", i) for i in (4, 5)]
    rules = learning.induce_rules(spark.createDataFrame(told, schema))
    assert [(r.raw, r.corrected, r.evidence, r.rule_confidence) for r in rules.collect()] == [("Rampur", "Rampura", 2, 0.80)]
    asked = [
        ("village", "SALE DEED", "En", "Rampur", 0.6), ("village", "Gift Deed", "en", "Rampur", 0.6), ("village", "Sale Deed", "te", "Rampur", 0.6),
        ("mandal", "Sale Deed", "en", "Rampur", 0.6), ("village", "unknown", "en", "Rampur", 0.6), ("village", " ", "en", "Rampur", 0.6), ("village", "Sale Deed", "en", None, 0.6),
        ("survey_number", "x", "y", "278 | 281", 0.97), ("document_number", None, None, "12736|5", 0.5), ("property_area", "x", "en", "48O", 0.5),
    ]
    got = [(r.value, r.final, r.kind) for r in learning.apply_rules(spark.createDataFrame(asked, "field string, doc_type string, language string, raw string, ocr double"), rules).collect()]
    assert sorted(got, key=str) == sorted(
        [("Rampura", 0.8, "learned_correction"), *[("Rampur", 0.6, "raw_ocr")] * 5, (None, 0.0, "raw_ocr"), ("278, 281", 0.95, "deterministic_normalization"),
         ("12736/5", 0.9, "deterministic_normalization"), ("480", 0.9, "deterministic_normalization")], key=str)


def test_places(spark):
    villages = spark.createDataFrame(
        [("demo_state", "Central District", None, "Sunrise Mandal", "Green Valley", 10), ("demo_state", "East", None, "Moon", "Twin", 11), ("demo_state", "East", None, "Moon", "Twin", 12)],
        "state string, district string, old_district string, mandal string, village string, feature long",
    )
    features = spark.createDataFrame(
        [("demo_state", "district", "Central District", None, 2), ("demo_state", "mandal", "Central District", "Sunrise Mandal", 3), ("demo_state", "mandal", "East", "Moonlight", 5), ("bare", "district", "Lone", None, 7)],
        "state string, level string, district string, mandal string, feature long",
    )
    asked = [
        (1, "demo_state", "Central District", "Sunrise Mandal", "Green Valley"), (2, "demo_state", "central", "sunrise", "situated at GREEN-VALLEY village"), (3, "demo_state", None, None, "Twin"),
        (4, "demo_state", "East", "Moon", "Nowhere"), (5, "demo_state", "Central", "Mars", None), (6, "demo_state", None, None, None), (7, "bare", None, None, "x"), (8, "none", "East", None, "Twin"),
        (9, "demo_state", "West", None, "Green Valley"), (10, "demo_state", None, None, "Green Valley Extension"),
    ]
    got = {r.id: (r.level, r.feature, r.confidence, r.hierarchy) for r in gis.resolve_places(spark.createDataFrame(asked, "id long, state string, district string, mandal string, village string"), villages, features).collect()}
    assert got[1] == got[2] == got[10] == ("village", 10, 90, "CONSISTENT") and got[3] == ("ambiguous", None, 40, "AMBIGUOUS")
    assert got[4] == ("mandal", 5, 70, "PARTIAL") and got[5] == ("district", 2, 50, "CONTRADICTORY") and got[6] == ("district", 2, 30, "CONSISTENT")
    assert got[7] == ("district", 7, 30, "CONTRADICTORY") and got[8] == ("none", None, 0, "NOT_FOUND") and got[9][0] == "district" and got[9][2] == 30
    states = spark.createDataFrame([("demo_state",), ("telangana",), ("karnataka",)], "state string")
    names = ["demo_state", "DEMO STATE", "Demo-State", "demostate", "State of Telangana", "Kerala", "Telanga", None]
    asked = spark.createDataFrame([(i, n, "Medchal" if n is None else None, None, None) for i, n in enumerate(names)], "id long, state string, district string, mandal string, village string")
    assert [r.state_key for r in gis.states_of(asked, states).orderBy("id").collect()] == ["demo_state"] * 4 + ["telangana", None, None, "telangana"]


def test_payload_and_checklist(spark):
    base = {
        "document_type": "Sale Deed", "document_number": "TEST-123", "property": {"survey_number": "10", "area": "100 sq yd", "village": "V", "district": "D"},
        "stamp_information": {"stamp_number": "ST-1", "sold_to": "A. Buyer"}, "parties": [{"name": "A", "role": "Seller"}, {"name": "B", "role": "Buyer"}],
    }
    records = [
        base, {**base, "property": {**base["property"], "area": "100"}, "document_date": "1-2-2020", "execution_date": "2020/02/03"},
        {"parties": json.dumps(base["parties"])}, {"parties": {"Seller": [{"name": "S"}], "Buyer": [{"full_name": "B", "role": " "}]}, "survey_number": "3|4", "property_area": "0"}, {"parties": "nothing"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, raw string").withColumn("p", payload.payload(F.col("raw")))
    checks = payload.checklist(F.col("p"), F.col("id") == 1, F.col("id") < 2, F.lit(None).cast("boolean"))
    got = [(json.loads(r.j), [(c.check_id, c.status, c.severity) for c in r.c], r.m) for r in df.select("id", payload.canonical(F.col("p")).alias("j"), checks.alias("c"), payload.missing_fields(F.col("p")).alias("m")).orderBy("id").collect()]
    assert got[0][0]["stamp_number"] == got[0][0]["stamp_information"]["stamp_number"] == "ST-1" and list(got[0][0]) == sorted(got[0][0])
    status = [{k: s for k, s, _ in c} for _, c, _ in got]
    assert status[0]["area_validation"] == "FAIL" and status[1]["area_validation"] == "PASS" and status[0]["date_validation"] == "WARNING" and status[1]["date_validation"] == "PASS"
    assert status[0]["duplicate_document_check"] == "PASS" and status[1]["duplicate_document_check"] == "FAIL" and status[0]["internal_consistency"] == "PASS" and status[0]["signature_detection"] == "PASS"
    assert [len(g[0]["parties"]) for g in got] == [2, 2, 2, 2, 0] and [p["role"] for p in got[3][0]["parties"]] == ["Seller", None]
    assert status[3]["survey_number_validation"] == "WARNING" and status[3]["area_validation"] == "FAIL" and got[3][2] == ["document_type", "document_number", "property.village", "property.district"]
    assert [k for k, _, _ in got[0][1]][:3] == ["duplicate_document_check", "land_document_classification", "required_fields"] and got[4][2][2] == "parties"


def test_fingerprints_tell_rows_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("<null>", "x"), ("a|b", "c")], "x string, y string")
    marks = [r[0] for r in df.select(store.fingerprint(df, ["x", "y"])).collect()]
    assert len(set(marks)) == 4 and marks[0] == marks[4]
    assert text.ID_SENTINELS.count("applied") == 0


def test_a_number_of_many_classes(spark):
    n = 10_000
    rows = [(i, i, f"h{i}", "1234", "st5678", f"v{i % 7}", f"s{i % 5}") for i in range(n)] + [(n, n, None, "1234", "st5678", None, None), (n + 1, n + 1, None, None, "st5678", None, None)]
    df = spark.createDataFrame(rows, "id long, created long, file_hash string, doc_no string, stamp_no string, village string, survey string")
    got = {r.id: (r.match_id, r.reason) for r in duplicates.duplicate_of(df, df).collect()}
    assert len(got) == n + 2 and got[0] == (1, "document") and got[5] == (0, "document") and got[n] == (0, "document") and got[n + 1] == (0, "stamp")


def brute(rows):
    place = lambda a, b: (a[5] and a[5] == b[5]) or (a[6] and a[6] == b[6])
    out = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0]:
                continue
            same = lambda k: a[k] is not None and a[k] == b[k]  # noqa: B023, E731
            reason = "file" if same(2) else ("document" if place(a, b) or len(a[3]) >= 4 else None) if same(3) else "stamp" if same(4) and (place(a, b) or len(a[4]) >= 6) else None
            if reason:
                out[a[0]] = min(out.get(a[0], (9**9, "")), (b[1], reason))
    return out


def test_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    pick = lambda *v: rng.choice([*v, None])
    rows = [(i, i, pick("h1", "h2", "h3"), pick("123", "1234", "99"), pick("st12", "st123456", "s999"), pick("v", "w"), pick("s", "t")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, created long, file_hash string, doc_no string, stamp_no string, village string, survey string")
    assert {r.id: (r.match_id, r.reason) for r in duplicates.duplicate_of(df, df).collect()} == brute(rows)


def test_accounts(spark):
    users = spark.createDataFrame([("u1", "user", 1), ("admin", "admin", 0)], "user_id string, role string, created_at int")
    assert sorted(tuple(r) for r in accounts.upsert_users(users, users.withColumns({"role": F.lit("Clerk"), "created_at": F.lit(9)})).collect()) == [("admin", "clerk", 0), ("u1", "clerk", 1)]
    with pytest.raises(Exception, match="unknown role"):
        accounts.upsert_users(users, users.withColumn("role", F.lit("king"))).collect()
    assert [tuple(r) for r in accounts.reconcile_users(users, users.limit(0), ["role"]).collect()] == [("u1", "delete")]
    made = fields.decide(F.col("a"), F.lit(False), F.lit(False), F.lit("r"), F.lit("NEEDS_REVIEW"), F.col("c"))
    got = spark.createDataFrame([("correct", "FAIL"), ("correct", "APPROVED"), ("reject", "APPROVED"), ("approve", "FAIL")], "a string, c string").select(made.alias("m")).select("m.status").collect()
    assert [r.status for r in got] == ["NEEDS_REVIEW", None, "REJECTED", "APPROVED"]


def test_scalars(spark):
    df = spark.createDataFrame([("60 ft X 40 ft",), ("East 10.5m and North 20 meters",), ("plot 5, 60x40",), ("no size",), (None,)], "s string")
    got = [r.m and (round(r.m.ew, 3), round(r.m.ns, 3)) for r in df.select(geometry.dimensions(F.col("s")).alias("m")).collect()]
    assert got == [(18.288, 12.192), (10.5, 20.0), (1.524, 18.288), None, None]
    answers = [("x ```json\n{\"a\": 1}\n``` y {",), ("see {\"b\": {\"c\": 2}} end",), ("none",), ("``` text ``` {\"d\": 3}",), (None,)]
    assert [r[0] for r in spark.createDataFrame(answers, "s string").select(text.embedded_json(F.col("s"))).collect()] == ['{"a": 1}', '{"b": {"c": 2}}', "{}", '{"d": 3}', "{}"]
    said = [("this the 15th  day of Octuber 2003",), ("31 Dec 1999 and 2 Jan 2000",), ("45 May 2000",), ("made on this __ day of ___ 2003",), ("15 OCT0BER, 2003",)]
    assert [r[0] for r in spark.createDataFrame(said, "s string").select(dates.written_date(F.col("s"))).collect()] == ["15-10-2003", "31-12-1999", None, None, "15-10-2003"]
    assert [r[0] for r in spark.createDataFrame([("అ आआ",), ("12",), (None,)], "s string").select(script.dominant_script(F.col("s"))).collect()] == ["Devanagari", "Unknown", "Unknown"]


def test_files(spark, tmp_path):
    path = str(tmp_path / "copy.txt")
    (tmp_path / "copy.txt").write_text("1\tt\t{\"a\": 2}\t\\\\x6869\\n\n2\t\\N\t\\N\tplain\\ttext\n\\.\n".replace("\\\\x6869\\n", "\\\\x6869"))
    rows = files.typed(files.read_copy_text(spark, path, ["id", "ok", "doc", "raw"]), ("ok",), {"doc": "a int"}, ("raw",)).orderBy("id").collect()
    assert (rows[0].ok, rows[0].doc.a, bytes(rows[0].raw)) == (True, 2, b"hi") and (rows[1].ok, rows[1].doc, bytes(rows[1].raw)) == (None, None, b"plain\ttext")
    store_path = str(tmp_path / "store")
    records = spark.createDataFrame([("r1", None), ("r2", True)], "id string, submitted boolean")
    files.write_json_store(records, store_path)
    files.append_log(records, store_path)
    filled = files.read_json_store(spark, store_path, "id string, submitted boolean", {"submitted": F.lit(False)})
    assert sorted(r.submitted for r in filled.collect()) == [False, False, True, True]
    (tmp_path / "db.json").write_text(json.dumps({"f1": {"ground_truth": "a", "extracted": "b", "confidence": 0.5, "needs_review": True}}))
    assert files.read_ground_truth(spark, str(tmp_path / "db.json")).first().extracted == "b"
    (tmp_path / "geo" / "demo_state").mkdir(parents=True)
    (tmp_path / "geo" / "demo_state" / "villages.json").write_text(json.dumps({"features": [{"properties": {"NAME": " X ", "TALUK": "T", "DISTRICT": "D"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"NAME": "Y"}, "geometry": None}]}))
    aliases = {"village": ("VILL_NAME", "NAME"), "taluk": ("TALUK",), "district": ("DIST_NAME", "DISTRICT")}
    found = files.read_villages(spark, str(tmp_path / "geo" / "demo_state" / "villages.json"), aliases, ("village", "taluk", "district")).collect()
    assert [(r.village, r.taluk) for r in found] == [("X", "T")]
    assert sorted(r.search_key for r in files.datasets(spark, str(tmp_path / "geo")).collect()) == ["demo state", "demo_state", "demostate"]
    (tmp_path / "rings.json").write_text('{"objectid": 1, "rings": [[[0, 0], [1, 0], [0, 0]]]}\n{"objectid": 1, "rings": [[[0, 0], [1, 0], [0, 0]]]}\n{"objectid": 2, "rings": [[[0, 0]], [[1, 1]]]}')
    assert sorted((r.objectid, r.geometry.type) for r in files.read_rings(spark, str(tmp_path / "rings.json")).collect()) == [(1, "Polygon"), (2, "MultiPolygon")]
    (tmp_path / "ocr.json").write_text(json.dumps({"page": 3, "ocr_elements": [{"text": "a", "confidence": 0.5}, {"text": "b", "confidence": 0.6}]}))
    assert [(r.page, r.ordinal, r.text) for r in files.read_ocr_cache(spark, str(tmp_path / "ocr.json")).collect()] == [(3, 1, "a"), (3, 2, "b")]
    pages = spark.createDataFrame([("d", 1, "x" * 130 + "\n\n second "), ("e", 1, "short")], "doc string, page int, text string")
    assert [(r.doc, r.line_no, r.y_min) for r in files.text_lines(pages).collect()] == [("d", 1, 50), ("d", 2, 70)]


def test_daily_intake_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    times = ["2024-01-01 10:00:00", "2024-01-01 23:59:00", "2024-01-02 00:00:00"]
    spark.createDataFrame([(x,) for x in times], "ts string").select(F.col("ts").cast("timestamp")).write.parquet(source)
    stream = windows.daily_intake(spark.readStream.schema("ts timestamp").parquet(source))
    query = stream.writeStream.format("memory").queryName("intake").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert sorted(r.intake for r in spark.sql("SELECT * FROM intake").collect()) == [1, 2]


def test_numbered_equals_one_window(spark):
    from pyspark.sql import Window

    from ledgerline.operators import analytics

    rows = spark.range(500).select((F.col("id") % 7 % 3).alias("g"), (F.col("id") * 7919 % 500).alias("v"), "id").repartition(9)
    want = rows.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"))).alias("nth"), F.count("*").over(Window.partitionBy("g")).alias("of"))
    got = analytics.numbered(rows, "g", F.desc("v")).select("id", "nth", "of")
    assert sorted(got.collect()) == sorted(want.collect())
    assert analytics.numbered(rows.where("false"), "g", F.desc("v")).collect() == []


def test_old_state_names_and_owners(spark):
    from ledgerline.operators import accounts, gis

    asked = spark.createDataFrame([(1, "Andhra Pradesh"), (2, "A.P"), (3, "Atlantis"), (4, "telangana state")], "id long, state string").selectExpr("*", "'' district", "'' mandal", "'' village")
    known = lambda *names: spark.createDataFrame([(n,) for n in names], "state string")
    of = lambda *names: {r.id: r.state_key for r in gis.states_of(asked, known(*names)).collect()}
    assert of("telangana", "karnataka") == {1: "telangana", 2: "telangana", 3: None, 4: "telangana"}
    assert of("telangana", "andhra_pradesh")[1] == "andhra_pradesh" and of("karnataka")[1] is None
    sessions = spark.createDataFrame([("t1", "u"), ("t2", " ")], "token string, user_id string")
    with pytest.raises(Exception, match="no user of t2"):
        accounts.reconcile_owned(sessions.limit(0), sessions, "token", ["user_id"]).collect()


def test_raw_records_of_odd_shapes(spark):
    from ledgerline.operators import payload

    rows = [('{"property": "none", "parties": 3, "area": 12.50, "village": {"a": 1}}',), ("[1]",), ("broken {",), (None,), ('{"parties": "[{\\"name\\": \\" A \\"}]", "stamp_number": 7}',)]
    df = spark.createDataFrame(rows, "raw string").select(payload.payload(F.col("raw")).alias("p"))
    got = [r.p for r in df.collect()]
    assert (got[0].property.area, got[0].property.village, got[0].parties) == ("12.5", '{"a":1}', [])
    assert all(p.parties == [] and p.property.area is None for p in got[1:4])
    assert (got[4].parties[0].name, got[4].stamp_number, got[4].stamp_information.stamp_number) == ("A", "7", "7")


def test_document_numbers_of_any_length(spark):
    df = spark.createDataFrame([("Doc No: 1234567 / 95 here",), ("No. 12345678901/2001",), ("dated 03/08/2019 as 123/95 here",), ("call 9876543210/12",)], "s string")
    assert [r[0] for r in df.select(deed.document_number(F.col("s"))).collect()] == ["1234567/95", "12345678901/2001", "123/2095", None]
    assert {k: r.value for k, r in read(spark, [("A", 1, 0, "Doc. No. 1234567890/2003", 0.1)]).items()}["A", "document_number"] == "1234567890/2003"


def test_a_size_is_read_from_one_set_of_words(spark):
    odd = [("E 10 S 5 x 7",), ("North 20, East 10, North 30 m",), ("5 and 3 by 4 × 6",), ("7 m , 8 m",), ("",)]
    rows = spark.createDataFrame(odd, "s string").select(geometry.dimensions(F.col("s")).alias("m"))
    got = [r.m and (round(r.m.ew, 3), round(r.m.ns, 3)) for r in rows.collect()]
    assert got == [(1.524, 2.134), (3.048, 30.0), (1.219, 1.829), (7.0, 8.0), None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_lines_of_parties_are_not_broadcast(spark):
    parties_, lines = "doc long, party long, name string, representative string, given double, corrected boolean", "doc long, ordinal long, page int, text string, score double"
    asked = spark.createDataFrame([(1, 1, "Ann Lee", "Bo", None, False), (1, 2, "Zed", "bo ", None, True), (1, 3, "Smith Holdings", None, None, None), (2, 1, "Ann", None, 0.9, False), (2, 2, " ", None, None, False)], parties_)
    said = spark.createDataFrame([(1, 2, 1, "ANN LEE and Bo", 0.9), (1, 1, 1, "holdings", 0.5), (1, 3, 2, "smith holdings", 0.8)], lines)
    found = parties.party_lines(asked, said)
    got = {(r.doc, r.party): (r.found_by, r.ordinal, r.line) for r in found.collect()}
    assert got == {(1, 1): ("name", 2, "ANN LEE and Bo"), (1, 2): ("representative", 2, "ANN LEE and Bo"), (1, 3): ("name", 3, "smith holdings"), (2, 1): ("none", None, None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_records_are_dealt_out_before_they_are_grouped(spark, tmp_path):
    spark.range(40).selectExpr("nullif(id, 7) as id", "cast(id % 3 as string) as f").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    b = a.where("id > 1 or id is null").withColumn("f", F.when(F.col("id") == 5, "x").otherwise(F.col("f"))).unionByName(a.where("id = 9"))
    ids, told = store.id_differences(a, b, "id"), store.field_differences(a, b, "id", ["f"])
    assert sorted(map(str, (tuple(r) for r in ids.collect()))) == ["(0, 'left')", "(1, 'left')", "(None, 'left')", "(None, 'right')"]
    assert sorted(tuple(r) for r in told.collect() if r.id in (1, 5, 9, 11)) == [(1, "f", "1", 1, 0), (1, "id", "1", 1, 0), (5, "f", "2", 1, 0), (5, "f", "x", 0, 1), (9, "f", "0", 1, 2), (9, "id", "9", 1, 2)]
    for rows in (ids, told):
        assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()


def test_deed_fields_move_their_candidates_by_document(spark):
    plan = registry.QUERIES["deed_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "max(page" not in plan
    lines = spark.createDataFrame([("A", 1, 0, "Village: Rampur", 0.1, 2)], f"{LINES}, last int" if isinstance(LINES, str) else [*LINES, "last"])
    assert "Window" not in candidates.candidates(lines)._jdf.queryExecution().sparkPlan().toString()


def test_wanted_fields_keep_their_rows(spark):
    found = spark.createDataFrame([(1, "village", "Aton", 0.9, 1, 0, "r"), (1, "village", "Zebury", 0.85, 1, 1, "r"), (1, "state", "N", 0.9, 1, 0, "r")], "doc long, field string, value string, score double, page int, ordinal int, reason string")
    wanted = spark.createDataFrame([(1, "village"), (1, "village"), (2, "village")], "doc long, field string")
    got = sorted((r.doc, r.field, r.value or "", r.score, r.status, r.needs_review, r.conflicting) for r in candidates.select_best(found, wanted).collect())
    one = (1, "village", "Aton", 0.65, "CONFLICT", True, ["Aton", "Zebury"])
    assert got == [one, one, (2, "village", "", 0.0, "NOT_FOUND", True, [])]


def test_equal_places_and_questions_count_once(spark):
    asked = spark.createDataFrame([(i, "s", None, None, "Aton" if i % 2 else "Bton") for i in range(40)] + [(99, None, None, None, "Aton")], "id long, state string, district string, mandal string, village string")
    villages = spark.createDataFrame([("s", "d", "", "m", "Aton", 7)] * 20 + [("s", "d", "", "m", "Bton", 20 + i) for i in range(20)], "state string, district string, old_district string, mandal string, village string, feature long")
    features = spark.createDataFrame([("s", "state", "", "", 1)], "state string, level string, district string, mandal string, feature long")
    found = gis.resolve_places(asked, villages, features)
    want = {(i, *(("village", 7) if i % 2 else ("ambiguous", None))) for i in range(40)} | {(99, "none", None)}
    assert {(r.id, r.level, r.feature) for r in found.collect()} == want
    assert "Aggregate [kind" in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_within_their_rows(spark):
    said = [
        "SALE DEED", "This\u00a0 gift \u2003deed", "Doc. No. 12/2003 Regd No: 13|04", " 1234 / 05 ", "12-10-2003/04", "Sy. No. 12, 3/A & 1999", "survey no 3 Survey No 44/2b, 1", "\u00e9sy no 7", "C.T.S. No. 9",
        "c.t.s no 8", "Plot No. 4 & 5", "plot 6 bounded by plot 7", "480 Sq. Yards and 480.5 sq yds", "Village: Aton, Village: Atton Mandal: x", "Village: Zebury\n", "Village: Rampur\u2029", "Mandal: ghatkosar, District: A\u00e9 B",
        "District: Medak", "district: MEDAK", "Rs. 1,000 rs 77 Rs. ,", "Sl. No. 5 dt 1-2-03 Dt: 31/12/1999", "Sold to: X y \t", "sold to a\rb", "executed on this the 5TH day of_octeber, 2003", "made on 40th day of May 2001",
        "Registered on 1.2.2003", "Khata: 1/2 khasra no 3 patta 4\x0b5", "", None, "\u0130 colony: \u0130z, layout: B", "State: North", "doc no 9999999999999999999/99", "dated: 05/06/2001",
    ]
    rows = [(doc, page if page < 4 else None, i, said[(i * 7 + doc) % len(said)], None if i % 9 == 0 else i / 20) for doc in range(60) for i, page in enumerate([1, 1, 2, 2, 3, 60, 4][: doc % 8] * 3)]
    lines = spark.createDataFrame([r for r in rows if r[1] != 60], "doc long, page int, ordinal int, text string, y_rel double")
    best = candidates.select_best(candidates.candidates(lines))
    packed = lines.groupBy("doc").agg(F.max("page").alias("last"), F.collect_list(F.struct("page", "ordinal", "text", "y_rel")).alias("lines"))
    read = candidates.read_documents(packed)
    names = ("field", "value", "score", "status", "needs_review", "conflicting", "page", "reason")
    got = read.select("doc", F.explode("best").alias("field", "b")).select("doc", "field", "b.*")
    told = lambda df: sorted(repr([r[c] for c in ("doc", *names)]) for r in df.collect())
    assert told(got) == told(best) and got.count() > 200
    a, b = ({r.doc: (r.village, r.provenance, r.conflicts, r.reviews) for r in candidates.documents(x).collect()} for x in (read, best))
    assert {k: v for k, v in a.items() if v[1]} == b
    moved = registry.QUERIES["deed_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in moved and "Generate" not in moved


def test_uncompared_values_are_no_nulls_for_python(spark):
    found = spark.createDataFrame([(i, "village", "Aton", 0.9, 1, 0, "r") for i in range(3)], "doc long, field string, value string, score double, page int, ordinal int, reason string")
    plan = candidates.select_best(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE []" in plan.split("distinct_spellings(")[1][:600]
