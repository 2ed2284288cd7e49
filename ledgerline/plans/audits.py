"""Registered queries of audits over twelve fields, checks wired to the
duplicates and land rules, hints, notes, languages and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence, deed, script, text
from ..operators import accounts, audit, duplicates, fields, payload
from .desk import _REC, _raw
from .pages import _text
from .registry import query, t

_TWELVE = "'document_type', 'document_number', 'document_date', 'survey_number', 'sub_survey_number', 'property_area', 'village', 'mandal', 'district', 'vendor', 'purchaser', 'consideration_amount'"


@query(f"""
WITH f AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderkey % 4 AS k, unnest([{_TWELVE}]) AS field FROM orders),
v AS (SELECT doc, field, CASE field WHEN 'document_type' THEN 'Sale Deed' WHEN 'village' THEN CASE WHEN k = 0 THEN NULL ELSE 'Town ' || c END
    WHEN 'vendor' THEN CASE k WHEN 0 THEN 'Firm ' || c WHEN 1 THEN 'Seller ' || c END WHEN 'purchaser' THEN CASE WHEN k < 2 THEN 'Buyer ' || c END
    WHEN 'consideration_amount' THEN CASE WHEN k = 3 THEN '500' ELSE '100' END WHEN 'mandal' THEN 'North' END AS semantic,
  CASE field WHEN 'document_type' THEN 'SALE-DEED' WHEN 'village' THEN 'Town ' || c WHEN 'vendor' THEN 'Firm ' || c WHEN 'consideration_amount' THEN '100' WHEN 'district' THEN 'D' END AS neural FROM f)
SELECT doc, field, CASE WHEN semantic IS NULL AND neural IS NULL THEN 'BOTH_MISSING' WHEN semantic IS NULL THEN 'SEMANTIC_MISSING' WHEN neural IS NULL THEN 'NEURAL_MISSING'
  WHEN field IN ('document_type', 'village') OR semantic = neural THEN 'AGREEMENT' ELSE 'DISCREPANCY_ADVISORY' END AS status FROM v""")
def field_audit(spark, d):
    """Twelve fields of two extractions: by other names, nested or by role."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    texts = "map<string, string>"
    top = F.create_map(F.lit("document_type"), F.lit("Sale Deed"), F.lit("executant"), F.when(k == 0, _text("Firm ", c)), F.lit("stamp_value"), F.when(k == 3, "500"))
    place = F.create_map(F.lit("village"), F.when(k != 0, _text("Town ", c)), F.lit("mandal"), F.lit("North"))
    people = F.when(k < 2, F.array(F.struct(F.lit("The Buyer").alias("role"), _text("Buyer ", c).alias("name")), F.struct(F.lit("Seller").alias("role"), _text("Seller ", c).alias("name"))))
    orders = t(spark, d, "orders")
    rules = orders.select(F.col("o_orderkey").alias("doc"), top.cast(texts).alias("fields"), place.alias("property"), F.create_map(F.lit("stamp_value"), F.lit("100")).alias("stamp"), people.alias("parties"))
    told = F.create_map(F.lit("document_type"), F.lit("SALE-DEED"), F.lit("village"), _text("Town ", c), F.lit("vendor"), _text("Firm ", c), F.lit("consideration_amount"), F.lit("100"), F.lit("district"), F.lit("D"))
    none = F.lit(None)
    model = orders.select(F.col("o_orderkey").alias("doc"), told.alias("fields"), none.cast(texts).alias("property"), none.cast(texts).alias("stamp"), none.cast("array<struct<role: string, name: string>>").alias("parties"))
    return audit.audit_fields(audit.canonical_fields(rules), audit.canonical_fields(model)).select("doc", "field", "status")


@query(f"""
WITH r AS (SELECT *, id - id % 2 AS number FROM ({_REC})), a AS (SELECT number, min(id) AS first, max(id) AS other FROM r WHERE status = 'APPROVED' GROUP BY number)
SELECT r.id, CASE WHEN CASE WHEN r.id = a.first THEN nullif(a.other, a.first) ELSE a.first END IS NOT NULL AND r.number >= 1000 THEN 'FAIL' ELSE 'PASS' END AS duplicate, 'PASS' AS land
FROM r LEFT JOIN a USING (number)""")
def wired_checks(spark, d):
    """The first two checks of a record from what they are about: approved
    records of the same number, and the fields that make a land record."""
    p = F.col("p")
    rows = _raw(spark, d).select("id", "status", payload.payload(F.col("raw")).alias("p"))
    number = (F.col("id") - F.col("id") % 2).cast("string")  # two records share each number
    none = F.lit(None).cast("string")
    keys = rows.select("id", F.col("id").alias("created"), none.alias("file_hash"), F.when(F.length(number) >= 4, number).alias("doc_no"), none.alias("stamp_no"), none.alias("village"), none.alias("survey"), "status")
    found = duplicates.duplicate_of(keys.drop("status"), keys.where("status = 'APPROVED'").drop("status"))
    land = payload.is_land_record({"document_type": p["document_type"], "survey_number": p["property"]["survey_number"], "property_area": p["property"]["area"]}, F.size(p["parties"]))
    rows = rows.join(found.select("id", F.lit(True).alias("twice")), "id", "left")
    checks = payload.checklist(p, F.coalesce("twice", F.lit(False)), land, F.lit(True))
    return rows.select("id", checks[0]["status"].alias("duplicate"), checks[1]["status"].alias("land"))


@query("""
SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS extracted, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'raw ' || o_custkey ELSE 'value ' || o_custkey END END AS raw,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'value ' || o_custkey END AS normalised, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 6)::VARCHAR END AS page,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN round(o_custkey % 90 / 100.0, 2) END::DOUBLE AS confidence, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 = 1 THEN 4 + o_custkey END AS right_side FROM orders""")
def provenance_hints(spark, d):
    """What is shown beside a field: raw reading, page, confidence, place."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entry = F.create_map(
        F.when(k % 2 == 0, "raw_ocr_value").otherwise("original_value"), F.when(k % 3 == 0, _text("raw ", c)).otherwise(_text(" value ", c)),
        F.when(k % 2 == 0, "page").otherwise("page_number"), (c % 6).cast("string"), F.lit("confidence"), F.when(k % 5 == 0, "high").otherwise((c % 90 / 100).cast("string")),
        F.lit("bbox"), F.when(k % 2 == 1, _text("[1, 2, ", c + 4, ", 9]")).otherwise("[1, 2]"),
    )
    hint = fields.provenance_hint(F.when(k % 4 != 0, _text("value ", c)).otherwise(" "), entry)
    rows = t(spark, d, "orders").select(k.alias("id"), hint.alias("h")).select("id", "h.*")
    return rows.withColumn("right_side", F.col("box")[2].cast("long")).drop("box")


@query("""
SELECT o_orderkey AS id, concat_ws('', CASE WHEN o_orderkey % 3 = 0 THEN 'f' END, CASE WHEN o_orderkey % 5 < 2 THEN 'a' END, CASE WHEN o_orderkey % 3 < 2 THEN 'm' END, CASE WHEN o_orderkey % 5 = 0 THEN 'u' END,
  CASE WHEN o_custkey % 2 = 0 THEN 'p' END, CASE WHEN o_custkey % 3 = 0 THEN 'h' END, CASE WHEN o_custkey % 7 = 0 THEN 's' END) AS notes FROM orders""")
def important_notes(spark, d):
    """All seven notes of a page, each by its own condition."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 3 == 0, _text("deed ", k, " contd...")).when(k % 3 == 1, _text("deed ", k, " 2/p")).otherwise(_text("deed ", k))
    status = F.when(k % 5 == 0, "CONTINUES_ON_NEXT_PAGE").when(k % 5 == 1, "NOT_FOUND_ON_PAGE").otherwise("FOUND")
    letters = F.create_map(*[F.lit(x) for name, said in deed.NOTES.items() for x in (said, name[0])])
    told = F.transform(deed.page_notes(text, status, c % 2 == 0, c % 3 == 0, c % 7 == 0), lambda n: letters[n])
    return t(spark, d, "orders").select(k.alias("id"), F.array_join(told, "").alias("notes"))


@query("""
WITH k AS (SELECT conv_id, turn, turn % 4 AS s, conv_id % 3 = 0 AS marathi FROM conversations),
n AS (SELECT conv_id, marathi, bool_or(s = 0) AS telugu, bool_or(s = 1) AS deva, bool_or(s = 2) AS arabic, count(*) FILTER (s = 0) * 5 AS t, count(*) FILTER (s = 1) * 6 AS dv, count(*) FILTER (s = 2) * 7 AS ar, count(*) FILTER (s = 3) * 8 AS la FROM k GROUP BY ALL)
SELECT conv_id, concat_ws(',', CASE WHEN telugu THEN 'te' ELSE 'en' END) AS extractor,
  CASE WHEN la >= greatest(t, dv, ar) AND la > 0 AND la > greatest(t, dv, ar) THEN 'English' WHEN ar > greatest(t, dv, la) THEN 'Urdu' WHEN dv > greatest(t, ar, la) THEN CASE WHEN marathi THEN 'Marathi' ELSE 'Hindi' END
    WHEN t > greatest(dv, ar, la) THEN 'Telugu' END AS first, telugu AS has_telugu, deva AS has_devanagari FROM n""")
def conversation_languages(spark, d):
    """Languages of pages whose lines are of four scripts, by turn."""
    s = F.col("turn") % 4
    line = F.when(s == 0, "తెలుగ").when(s == 1, "हहहहहह").when(s == 2, "اردواردو").otherwise("lettersx")
    line = F.when(s == 2, "اردوارد").otherwise(line)
    context = F.when(F.col("conv_id") % 3 == 0, "Maharashtra")
    rows = t(spark, d, "conversations").select("conv_id", "turn", line.alias("text"))
    pages = rows.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("text"))
    pages = pages.withColumn("page", script.page_languages(script.script_counts(F.col("text")), context))
    return pages.select(
        "conv_id", script.extractor_language(F.col("text")).alias("extractor"), F.col("page.primary").alias("first"),
        F.array_contains("page.languages", "Telugu").alias("has_telugu"), F.exists("page.languages", lambda x: x.isin("Hindi", "Marathi")).alias("has_devanagari"),
    )


@query("""
WITH f AS (SELECT l_orderkey AS id, avg(1 - l_discount) FILTER (l_returnflag = 'R') AS own, avg(1 - l_tax) FILTER (l_linestatus = 'F') AS pages FROM lineitem GROUP BY l_orderkey)
SELECT id, round(coalesce(own, CASE WHEN pages > 0 THEN pages END, CASE o_orderstatus WHEN 'F' THEN 0.88 + 0.10 * 0.75 ELSE 0.70 + 0.18 * 0.75 END), 3)::DOUBLE AS confidence
FROM f JOIN orders ON o_orderkey = id""")
def document_confidences(spark, d):
    """By its fields, else by its pages, else by a guess."""
    is_ = lambda c, v: F.when(F.col(c) == v, True)
    means = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.avg(F.when(is_("l_returnflag", "R"), 1 - F.col("l_discount"))).alias("own"), F.avg(F.when(is_("l_linestatus", "F"), 1 - F.col("l_tax"))).alias("pages")
    )
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("DRAFT")
    guess = F.when(status == "APPROVED", 0.88 + 0.10 * 0.75).otherwise(0.70 + 0.18 * 0.75)
    rows = means.join(t(spark, d, "orders"), F.col("id") == F.col("o_orderkey"))
    return rows.select("id", confidence.document_confidence(F.col("own"), F.col("pages"), guess).alias("confidence"))


@query("""
SELECT 'session ' || o_orderkey AS token, CASE o_orderkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' END AS action FROM orders WHERE o_orderkey % 4 < 2
UNION ALL SELECT 'late ' || o_orderkey, 'insert' FROM orders WHERE o_orderkey % 4 = 3""")
def session_reconcile(spark, d):
    """Sessions of a snapshot and as they are now."""
    k = F.col("o_orderkey")
    was = t(spark, d, "orders").select(_text("session ", k).alias("token"), _text("u", F.col("o_custkey")).alias("user_id"), k.alias("k"))
    now = was.where("k % 4 <> 0").withColumn("user_id", F.when(F.col("k") % 4 == 1, F.concat("user_id", F.lit("b"))).otherwise(F.col("user_id")))
    late = was.where("k % 4 = 3").withColumn("token", _text("late ", F.col("k")))
    return accounts.reconcile_owned(was.drop("k"), now.unionByName(late).drop("k"), "token", ["token", "user_id"])


@query("""
SELECT c_custkey AS user_id, row_number() OVER (ORDER BY made DESC NULLS LAST, c_custkey) AS place FROM (
  SELECT c_custkey, max(o_orderdate) AS made FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) QUALIFY place <= 40""")
def newest_users(spark, d):
    """The forty users of the latest date."""
    made = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("created_at"))
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(made, "user_id", "left")
    listed = F.sort_array(F.collect_list(F.struct(F.col("created_at").isNull().alias("none"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("before"), "user_id")))
    first = accounts.newest(users, 40).agg(listed.alias("u"))  # forty rows
    return first.select(F.posexplode("u").alias("at", "x")).select("x.user_id", (F.col("at") + 1).cast("long").alias("place"))


@query("""
SELECT c_custkey AS id, 'M/s. ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || c_custkey || 'th Homes ' || CASE WHEN c_custkey % 2 = 0 THEN 'PVT. LTD.' ELSE 'Private Limited' END AS company,
  ['S/o', 'W/o', 'D/o'][c_custkey % 3 + 1] || ' Ram Kumar ' || c_custkey AS relation, 'card [MASKED] of ' || c_custkey AS masked,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Known ' || c_custkey END AS known, lower(c_mktsegment) || ',' || (c_custkey + 100) AS tokens,
  'Flat ' || c_custkey || ', H.No.' || (c_custkey % 50) || ' Long Street' AS address, '12/' || c_custkey AS number, 'A.' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || '-' || c_custkey || 'X' AS title FROM customer""")
def customer_names(spark, d):
    """Names, relations and addresses as they are written on deeds, cleaned."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    form = F.when(k % 2 == 0, "pvt ltd").otherwise("PRIVATE limited")
    kin = F.element_at(F.array(F.lit("s/O. "), F.lit("W/O "), F.lit("d/o. ")), (k % 3 + 1).cast("int"))
    card = F.concat(F.lit("card 1234"), F.when(k % 2 == 0, " 5678-").otherwise("5678"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" of "), k.cast("string"))
    known = text.meaningful(F.when(k % 4 == 0, " Not Specified ").otherwise(_text("  Known ", k)))
    address = text.clean_address(_text(" FLAT ", k, ", H. No.", k % 50, " long   street (near x) aadhaar 1"))
    tokens = text.core_tokens(_text(segment, " Homes, M/s ", segment, " Pvt. ", k + 100))
    return t(spark, d, "customer").select(
        k.alias("id"), text.company(_text(" m/s. ", F.lower(segment), "  ", k, "TH HOMES ", form)).alias("company"), text.relation(_text(kin, "ram  KUMAR ", k, ",")).alias("relation"),
        text.masked(card).alias("masked"), known.alias("known"), F.array_join(tokens, ",").alias("tokens"), address.alias("address"),
        text.smart_number(_text("1 2|", k)).alias("number"), text.titled(_text("a.", segment, "-", k, "x")).alias("title"),
    )
