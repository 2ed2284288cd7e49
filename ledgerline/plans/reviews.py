"""Registered queries of OCR lines, field candidates and reviews of deeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fields
from .registry import query, t


@query(r"""
WITH c AS (SELECT doc_id, v, i FROM (SELECT doc_id, regexp_extract_all(text, '\d{3,}') AS a FROM documents), unnest(a) WITH ORDINALITY AS u(v, i))
SELECT doc_id AS doc, i::BIGINT AS ordinal, v AS value,
  round(least(length(v), 9) / 10.0::DOUBLE + CASE WHEN count(*) OVER (PARTITION BY doc_id, v) > 1 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score FROM c""")
def agreement_boost(spark, d):
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"\d{3,}"), F.lit(0))).alias("i", "value")
    c = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("number").alias("field"), found)
    c = fields.agreement_boost(c.withColumn("score", F.least(F.length("value"), F.lit(9)) / 10), F.col("value"))
    return c.select("doc", (F.col("i") + 1).cast("long").alias("ordinal"), "value", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT o_custkey AS doc, o_orderkey AS ordinal, o_orderstatus = 'F' AS pref, (70 + 5 * (o_orderkey % 5)) / 100.0::DOUBLE AS score,
  list_sort(list_distinct(list(l_partkey % 5))) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus),
w AS (SELECT *, bool_or(pref) OVER (PARTITION BY doc) AS any_pref, first_value(v) OVER (PARTITION BY doc ORDER BY pref DESC, len(v) DESC, score DESC, ordinal) AS best FROM c)
SELECT doc, array_to_string(any_value(best), ', ') AS chosen,
  bool_or(pref = any_pref AND score >= 0.80 AND NOT list_has_all(best, v) AND NOT list_has_all(v, best)) AS conflict FROM w GROUP BY doc""")
def survey_number_sets(spark, d):
    sets = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey") % 5)).alias("numbers"))
    c = t(spark, d, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("doc"), "numbers", (F.col("o_orderstatus") == "F").alias("preferred"),
        ((F.col("o_orderkey") % 5 * 5 + 70) / 100).alias("score"), F.lit(1).alias("page"), F.col("o_orderkey").alias("ordinal"),
    )
    return fields.number_sets(c).withColumn("chosen", F.array_join(F.col("chosen").cast("array<string>"), ", "))


@query("""
WITH e AS (SELECT user_id AS doc, event_type, event_id, ts::DATE = min(ts::DATE) OVER (PARTITION BY user_id) AS first_page FROM events),
f AS (SELECT doc, event_type, min(event_id) AS first_id FROM e WHERE first_page GROUP BY doc, event_type)
SELECT doc, string_agg(event_type, ', ' ORDER BY first_id) AS listed FROM f GROUP BY doc""")
def first_page_lists(spark, d):
    rows = t(spark, d, "events").select(
        F.col("user_id").alias("doc"), F.to_date("ts").alias("page"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("value")
    )
    return fields.first_page_list(rows).withColumn("listed", F.array_join("listed", ", "))


@query("""
WITH s AS (SELECT conv_id AS doc, turn, coalesce(text, '') AS text, turn % 5 = 4 AS ends, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations),
c AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc, block ORDER BY turn) AS closed FROM s)
SELECT doc, block::BIGINT AS block, count(*) AS lines, string_agg(text, ' ' ORDER BY turn) AS content FROM c WHERE block > 0 AND closed = 0 GROUP BY doc, block""")
def party_blocks(spark, d):
    lines = t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), "role")
    return fields.text_blocks(lines, F.col("role") == "user", F.col("line_no") % 5 == 4)


@query("""
WITH l AS (SELECT doc_id AS doc, i, line, lower(line) AS l, lower(substr(text, 30, 25)) AS value FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
  unnest(a) WITH ORDINALITY AS u(line, i)),
s AS (SELECT doc, i, contains(l, value) AS exact, len([x FOR x IN list_distinct(regexp_extract_all(value, '[a-z0-9]{2,}')) IF contains(l, x)]) AS shared FROM l)
SELECT doc, (i - 1)::BIGINT AS line_no, exact FROM s WHERE exact OR shared > 0
QUALIFY row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN exact THEN 1000000 ELSE shared END DESC, i) = 1""")
def evidence_line(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line_no", F.col("n").cast("long"))
    return fields.evidence_line(docs.select("doc", F.substring("text", 30, 25).alias("value")), lines)


@query(r"""
WITH w AS (SELECT doc_id, i - 1 AS i, v FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM documents), unnest(a) WITH ORDINALITY AS u(v, i))
SELECT doc_id AS doc, (i // 480)::BIGINT AS page, ((i % 480) // 12 + 1)::BIGINT AS line_no, string_agg(v, ' ' ORDER BY i) AS text, round(avg((50 + i % 7) / 100.0::DOUBLE), 6) AS score
FROM w GROUP BY ALL""")
def word_lines(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 480).cast("int")), lambda p: F.struct(p.alias("page"), F.slice("words", p * 480 + 1, 480).alias("said")))
    parts = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), found).where(F.size("words") > 0).select("doc", F.inline(cut))
    # pages move as lists of words; rows that repeat a document share its pages
    pages = parts.groupBy("doc", "page").agg(F.collect_list("said").alias("parts")).select("doc", "page", F.explode("parts").alias("said"))
    words = pages.select("doc", "page", F.posexplode("said").alias("j", "text"))
    i, j = F.col("page") * 480 + F.col("j"), F.col("j")
    words = words.select(
        "doc", "page", "text", ((i % 7 + 50) / 100).alias("score"), (j % 12 * 50).alias("x_min"),
        (F.floor(j / 12) * 40 + i % 3).alias("y_center"), F.lit(20).alias("height"),
    )
    return fields.neighbouring_word_lines(words).withColumn("score", F.round("score", 6))


@query("""
SELECT conv_id, turn, CASE WHEN p = 1 THEN 'stamp_metadata' WHEN p = 2 THEN 'property_schedule' WHEN p = n THEN 'registration_plan' ELSE 'deed_text' END AS page_type
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def page_types(spark, d):
    pages = Window.partitionBy("conv_id")
    kind = fields.page_type(F.row_number().over(pages.orderBy("turn")), F.count("*").over(pages))
    return t(spark, d, "conversations").select("conv_id", "turn", kind.alias("page_type"))


@query("""
WITH l AS (SELECT doc_id, i, line, (i % 10) / 10.0::DOUBLE AS score, i / len(a)::DOUBLE AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i))
SELECT doc_id, count(*) AS lines, count(*) FILTER ((y <= 0.16 AND regexp_matches(line, '[0-9]')) OR (score < 0.72 AND length(line) BETWEEN 3 AND 70 AND NOT contains(lower(line), 'copyright'))) AS handwritten
FROM l GROUP BY doc_id""")
def handwriting_lines(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    at = F.col("i") + 1
    by_hand = fields.handwritten(F.col("line"), at % 10 / 10, at / F.col("n"), "copyright")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(by_hand).alias("handwritten"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderpriority AS p0, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN ' ' || o_orderpriority ELSE '' END AS p1,
  o_orderstatus AS s0, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS s1 FROM orders),
u AS (SELECT o_orderkey, 'o_orderpriority' AS field, p0 AS before, trim(p1) AS after FROM f UNION ALL SELECT o_orderkey, 'o_orderstatus', s0, trim(s1) FROM f)
SELECT * FROM u WHERE after <> '' AND trim(before) IS DISTINCT FROM after""")
def payload_changes(spark, d):
    orders, k, p = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")
    form = orders.select(
        k, F.when(k % 3 == 0, F.lower(p)).when(k % 3 == 1, F.concat(F.lit(" "), p)).otherwise("").alias("o_orderpriority"),
        F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return fields.payload_changes(orders, form, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_orderkey % 11 = 0 AS dup, o_totalprice <= 1000 AS failed, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'blurred' END AS reason FROM orders)
SELECT o_orderkey, CASE WHEN a = 0 AND trim(reason) <> '' THEN 'REJECTED' WHEN a IN (1, 2) AND NOT dup AND NOT failed THEN 'APPROVED' WHEN a = 3 THEN 'READY_FOR_APPROVAL' END AS status,
  CASE WHEN a = 0 AND trim(reason) = '' THEN 'a reason is needed' WHEN a = 0 THEN 'rejected' WHEN a IN (1, 2) AND dup THEN 'duplicate' WHEN a IN (1, 2) AND failed THEN 'critical check failed'
    WHEN a IN (1, 2) THEN 'sealed' WHEN a = 3 THEN 'sent' ELSE 'unknown action' END AS message FROM r""")
def review_decisions(spark, d):
    k = F.col("o_orderkey")
    action = F.when(k % 5 == 0, "reject").when(k % 5 <= 2, "approve").when(k % 5 == 3, "submit_to_officer").otherwise("shred")
    made = fields.decide(action, k % 11 == 0, F.col("o_totalprice") <= 1000, F.when(k % 3 == 0, " ").otherwise("blurred"))
    return t(spark, d, "orders").select(k, made.alias("m")).select("o_orderkey", "m.status", "m.message")


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate AS made, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 DAY END AS sent, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 5 DAY END AS sealed FROM orders)
SELECT o_orderkey, 1::BIGINT AS step, 'received' AS event, made AS at FROM o UNION ALL SELECT o_orderkey, 2, 'checked', coalesce(sent, made) FROM o
UNION ALL SELECT o_orderkey, 3, 'sent', sent FROM o WHERE sent IS NOT NULL UNION ALL SELECT o_orderkey, 4, 'sealed', sealed FROM o WHERE sealed IS NOT NULL""")
def audit_timeline(spark, d):
    made, status = F.col("o_orderdate"), F.col("o_orderstatus")
    sent = F.when(status != "O", made + F.make_dt_interval(F.lit(2)))
    steps = {"received": made, "checked": F.coalesce(sent, made), "sent": sent, "sealed": F.when(status == "F", made + F.make_dt_interval(F.lit(5)))}
    return fields.timeline(t(spark, d, "orders"), "o_orderkey", steps)


@query("""
WITH m AS (SELECT l_orderkey, avg(1 - l_discount) AS mean FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey),
l AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place,
  round(coalesce(mean, CASE o_orderstatus WHEN 'F' THEN 0.88 + 0.1 * 0.9 WHEN 'P' THEN 0.35 + 0.2 * 0.8 ELSE 0.7 + 0.18 * 0.9 END), 3)::DOUBLE AS confidence FROM l LEFT JOIN m ON l_orderkey = o_orderkey""")
def doc_confidence_trend(spark, d):
    last = t(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)
    # ten keys restrict the rows that are averaged
    lines = t(spark, d, "lineitem").where("l_returnflag <> 'N'")
    lines = lines.join(F.broadcast(last.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    mean = lines.groupBy("l_orderkey").agg(F.avg(1 - F.col("l_discount")).alias("mean"))
    filled, checked = F.lit(1.0), F.lit(0.8)
    both, status = (filled + checked) / 2, F.col("o_orderstatus")
    guess = F.when(status == "F", 0.88 + 0.10 * both).when(status == "P", 0.35 + 0.20 * checked).otherwise(0.70 + 0.18 * both)
    place = F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey"))  # ten rows
    rows = last.join(mean, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", place.cast("long").alias("place"), F.round(F.coalesce("mean", guess), 3).alias("confidence"))


@query()
def fuzzy_variants(spark, d):
    names = t(spark, d, "part").select("p_partkey", "p_name")
    after = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return names.join(after, "p_partkey").withColumn("variant", fields.spelling_variant("p_name", "next_name"))
