"""Registered queries of what desks and dashboards show of records: payloads,
checklists, queues, filters, orders and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence
from ..operators import analytics, payload
from ..sources import files
from .registry import query, t

# An order is a record. Its raw form is JSON whose fields lie in various places.
_REC = """
  SELECT o_orderkey AS id, o_custkey AS owner, n_name AS district, r_name AS state, c_name AS buyer, o_orderkey % 17 AS m17,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS made,
    CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'REJECTED' ELSE ['READY_FOR_APPROVAL', 'NEEDS_REVIEW', 'FAIL', 'DUPLICATE'][o_orderkey % 4 + 1] END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS submitted,
    ['Sale Deed', 'GPA Agreement', 'Power of Attorney cum sale deed', 'Agreement of Sale', 'Gift Deed'][o_orderkey % 5 + 1] AS doc_type,
    CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '278, 281' WHEN 2 THEN '3|4' ELSE '' END AS survey,
    CASE o_orderkey % 3 WHEN 0 THEN '480 sq. yards' WHEN 1 THEN (o_orderkey % 900)::VARCHAR ELSE '12.5' END AS area
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def records(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    places = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("id"), F.col("o_custkey").alias("owner"), F.col("n_name").alias("district"), F.col("r_name").alias("state"), F.col("c_name").alias("buyer"), (k % 17).alias("m17"),
        F.when(k % 17 != 0, F.col("o_orderdate")).alias("made"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "REJECTED")
        .otherwise(pick(("READY_FOR_APPROVAL", "NEEDS_REVIEW", "FAIL", "DUPLICATE"), 4)).alias("status"),
        F.when(k % 5 == 0, None).otherwise(k % 5 > 1).alias("submitted"),
        pick(("Sale Deed", "GPA Agreement", "Power of Attorney cum sale deed", "Agreement of Sale", "Gift Deed"), 5).alias("doc_type"),
        F.when(k % 4 == 0, "12").when(k % 4 == 1, "278, 281").when(k % 4 == 2, "3|4").otherwise("").alias("survey"),
        F.when(k % 3 == 0, "480 sq. yards").when(k % 3 == 1, (k % 900).cast("string")).otherwise("12.5").alias("area"),
    )


def submitted() -> Column:
    """Whether a record was handed in; by its status where it doesn't say."""
    return F.coalesce("submitted", F.upper("status").isin("APPROVED", "REJECTED", "DUPLICATE"))


_SUBMITTED = "coalesce(submitted, status IN ('APPROVED', 'REJECTED', 'DUPLICATE'))"


def _raw(spark, d) -> DataFrame:
    """Records as raw JSON: fields nested, flat or prefixed; parties a list, a
    text, or by role."""
    r, k = files.spread(records(spark, d), "id"), F.col("id")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    listed = F.concat(F.lit('[{"party_name": '), q(F.concat(F.lit(" "), F.col("buyer"))), F.lit(', "type": "Buyer"}, {"name": "Seller A", "role": "Seller"}]'))
    by_role = F.concat(F.lit('{"Buyer": [{"full_name": '), q(F.col("buyer")), F.lit('}], "Seller": [{"name": "Seller A"}]}'))
    as_text = F.to_json(F.struct(listed.alias("x")))  # a JSON text of a JSON list
    as_text = F.substring(as_text, 6, 2**31 - 1)
    as_text = F.substring(as_text, F.lit(1), F.length(as_text) - 1)
    parties = F.when(k % 3 == 0, listed).when(k % 3 == 1, by_role).when(k % 9 == 2, F.lit("[]")).otherwise(as_text)
    place = F.concat(F.lit('"survey_number": '), q(F.col("survey")), F.lit(', "area": '), q(F.col("area")), F.lit(', "village": " V '), k.cast("string"), F.lit('"'))
    nested = F.concat(F.lit('"property": {'), place, F.lit(', "district": '), q(F.col("district")), F.lit("}"))
    flat = F.concat(place, F.lit(', "property_district": '), q(F.col("district")))
    number = F.concat(F.lit('"S'), k.cast("string"), F.lit('"'))
    stamp = F.when(k % 2 == 0, F.concat(F.lit('"stamp_number": '), number, F.lit(', "stamp_information": {"sold_to": '), q(F.lower("buyer")), F.lit("}")))
    stamp = stamp.otherwise(F.concat(F.lit('"stamp_information": {"stamp_number": '), number, F.lit(', "sold_to": "Nobody"}')))
    made = F.coalesce(F.date_format("made", "dd-MM-yyyy"), F.lit(""))
    signed = F.date_format(F.date_add("made", F.when(k % 2 == 0, 3).otherwise(-3)), "yyyy/MM/dd")
    raw = F.concat(
        F.lit('{"document_type": '), q(F.when(k % 23 == 0, " ").otherwise(F.col("doc_type"))), F.lit(', "document_number": " '), k.cast("string"), F.lit('/24 ", "document_date": "'),
        made, F.lit('", "execution_date": "'), F.coalesce(signed, F.lit("soon")), F.lit('", "parties": '), parties, F.lit(", "), F.when(k % 2 == 0, nested).otherwise(flat), F.lit(", "), stamp, F.lit("}"),
    )
    return r.withColumn("raw", raw)


_PARTIES = """CASE WHEN id % 9 = 2 THEN '[]' ELSE '[{"name":"' || buyer || '","relation":null,"role":"Buyer","address":null},{"name":"Seller A","relation":null,"role":"Seller","address":null}]' END"""


@query(f"""
SELECT id, '{{"document_date":' || coalesce('"' || strftime(made, '%d-%m-%Y') || '"', 'null') || ',"document_number":"' || id || '/24","document_type":' || CASE WHEN id % 23 = 0 THEN 'null' ELSE '"' || doc_type || '"' END
  || ',"execution_date":"' || coalesce(strftime(made::DATE + CASE WHEN id % 2 = 0 THEN 3 ELSE -3 END, '%Y/%m/%d'), 'soon') || '","parties":' || {_PARTIES}
  || ',"property":{{"area":"' || area || '","district":"' || district || '","mandal":null,"survey_number":' || CASE WHEN survey = '' THEN 'null' ELSE '"' || survey || '"' END || ',"village":"V ' || id || '"}}'
  || ',"stamp_information":{{"sold_to":"' || CASE WHEN id % 2 = 0 THEN lower(buyer) ELSE 'Nobody' END || '","stamp_number":"S' || id || '","stamp_value":null}},"stamp_number":"S' || id || '","stamp_value":null}}' AS payload FROM ({_REC})""")
def canonical_records(spark, d):
    return _raw(spark, d).select("id", payload.canonical(payload.payload(F.col("raw"))).alias("payload"))


@query(f"""
SELECT id, 'PASS ' || CASE WHEN id % 7 = 0 THEN 'FAIL ' ELSE 'PASS ' END || CASE WHEN id % 23 = 0 OR survey = '' OR id % 9 = 2 THEN 'FAIL ' ELSE 'PASS ' END
  || CASE WHEN id % 3 = 0 OR (id % 3 = 1 AND id % 900 = 0) THEN 'FAIL ' ELSE 'PASS ' END || CASE WHEN made IS NOT NULL AND id % 2 = 0 THEN 'PASS ' ELSE 'WARNING ' END
  || CASE WHEN survey = '' THEN 'FAIL ' WHEN survey = '3|4' THEN 'WARNING ' ELSE 'PASS ' END || 'WARNING ' || CASE WHEN id % 11 = 0 THEN 'WARNING ' ELSE 'PASS ' END
  || CASE WHEN id % 2 = 0 OR id % 9 = 2 THEN 'PASS' ELSE 'WARNING' END AS checks,
  concat_ws(',', CASE WHEN id % 23 = 0 THEN 'document_type' END, CASE WHEN id % 9 = 2 THEN 'parties' END, CASE WHEN survey = '' THEN 'property.survey_number' END) AS missing FROM ({_REC})""")
def record_checklist(spark, d):
    k, p = F.col("id"), F.col("p")
    rows = _raw(spark, d).select("id", payload.payload(F.col("raw")).alias("p"))
    checks = payload.checklist(p, F.lit(False), k % 7 != 0, F.when(k % 11 == 0, F.lit(False)))
    return rows.select("id", F.array_join(F.transform(checks, lambda c: c["status"]), " ").alias("checks"), F.array_join(payload.missing_fields(p), ",").alias("missing"))


@query(f"""
SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'document_type' END, CASE WHEN survey <> '' THEN 'survey_number' END, CASE WHEN id % 3 = 0 THEN 'property_area' END,
  CASE WHEN id % 5 = 0 THEN 'stamp_sold_to' END, 'parties') AS fields, id % 2 = 0 OR survey <> '' OR id % 3 = 0 OR id % 5 = 0 AS is_land FROM ({_REC})""")
def land_records(spark, d):
    k = F.col("id")
    values = {
        "document_type": F.when(k % 2 == 0, "x").otherwise(" "), "survey_number": F.col("survey"), "property_area": F.when(k % 3 == 0, 0.0),
        "stamp_sold_to": F.when(k % 5 == 0, F.col("buyer")),
    }
    return records(spark, d).select("id", F.array_join(payload.populated(values, F.lit(2)), ",").alias("fields"), payload.is_land_record(values, F.lit(2)).alias("is_land"))


@query(f"""
SELECT id, status, row_number() OVER (ORDER BY made NULLS FIRST, id) AS place FROM ({_REC}) WHERE status IN ('READY_FOR_APPROVAL', 'NEEDS_REVIEW') AND {_SUBMITTED} QUALIFY place <= 50""")
def officer_queue(spark, d):
    """Oldest first; the first fifty, each with its place."""
    queue = records(spark, d).where(F.col("status").isin("READY_FOR_APPROVAL", "NEEDS_REVIEW") & submitted())
    first = queue.orderBy(F.asc_nulls_first("made"), "id").limit(50)
    return first.select("id", "status", F.row_number().over(Window.orderBy(F.asc_nulls_first("made"), "id")).cast("long").alias("place"))


@query(f"""
SELECT id, status, made FROM ({_REC}) WHERE {_SUBMITTED} OR status IN ('APPROVED', 'REJECTED') ORDER BY made DESC NULLS LAST, id LIMIT 100""")
def master_ledger(spark, d):
    """Newest first, without a date last; the newest hundred."""
    rows = records(spark, d).where(submitted() | F.col("status").isin("APPROVED", "REJECTED"))
    return rows.orderBy(F.desc_nulls_last("made"), "id").limit(100).select("id", "status", "made")


@query(f"""
SELECT state, count(*) AS records, sum(serial)::BIGINT AS serials, max(serial) AS newest FROM (
  SELECT state, count(*) OVER (PARTITION BY state) - row_number() OVER (PARTITION BY state ORDER BY made DESC NULLS LAST, id) + 1 AS serial FROM ({_REC})) GROUP BY state""")
def reverse_serials(spark, d):
    rows = analytics.numbered(records(spark, d).select("state", "made", "id"), "state", F.desc_nulls_last("made"), F.col("id"))
    rows = rows.select("state", (F.col("of") - F.col("nth") + 1).alias("serial"))
    return rows.groupBy("state").agg(F.count("*").alias("records"), F.sum("serial").alias("serials"), F.max("serial").alias("newest"))


@query(f"""
SELECT id, district FROM ({_REC}) WHERE lower(trim(district)) = 'nation_3' AND lower(doc_type) = 'sale deed'""")
def officer_filter(spark, d):
    same = lambda c, v: F.lower(F.trim(c)) == v.strip().lower()
    return records(spark, d).where(same("district", " Nation_3 ") & same("doc_type", "SALE DEED")).select("id", "district")


@query(f"SELECT DISTINCT district AS option FROM ({_REC}) WHERE trim(district) <> ''")
def filter_options(spark, d):
    return records(spark, d).select(F.trim("district").alias("option")).where("option <> ''").distinct()


@query(f"""
SELECT count(*) FILTER (doc_type = 'Sale Deed') AS sale, count(*) FILTER (doc_type IN ('GPA Agreement', 'Power of Attorney cum sale deed', 'Agreement of Sale')) AS gpa,
  count(*) FILTER (doc_type = 'Gift Deed') AS other FROM ({_REC})""")
def deed_counters(spark, d):
    kind = F.lower("doc_type")
    power = kind.contains("gpa") | kind.contains("power")
    sale = kind.contains("sale deed") & ~power
    gpa = ~sale & (power | kind.contains("agreement"))
    return records(spark, d).agg(F.count_if(sale).alias("sale"), F.count_if(gpa).alias("gpa"), F.count_if(~sale & ~gpa).alias("other"))


@query(f"""
WITH j AS (SELECT state, district, count(*) AS n FROM (SELECT CASE WHEN id % 6 = 0 THEN 'Unclassified' ELSE state END AS state, CASE WHEN id % 6 = 0 THEN 'Unclassified' ELSE district END AS district FROM ({_REC})) GROUP BY ALL)
SELECT state, district, n, row_number() OVER (ORDER BY (state = 'Unclassified'), lower(state), (district = 'Unclassified'), -n, lower(district)) AS place FROM j""")
def jurisdiction_order(spark, d):
    """Unclassified last, then states by name and districts by size; one row a district reaches the window."""
    unknown = F.col("id") % 6 == 0
    name = lambda c: F.when(unknown, "Unclassified").otherwise(F.col(c)).alias(c)
    n = records(spark, d).select(name("state"), name("district")).groupBy("state", "district").agg(F.count("*").alias("n"))
    order = [F.col("state") == "Unclassified", F.lower("state"), F.col("district") == "Unclassified", F.desc("n"), F.lower("district")]
    return n.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(f"""
SELECT id, concat_ws(', ', 'V ' || id, district) AS place, CASE WHEN survey = '' THEN 'S' || id ELSE survey || ' / S' || id END AS survey,
  CASE WHEN id % 2 = 0 THEN '₹' || id % 500 ELSE 'none' END AS stamp, buyer || ', B (+' || (id % 3 + 1) || ')' AS parties FROM ({_REC})""")
def dashboard_rows(spark, d):
    k = F.col("id")
    name = k.cast("string")
    value = F.when(k % 2 == 0, (k % 500).cast("string")).otherwise("none")
    people = F.concat(F.array(F.col("buyer"), F.lit("B")), F.array_repeat(F.lit("C"), (k % 3 + 1).cast("int")))
    more = F.when(F.size(people) > 2, F.concat(F.lit(" (+"), (F.size(people) - 2).cast("string"), F.lit(")"))).otherwise("")
    return records(spark, d).select(
        "id", F.concat_ws(", ", F.concat(F.lit("V "), name), "district").alias("place"), F.concat_ws(" / ", F.nullif("survey", F.lit("")), F.concat(F.lit("S"), name)).alias("survey"),
        F.when(value.rlike("^[0-9]"), F.concat(F.lit("₹"), value)).otherwise(value).alias("stamp"), F.concat(F.array_join(F.slice(people, 1, 2), ", "), more).alias("parties"),
    )


@query(f"""
SELECT id, CASE status WHEN 'APPROVED' THEN 'done done done done' WHEN 'REJECTED' THEN 'done done stopped open' WHEN 'READY_FOR_APPROVAL' THEN 'done done active open' WHEN 'NEEDS_REVIEW' THEN 'done active open open' ELSE 'done stopped open open' END AS steps,
  district IS NOT NULL AND id % 7 <> 0 AS on_map, status = 'APPROVED' AS approved, status = 'REJECTED' AS rejected, status = 'DUPLICATE' AS duplicate, {_SUBMITTED} AS submitted,
  CASE WHEN status = 'APPROVED' THEN 'sealed' WHEN status = 'REJECTED' THEN 'rejected' WHEN status = 'DUPLICATE' THEN 'duplicate' WHEN status = 'FAIL' THEN 'critical check failed' WHEN {_SUBMITTED} THEN 'sent' ELSE 'open' END AS lock FROM ({_REC})""")
def record_states(spark, d):
    k, s = F.col("id"), F.col("status")
    steps = F.when(s == "APPROVED", "done done done done").when(s == "REJECTED", "done done stopped open").when(s == "READY_FOR_APPROVAL", "done done active open")
    steps = steps.when(s == "NEEDS_REVIEW", "done active open open").otherwise("done stopped open open")
    places = F.array(F.lit(None).cast("string"), F.when(k % 7 != 0, F.col("district")), F.lit(" "))
    on_map = F.coalesce(F.exists(F.transform(places, lambda x: F.coalesce(x, F.lit(""))), lambda x: F.trim(x) != ""), F.lit(False))
    lock = F.when(s == "APPROVED", "sealed").when(s == "REJECTED", "rejected").when(s == "DUPLICATE", "duplicate").when(s == "FAIL", "critical check failed").when(submitted(), "sent").otherwise("open")
    return records(spark, d).select("id", steps.alias("steps"), on_map.alias("on_map"), (s == "APPROVED").alias("approved"), (s == "REJECTED").alias("rejected"), (s == "DUPLICATE").alias("duplicate"), submitted().alias("submitted"), lock.alias("lock"))


@query(f"""
SELECT id, coalesce(c_name, 'unknown') AS uploader, left('REC-' || id || '-' || buyer, 8) || '...' || right('REC-' || id || '-' || buyer, 4) AS reference,
  CASE WHEN id % 3 = 0 THEN buyer WHEN id % 3 = 1 THEN 'owner of ' || id ELSE 'the owner' END AS recipient FROM ({_REC}) r LEFT JOIN customer ON c_custkey = r.owner AND c_acctbal > 0""")
def uploader_names(spark, d):
    from ..functions import text

    k = F.col("id")
    users = t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    joined = records(spark, d).join(users, F.col("owner") == F.col("c_custkey"), "left")
    reference = text.shortened(F.concat(F.lit("REC-"), k.cast("string"), F.lit("-"), F.col("buyer")), 8, 4)
    recipient = text.first_present(F.when(k % 3 == 0, F.col("buyer")).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("owner of "), k.cast("string"))), F.lit("the owner"))
    return joined.select("id", F.coalesce("c_name", F.lit("unknown")).alias("uploader"), reference.alias("reference"), recipient.alias("recipient"))


@query(f"""
SELECT id, CASE status WHEN 'FAIL' THEN 'FAIL' ELSE 'PASS' END || ' ' || CASE WHEN id % 3 = 0 THEN 'WARNING' ELSE 'PASS' END AS checks,
  (status <> 'FAIL')::INT + (id % 3 <> 0)::INT AS passed, (id % 3 = 0)::INT AS warned, (status = 'FAIL')::INT AS failed FROM ({_REC})""")
def check_counts(spark, d):
    both = F.array(F.when(F.col("status") == "FAIL", "FAIL").otherwise("PASS"), F.when(F.col("id") % 3 == 0, "WARNING").otherwise("PASS"))
    n = lambda s: F.size(F.filter(both, lambda x: x == s))
    return records(spark, d).select("id", F.array_join(both, " ").alias("checks"), n("PASS").alias("passed"), n("WARNING").alias("warned"), n("FAIL").alias("failed"))


@query("""
WITH f AS (SELECT l_orderkey, CASE WHEN l_tax > 0 THEN l_tax * 12 WHEN l_discount > 0 THEN l_discount * 9 ELSE 0.5 END AS c FROM lineitem),
m AS (SELECT l_orderkey, avg(least(c, 1.0)) AS mean FROM f GROUP BY l_orderkey)
SELECT round((SELECT avg(least(c, 1.0)) FROM f), 6)::DOUBLE AS overall, round((SELECT avg(mean) FROM m), 6)::DOUBLE AS document_mean, (SELECT count(*) FROM m WHERE mean < 0.85) AS reviews""")
def overall_confidence(spark, d):
    c = confidence.best_known(F.col("l_tax") * 12, F.col("l_discount") * 9, F.lit(0.5))
    items = t(spark, d, "lineitem").select("l_orderkey", c.alias("c"))
    overall = items.agg(F.coalesce(F.round(F.avg("c"), 6), F.lit(0.0)).alias("overall"))
    means = items.groupBy("l_orderkey").agg(F.avg("c").alias("mean"))
    docs = means.agg(F.round(F.avg("mean"), 6).alias("document_mean"), F.count_if(F.col("mean") < 0.85).alias("reviews"))
    return overall.crossJoin(docs)  # one row each


@query("""
SELECT l_partkey % 40 AS field, round(avg(1 - l_discount), 6)::DOUBLE AS mean FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 8""")
def weakest_fields(spark, d):
    """The eight fields of least mean confidence."""
    n = t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("field")).agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("mean"))
    return n.orderBy("mean", "field").limit(8)


@query("""
SELECT o_custkey AS doc, count(*) AS fields, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 1)::DOUBLE AS matched,
  string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderstatus = 'O') AS missing, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey""")
def document_summary(spark, d):
    listed = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_set(c)), ","), F.lit(""))
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(
        F.count("*").alias("fields"), F.round(F.count_if(s == "F") * 100 / F.count("*"), 1).alias("matched"),
        listed(F.when(s == "O", F.col("o_orderpriority"))).alias("missing"), listed(s).alias("states"),
    )


@query("""
SELECT l_orderkey AS page, count(*) AS lines, sum(length(l_returnflag || l_shipdate::DATE::VARCHAR))::BIGINT AS chars, round(avg(100 - round(l_discount * 100)::INT) / 100, 4)::DOUBLE AS mean FROM lineitem GROUP BY l_orderkey""")
def page_metrics(spark, d):
    said = F.concat("l_returnflag", F.to_date("l_shipdate").cast("string"))
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(
        F.count("*").alias("lines"), F.sum(F.length(said)).alias("chars"), F.coalesce(F.round(F.avg(100 - F.round(F.col("l_discount") * 100).cast("int")) / 100, 4), F.lit(0.0)).alias("mean")
    )


@query("""
SELECT user_id AS page, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id, count(*) AS runs FROM events GROUP BY user_id""")
def latest_telemetry(spark, d):
    latest = F.max(F.struct("ts", "event_id")).alias("m")
    return t(spark, d, "events").groupBy(F.col("user_id").alias("page")).agg(latest, F.count("*").alias("runs")).select("page", "m.event_id", "runs")


@query("""
SELECT user_id, count(*) FILTER (next < ts + INTERVAL 10 MINUTE) AS overlaps FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) GROUP BY user_id""")
def request_overlaps(spark, d):
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t(spark, d, "events").select("user_id", "ts", following.alias("next"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("next") < F.col("ts") + F.expr("interval 10 minutes")).alias("overlaps"))


@query(f"""
SELECT id, CASE WHEN submitted IS NULL THEN CASE WHEN status = 'APPROVED' THEN 0.934 ELSE 0.72 END ELSE 0.5 END::DOUBLE AS score FROM (
  SELECT id, status, submitted FROM ({_REC}) WHERE status IN ('APPROVED', 'NEEDS_REVIEW'))""")
def document_scores(spark, d):
    heuristic = confidence.document_heuristic(F.col("status"), F.when(F.col("status") == "APPROVED", 0.48).otherwise(0.0), F.when(F.col("status") == "APPROVED", 0.6).otherwise(0.2222))
    rows = records(spark, d).where(F.col("status").isin("APPROVED", "NEEDS_REVIEW"))
    return rows.select("id", F.coalesce(F.when(F.col("submitted").isNotNull(), 0.5), heuristic).alias("score"))
