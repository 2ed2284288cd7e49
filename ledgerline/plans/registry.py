"""Registered queries: each registry operator over the driver's tables, with
the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import script, text
from ..operators import analytics, audit, checks, duplicates, gis, learning, store
from ..sources import versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statuses(orders: DataFrame) -> DataFrame:
    """Order status as record status."""
    s = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("NEEDS_REVIEW")
    return orders.withColumn("status", s)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END"


@query("""
SELECT coalesce(r_name, NULL) AS state, n_name AS district, grouping_id(r_name, n_name)::BIGINT AS level, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'F') AS sealed, count(*) FILTER (o_orderstatus = 'P') AS flagged,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def jurisdiction_progress(spark, d):
    places = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return analytics.jurisdiction_progress(rows, "r_name", "n_name", "o_orderstatus", ["F"], ["P"])


@query(f"""
SELECT count(*) AS on_file, count(*) FILTER (s = 'APPROVED') AS sealed, count(*) FILTER (s = 'NEEDS_REVIEW') AS desk,
  count(*) FILTER (s = 'REJECTED') AS rejected,
  round_even(count(*) FILTER (s = 'APPROVED') * 100.0::DOUBLE / count(*), 0)::INT || '%' AS seal_rate,
  round_even(count(*) FILTER (o_totalprice > 100000) * 100.0::DOUBLE / count(*), 0)::INT || '%' AS gis_rate
FROM (SELECT *, {_STATUS} AS s FROM orders)""")
def registry_kpis(spark, d):
    return analytics.registry_kpis(_statuses(t(spark, d, "orders")), "status", F.col("o_totalprice") > 100000)


@query("""
SELECT field, avg(least(confidence, 1.0)) AS mean_confidence, count(*) AS n, avg(least(confidence, 1.0)) < 0.85 AS needs_review
FROM (SELECT 'discount' AS field, 1 - l_discount AS confidence FROM lineitem UNION ALL SELECT 'tax', 1 - l_tax * 4 FROM lineitem)
GROUP BY field""")
def field_confidence(spark, d):
    items = t(spark, d, "lineitem").select((1 - F.col("l_discount")).alias("discount"), (1 - F.col("l_tax") * 4).alias("tax"))
    return analytics.field_confidence(items.unpivot([], ["discount", "tax"], "field", "confidence"))


@query("""
WITH m AS (SELECT max(ts)::DATE AS today FROM events),
b AS (SELECT CASE WHEN today < ts::DATE THEN 6 ELSE greatest(6 - date_diff('day', ts::DATE, today), 0) END AS bucket,
        count(*) AS intake, count(*) FILTER (event_type = 'purchase') AS sealed FROM events, m GROUP BY 1),
f AS (SELECT r.range AS bucket, coalesce(intake, 0) AS intake, coalesce(sealed, 0) AS sealed FROM range(7) r LEFT JOIN b ON r.range = b.bucket)
SELECT *, (sum(intake) OVER (ORDER BY bucket))::BIGINT AS intake_total, (sum(sealed) OVER (ORDER BY bucket))::BIGINT AS sealed_total FROM f""")
def velocity_7day(spark, d):
    events = t(spark, d, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("today"))  # one row
    return analytics.velocity(events.crossJoin(F.broadcast(today)), "ts", F.col("event_type") == "purchase", F.col("today"))


@query("""
SELECT o_orderkey, floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600)::BIGINT AS wait_hours,
  floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600) >= 2 AS urgent,
  CASE WHEN floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600) >= 24
       THEN floor(floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600) / 24)::BIGINT || 'd'
       ELSE floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600)::BIGINT || 'h' END AS wait_text
FROM orders WHERE o_orderstatus = 'O'""")
def queue_wait(spark, d):
    rows = t(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    return analytics.queue_wait(rows, "o_orderdate", F.to_timestamp(F.lit("2000-01-01 00:00:00"))).drop("o_orderdate")


@query("""
SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'decided' WHEN o_orderpriority LIKE '1%' THEN 'sent'
            WHEN o_totalprice > 100000 THEN 'needs_review' ELSE 'legacy' END AS bucket, count(*) AS n, min(o_orderkey) AS first_key
FROM orders GROUP BY 1""")
def workspace_buckets(spark, d):
    bucket = F.when(F.col("o_orderstatus").isin("F", "P"), "decided").when(F.col("o_orderpriority").startswith("1"), "sent").when(F.col("o_totalprice") > 100000, "needs_review").otherwise("legacy")
    return t(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND contains(lower(concat_ws(' ', o_orderkey, o_orderpriority)), 'urgent')""")
def ledger_search(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return rows.where("o_orderstatus = 'O'").where(F.lower(F.concat_ws(" ", "o_orderkey", "o_orderpriority")).contains("urgent")).drop("o_orderstatus")


@query("""
SELECT c_custkey, c_mktsegment, count(o_orderkey) AS documents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def uploader_counts(spark, d):
    per = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # aggregated before the join
    joined = t(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("documents"))


_REGISTER = """
  SELECT doc_id AS id, sha256(text) AS file_hash,
    CASE WHEN length(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g') || n_chars) >= 3 THEN lower(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g')) || n_chars END AS doc_no,
    CASE WHEN length(bare) >= 4 AND bare NOT IN ('none', 'null', 'unknown', 'notfound', 'unnumbered') THEN sha256(bare) END AS stamp_no,
    lang AS village, source AS survey
  FROM (SELECT *, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS bare FROM documents)"""


def _matches(approved: str) -> str:
    return f"""
WITH d AS ({_REGISTER}), r AS (SELECT * FROM d{approved}),
p AS (
  SELECT a.id, b.id AS match_id, 'file' AS reason FROM d a JOIN r b ON a.id <> b.id AND a.file_hash = b.file_hash
  UNION ALL SELECT a.id, b.id, 'document' FROM d a JOIN r b ON a.id <> b.id AND a.doc_no = b.doc_no
    WHERE a.file_hash IS DISTINCT FROM b.file_hash AND (a.village = b.village OR a.survey = b.survey OR length(a.doc_no) >= 4)
  UNION ALL SELECT a.id, b.id, 'stamp' FROM d a JOIN r b ON a.id <> b.id AND a.stamp_no = b.stamp_no
    WHERE a.file_hash IS DISTINCT FROM b.file_hash AND a.doc_no IS DISTINCT FROM b.doc_no)
SELECT id, min(match_id) AS match_id, arg_min(reason, match_id) AS reason FROM p GROUP BY id"""


def _register(spark, d) -> DataFrame:
    """Keys of every document; the stamp key is a hash of all letters and digits of the text."""
    bare = F.lower(F.regexp_replace("text", "[^a-zA-Z0-9]+", ""))
    docs = t(spark, d, "documents").withColumn("bare", bare).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("created"), F.sha2("text", 256).alias("file_hash"),
        text.identifier(F.concat("source", F.col("n_chars").cast("string")), 3).alias("doc_no"),
        F.when(~F.col("bare").isin(*text.ID_SENTINELS) & (F.length("bare") >= 4), F.sha2("bare", 256)).alias("stamp_no"),
        F.col("lang").alias("village"), F.col("source").alias("survey"),
    )
    return versions.written(docs, "register")  # the joins read the keys several times, the texts once


@query(_matches(" WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def duplicate_documents(spark, d):
    """Every document against the approved ones, which are those labelled good."""
    docs = _register(spark, d)
    approved = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return duplicates.duplicate_of(docs, docs.join(approved, "id", "left_semi"))


@query(_matches(""))
def duplicate_register(spark, d):
    """Every document against all others."""
    docs = _register(spark, d)
    return duplicates.duplicate_of(docs, docs)


@query("""
SELECT event_id, sha256('{"event_id":"' || event_id || '","event_type":' || coalesce('"' || event_type || '"', 'null') || ',"user_id":' || coalesce('"' || user_id || '"', 'null') || '}') AS fingerprint FROM events""")
def record_fingerprint(spark, d):
    events = t(spark, d, "events")
    return events.select("event_id", store.fingerprint(events, ["event_id", "user_id", "event_type"]).alias("fingerprint"))


def _altered(orders: DataFrame) -> DataFrame:
    """A later state: some keys gone, some rows changed, some new keys."""
    kept = orders.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return kept.unionByName(orders.where("o_orderkey % 11 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


_ALTERED = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0"""


@query(f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS action
FROM orders a FULL JOIN ({_ALTERED}) b USING (o_orderkey)
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def snapshot_reconcile(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return store.reconcile(orders, _altered(orders), "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(f"""
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
  coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority
FROM orders a FULL JOIN ({_ALTERED}) b ON a.o_orderkey = b.o_orderkey""")
def upsert_preserve(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return store.upsert(orders, _altered(orders), "o_orderkey", keep_old=("o_orderpriority",))


def _feedback(spark, d) -> DataFrame:
    k = F.col("event_id")
    return t(spark, d, "events").select(
        F.col("event_type").alias("field"), F.lit("Sale Deed").alias("doc_type"), F.lit("EN").alias("language"),
        (F.col("user_id") % 50).cast("string").alias("raw"), (F.col("user_id") % 3).cast("string").alias("corrected"),
        F.when(k % 4 == 0, "pending_approval").otherwise("verified").alias("status"), k.alias("ts"),
    )


_RULES = """
SELECT event_type AS field, 'Sale Deed' AS doc_type, 'en' AS language, (user_id % 50)::VARCHAR AS raw, (user_id % 3)::VARCHAR AS corrected,
  count(*) AS evidence, min(event_id) AS first_ts, max(event_id) AS created,
  CASE WHEN count(*) >= 5 THEN 0.95 WHEN count(*) = 4 THEN 0.90 WHEN count(*) = 3 THEN 0.85 ELSE 0.80 END::DOUBLE AS rule_confidence
FROM events WHERE event_id % 4 <> 0 GROUP BY ALL HAVING count(*) >= 2"""


@query(_RULES)
def learn_rules(spark, d):
    return learning.induce_rules(_feedback(spark, d))


@query(f"""
WITH r AS (SELECT * FROM ({_RULES}) QUALIFY row_number() OVER (PARTITION BY field, raw ORDER BY first_ts, corrected) = 1),
v AS (SELECT event_id AS id, event_type AS field, CASE event_id % 5 WHEN 0 THEN ' SALE DEED' WHEN 1 THEN 'unknown' WHEN 2 THEN '' ELSE 'sale deed' END AS doc_type,
  CASE event_id % 3 WHEN 0 THEN 'En' ELSE 'en' END AS language, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (user_id % 60)::VARCHAR END AS raw, 0.5::DOUBLE AS ocr FROM events)
SELECT v.*, coalesce(r.corrected, v.raw) AS value,
  CASE WHEN v.raw IS NULL THEN 0 WHEN r.corrected IS NULL THEN 0.5 ELSE least(0.95, greatest(0.5, rule_confidence)) END::DOUBLE AS final,
  CASE WHEN r.corrected IS NULL THEN 'raw_ocr' ELSE 'learned_correction' END AS kind
FROM v LEFT JOIN r ON r.field = v.field AND r.raw = v.raw AND v.id % 5 NOT IN (1, 2)""")
def apply_rules(spark, d):
    k = F.col("event_id")
    values = t(spark, d, "events").select(
        k.alias("id"), F.col("event_type").alias("field"),
        F.when(k % 5 == 0, " SALE DEED").when(k % 5 == 1, "unknown").when(k % 5 == 2, "").otherwise("sale deed").alias("doc_type"),
        F.when(k % 3 == 0, "En").otherwise("en").alias("language"),
        F.when(k % 11 != 0, (F.col("user_id") % 60).cast("string")).alias("raw"), F.lit(0.5).alias("ocr"),
    )
    return learning.apply_rules(values, learning.induce_rules(_feedback(spark, d)))


@query("""
SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def stage_feedback_latest(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return learning.latest_pending(rows, ["user_id", "event_type"], "ts", "event_id")


@query("""
SELECT doc_id, CASE WHEN greatest(te, de, ka, ta, ar, la) = 0 THEN 'Unknown' WHEN te = greatest(te, de, ka, ta, ar, la) THEN 'Telugu'
  WHEN de = greatest(te, de, ka, ta, ar, la) THEN 'Devanagari' WHEN ka = greatest(te, de, ka, ta, ar, la) THEN 'Kannada'
  WHEN ta = greatest(te, de, ka, ta, ar, la) THEN 'Tamil' WHEN ar = greatest(te, de, ka, ta, ar, la) THEN 'Arabic' ELSE 'Latin' END AS script, la AS latin
FROM (SELECT doc_id, len(regexp_extract_all(text, '[ఀ-౿]')) AS te, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS de, len(regexp_extract_all(text, '[ಀ-೿]')) AS ka,
  len(regexp_extract_all(text, '[஀-௿]')) AS ta, len(regexp_extract_all(text, '[؀-ۿ]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM documents)""")
def script_profile(spark, d):
    rows = t(spark, d, "documents").select("doc_id", script.script_counts(F.col("text")).alias("counts"))
    return rows.select("doc_id", script.largest_script(F.col("counts")).alias("script"), F.col("counts")[5].cast("long").alias("latin"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM documents""")
def normalise_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.comparable(F.col("text")).alias("normal"))


@query(r"""
SELECT doc_id, field, value FROM (
  SELECT doc_id, 'number' AS field, unnest(regexp_extract_all(text, '\d{3,}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'hex', unnest(regexp_extract_all(text, '[0-9a-f]{16,}')) FROM documents)""")
def regex_candidates(spark, d):
    return _candidates(t(spark, d, "documents")).select("doc_id", "field", "value")


def _candidates(docs: DataFrame) -> DataFrame:
    found = F.array(*[F.struct(F.lit(name).alias("field"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("v")) for name, p in (("number", r"\d{3,}"), ("hex", "[0-9a-f]{16,}"))])
    each = docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.field", F.posexplode("f.v").alias("ordinal", "value"))
    return each


@query(r"""
WITH c AS (SELECT doc_id, v AS value, i AS ordinal FROM (SELECT doc_id, regexp_extract_all(text, '\d{3,}') AS a FROM documents), unnest(a) WITH ORDINALITY AS u(v, i))
SELECT doc_id AS doc, 'number' AS field, value, (least(length(value), 9))::BIGINT AS score FROM c
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY least(length(value), 9) DESC, ordinal) = 1""")
def resolve_best(spark, d):
    c = _candidates(t(spark, d, "documents")).where("field = 'number'")
    c = c.select(F.col("doc_id").alias("doc"), "field", "value", F.least(F.length("value"), F.lit(9)).cast("long").alias("score"), F.lit(1).alias("page"), "ordinal")
    return duplicates.ranked_best(c).drop("page", "ordinal")


@query("""
SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context,
  lead(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations""")
def line_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = F.array_join(F.collect_list("text").over(w.rowsBetween(-2, 2)), " ")
    return t(spark, d, "conversations").select("conv_id", "turn", around.alias("context"), F.lead("text", 1).over(w).alias("next_text"))


@query("""
WITH s AS (SELECT doc_id AS doc, 'lang' AS field, lang AS value FROM documents), n AS (SELECT doc_id AS doc, 'lang' AS field, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS value FROM labels),
a AS (SELECT doc, CASE WHEN n.value IS NULL AND s.value IS NULL THEN 'B' WHEN s.value IS NULL THEN 'S' WHEN n.value IS NULL THEN 'N' WHEN contains(s.value, n.value) OR contains(n.value, s.value) THEN 'A' ELSE 'D' END AS st
  FROM s FULL JOIN n USING (doc, field))
SELECT doc, count(*) FILTER (st = 'A') AS agree, count(*) FILTER (st = 'D') AS conflict, count(*) FILTER (st = 'S') AS semantic_missing, count(*) FILTER (st = 'N') AS neural_missing,
  round(CASE WHEN count(*) FILTER (st IN ('A', 'D')) = 0 THEN 1.0 ELSE count(*) FILTER (st = 'A') / count(*) FILTER (st IN ('A', 'D')) END, 3)::DOUBLE AS ratio FROM a GROUP BY doc""")
def cross_audit(spark, d):
    semantic = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("lang").alias("field"), F.col("lang").alias("value"))
    neural = t(spark, d, "labels").select(F.col("doc_id").alias("doc"), F.lit("lang").alias("field"), F.when(F.col("quality") == 1, "en").otherwise("fr").alias("value"))
    return audit.audit_summary(audit.audit_fields(semantic, neural))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'DUPLICATE' WHEN o_totalprice <= 1000 OR o_orderpriority IS NULL THEN 'FAIL'
  WHEN o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '1993-01-01' THEN 'NEEDS_REVIEW' ELSE 'READY_FOR_APPROVAL' END AS status,
  ((o_totalprice > 1000)::INT + (o_orderpriority IS NOT NULL)::INT + (o_orderdate >= TIMESTAMP '1993-01-01')::INT + (o_orderstatus <> 'P')::INT)::BIGINT AS passed
FROM orders""")
def check_status(spark, d):
    all_checks = F.array(
        checks.critical("area_validation", F.col("o_totalprice") > 1000), checks.critical("required_fields", F.col("o_orderpriority").isNotNull()),
        checks.advisory("date_validation", F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp")), checks.advisory("signature_detection", F.col("o_orderstatus") != "P"),
    )
    rows = t(spark, d, "orders").withColumn("checks", all_checks)
    return rows.select("o_orderkey", checks.overall_status(F.col("checks"), F.col("o_orderkey") % 97 == 0).alias("status"), checks.pass_count(F.col("checks")).cast("long").alias("passed"))


@query("SELECT doc_id, (coalesce(trim(lang), '') <> '' AND lang <> 'es') OR n_chars > 2000 AS is_document FROM documents")
def land_filter(spark, d):
    fields = {"lang": F.coalesce(F.trim("lang"), F.lit("")) .isin("en", "fr", "de"), "size": F.col("n_chars") > 2000, "parties": F.lit(True)}
    return t(spark, d, "documents").select("doc_id", checks.is_land_document(fields, ["lang", "size"]).alias("is_document"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS lng, round(avg(embedding[2]::DOUBLE), 6) AS lat, count(*) AS vertices FROM embeddings GROUP BY label")
def centroid(spark, d):
    v = t(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("lng"), F.col("embedding")[1].cast("double").alias("lat"))
    return gis.vertex_centroid(v, "label").withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query("""
SELECT conv_id, count(*) AS pages, count(*) - count(DISTINCT turn) AS duplicated, (max(turn) + 1 - count(DISTINCT turn))::BIGINT AS missing
FROM conversations GROUP BY conv_id""")
def page_completeness(spark, d):
    pages = t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.collect_set("turn").alias("seen"))
    missing = F.size(F.array_except(F.sequence(F.lit(0).cast("long"), F.array_max("seen")), "seen")).cast("long")
    return pages.select("conv_id", "pages", (F.col("pages") - F.size("seen")).alias("duplicated"), missing.alias("missing"))


@query(f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderstatus AS baseline, b.o_orderstatus AS enhanced, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS is_changed
FROM orders a FULL JOIN ({_ALTERED}) b ON a.o_orderkey = b.o_orderkey""")
def baseline_vs_enhanced(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    a, b = orders.withColumnRenamed("o_orderstatus", "baseline"), _altered(orders).withColumnRenamed("o_orderstatus", "enhanced")
    return a.join(b, "o_orderkey", "full_outer").withColumn("is_changed", ~F.col("baseline").eqNullSafe(F.col("enhanced")))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    large = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").where("p_size % 2 = 0").select("p_partkey").subtract(large)
