"""Registered queries of accounts, sessions, stores and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounts, learning, store
from .registry import query, t

_USERS = """
  SELECT CASE WHEN c_custkey = 1 THEN 'admin' ELSE 'u' || c_custkey END AS user_id, ['user', 'officer', 'clerk', 'admin'][c_custkey % 4 + 1] AS role, c_custkey AS created_at,
    'mail:c' || c_custkey || '@x' AS identity FROM customer"""


def _users(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    name = k.cast("string")
    return t(spark, d, "customer").select(
        F.when(k == 1, "admin").otherwise(F.concat(F.lit("u"), name)).alias("user_id"),
        F.element_at(F.array(*map(F.lit, accounts.ROLES)), (k % 4 + 1).cast("int")).alias("role"), k.alias("created_at"),
        F.array(F.struct(F.lit("mail").alias("type"), F.concat(F.lit("c"), name, F.lit("@x")).alias("identifier"))).alias("identities"),
    )


@query(f"SELECT user_id, role, created_at FROM ({_USERS}) WHERE user_id = 'u42'")
def user_lookup(spark, d):
    return accounts.point(_users(spark, d), "user_id", "u42").drop("identities")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def record_lookup(spark, d):
    return accounts.point(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 7)


@query(f"""
SELECT user_id, CASE WHEN created_at % 3 = 0 THEN 'clerk' ELSE role END AS role, created_at FROM ({_USERS})
UNION ALL SELECT 'new' || created_at, 'officer', created_at + 5 FROM ({_USERS}) WHERE created_at % 10 = 0""")
def user_upsert(spark, d):
    users = _users(spark, d).drop("identities")
    changed = users.where("created_at % 3 = 0").select("user_id", F.lit(" CLERK").alias("role"), (F.col("created_at") + 99).alias("created_at"))
    new = users.where("created_at % 10 = 0").select(F.concat(F.lit("new"), F.col("created_at").cast("string")).alias("user_id"), F.lit("officer").alias("role"), (F.col("created_at") + 5).alias("created_at"))
    return accounts.upsert_users(users, changed.unionByName(new))


@query(f"""
SELECT user_id, CASE WHEN created_at % 7 = 0 THEN 'delete' ELSE 'update' END AS action FROM ({_USERS}) WHERE (created_at % 7 = 0 OR created_at % 5 = 0) AND user_id <> 'admin'""")
def user_reconcile(spark, d):
    users = _users(spark, d).drop("identities")
    later = users.where("created_at % 7 <> 0 and user_id <> 'admin'").withColumn("role", F.when(F.col("created_at") % 5 == 0, "x").otherwise(F.col("role")))
    return accounts.reconcile_users(users, later, ["user_id", "role", "created_at"])


@query(f"""
SELECT user_id, CASE created_at % 3 WHEN 0 THEN identity ELSE identity || ' phone:9' || created_at END AS identities FROM ({_USERS})""")
def identity_links(spark, d):
    k = F.col("created_at")
    kind = F.when(k % 3 == 0, "MAIL").otherwise("Phone")
    name = F.when(k % 3 == 0, F.concat(F.lit("C"), k.cast("string"), F.lit("@X"))).otherwise(F.concat(F.lit("9"), k.cast("string"), F.lit(" ")))
    found = accounts.linked(F.col("identities"), kind, name)
    return _users(spark, d).select("user_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["type"], x["identifier"])), " ").alias("identities"))


@query(f"""
SELECT created_at AS ask, CASE WHEN created_at % 2 = 0 THEN 'k' || created_at WHEN created_at % 3 = 0 THEN user_id END AS user_id FROM ({_USERS})""")
def identity_owner(spark, d):
    users, k = _users(spark, d), F.col("created_at")
    name = F.concat(F.lit("C"), k.cast("string"), F.when(k % 3 == 0, "@X ").otherwise("@y"))
    asked = users.select(k.alias("ask"), F.lit("Mail").alias("type"), name.alias("identifier"))
    credentials = users.where("created_at % 2 = 0").select(F.concat(F.lit("mail:"), F.lower(F.trim(name))).alias("credential_key"), F.concat(F.lit("k"), k.cast("string")).alias("user_id"))
    return accounts.user_of_identity(asked, credentials, users)


_SESSIONS = "SELECT event_id, user_id, ts AS opened, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts + INTERVAL 7 DAY END AS expires_at FROM events"
_NOW = "(SELECT max(ts) - INTERVAL 3 DAY FROM events)"


def _sessions(spark, d) -> tuple[DataFrame, DataFrame]:
    events = t(spark, d, "events")
    now = events.agg((F.max("ts") - F.expr("interval 3 days")).alias("now"))  # one row
    opened = accounts.opened(events.select("event_id", "user_id", F.col("ts").alias("opened")), F.col("opened"))
    ends = F.when(F.col("event_id") % 13 != 0, F.col("expires_at"))
    return opened.withColumn("expires_at", ends).crossJoin(F.broadcast(now)), now


@query(f"SELECT event_id, user_id, opened, expires_at FROM ({_SESSIONS}) WHERE {_NOW} < expires_at")
def valid_sessions(spark, d):
    return accounts.valid(_sessions(spark, d)[0], F.col("now")).select("event_id", "user_id", "opened", "expires_at")


@query(f"SELECT event_id FROM ({_SESSIONS}) WHERE NOT coalesce({_NOW} < expires_at, false)")
def evicted_sessions(spark, d):
    return accounts.evicted(_sessions(spark, d)[0], F.col("now")).select("event_id")


@query("""
WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey <> 1)
SELECT 'orders' AS kept_in, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT * FROM g)
UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM g) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT * FROM g)""")
def account_delete(spark, d):
    name = lambda c: F.when(F.col(c) == 1, "admin").otherwise(F.col(c).cast("string"))
    tables = {"orders": ("orders", "o_custkey"), "customers": ("customer", "c_custkey"), "events": ("events", "user_id")}
    named = {k: (t(spark, d, table).select(name(c).alias("owner")), "owner") for k, (table, c) in tables.items()}
    gone = t(spark, d, "customer").where("c_acctbal < 0").select(name("c_custkey").alias("user_id"))
    left = accounts.without_accounts(named, gone)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kept_in"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey FROM orders WHERE o_custkey <> 7")
def owner_reset(spark, d):
    return accounts.reset_owner(t(spark, d, "orders"), "o_custkey", F.lit(7)).select("o_orderkey")


@query(f"SELECT role, count(*) AS users FROM ({_USERS}) GROUP BY role")
def role_counts(spark, d):
    return _users(spark, d).groupBy("role").agg(F.count("*").alias("users"))


_FEEDBACK = """
  SELECT event_id, user_id % 200 AS record, event_type AS field, 'EN' AS language, 'r' || (user_id % 9) AS raw,
    CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'r' || (user_id % 9) || ' ' ELSE 'c' || (event_id % 7) END AS corrected,
    CASE event_id % 3 WHEN 0 THEN 'verified' ELSE 'pending_approval' END AS status, ts FROM events"""


def _feedback(spark, d) -> DataFrame:
    k, raw = F.col("event_id"), F.concat(F.lit("r"), (F.col("user_id") % 9).cast("string"))
    return t(spark, d, "events").select(
        "event_id", (F.col("user_id") % 200).alias("record"), F.col("event_type").alias("field"), F.lit("EN").alias("language"), raw.alias("raw"),
        F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(raw, F.lit(" "))).otherwise(F.concat(F.lit("c"), (k % 7).cast("string"))).alias("corrected"),
        F.when(k % 3 == 0, "verified").otherwise("pending_approval").alias("status"), "ts",
    )


@query(f"""
WITH f AS ({_FEEDBACK})
SELECT event_id, record, field, corrected, status FROM f WHERE status = 'verified' UNION ALL
SELECT event_id, record, field, corrected, status FROM (SELECT * FROM f WHERE status <> 'verified' AND trim(corrected) <> '' AND trim(corrected) <> trim(raw)
  QUALIFY row_number() OVER (PARTITION BY record, field ORDER BY ts DESC, event_id DESC) = 1)""")
def stage_feedback(spark, d):
    return learning.stage(_feedback(spark, d), ["record", "field"], "ts", "event_id").select("event_id", "record", "field", "corrected", "status")


@query(f"""
WITH f AS ({_FEEDBACK})
SELECT CASE WHEN status = 'pending_approval' AND record % 4 = 0 THEN 'verified' WHEN status = 'pending_approval' AND record % 4 = 1 THEN 'rejected' ELSE status END AS status,
  count(*) AS n, count(*) FILTER (status = 'pending_approval' AND record % 4 < 2) AS settled FROM f GROUP BY 1""")
def settle_feedback(spark, d):
    feedback = _feedback(spark, d)
    decisions = feedback.where("record % 4 < 2").select("record", (F.col("record") % 4 == 0).alias("approved")).distinct()
    settled = learning.settle(feedback, decisions, "record")
    return settled.groupBy("status").agg(F.count("*").alias("n"), F.count_if("settled").alias("settled"))


@query(f"""
WITH f AS ({_FEEDBACK}), r AS (SELECT field, raw, trim(corrected) FROM f WHERE status = 'verified' AND trim(corrected) <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT count(*) AS feedback, count(*) FILTER (status = 'pending_approval') AS pending, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected,
  string_agg(DISTINCT field, ',' ORDER BY field) AS fields, 'en' AS languages, (SELECT count(*) FROM r) AS rules FROM f""")
def learning_stats(spark, d):
    feedback = _feedback(spark, d)
    rules = learning.induce_rules(feedback.withColumn("doc_type", F.lit("Sale Deed")))
    return learning.learning_stats(feedback, rules)


@query(f"""
WITH f AS ({_FEEDBACK}) SELECT o_orderkey, count(event_id) AS feedback, count(*) FILTER (f.status = 'verified') AS verified FROM orders LEFT JOIN f ON o_orderkey = record GROUP BY o_orderkey""")
def record_feedback(spark, d):
    n = _feedback(spark, d).groupBy("record").agg(F.count("*").alias("feedback"), F.count_if(F.col("status") == "verified").alias("verified"))
    joined = t(spark, d, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("record"), "left")
    return joined.select("o_orderkey", F.coalesce("feedback", F.lit(0)).alias("feedback"), F.coalesce("verified", F.lit(0)).alias("verified"))


@query("""
SELECT coalesce(a.o_orderkey, b.k) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'delete' WHEN b.k IS NULL THEN 'insert' ELSE 'update' END AS action
FROM orders a FULL JOIN (SELECT o_orderkey + 2 AS k FROM orders) b ON a.o_orderkey = b.k""")
def baseline_restore(spark, d):
    backup = t(spark, d, "orders").select("o_orderkey")
    return store.restore(backup, backup.select((F.col("o_orderkey") + 2).alias("o_orderkey")), "o_orderkey")


@query("""
SELECT o_orderkey, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey + 2 FROM orders) UNION ALL
SELECT o_orderkey + 2, 'right' FROM orders WHERE o_orderkey + 2 NOT IN (SELECT o_orderkey FROM orders)""")
def restore_check(spark, d):
    backup = t(spark, d, "orders").select("o_orderkey")
    return store.id_differences(backup, backup.select((F.col("o_orderkey") + 2).alias("o_orderkey")), "o_orderkey")


@query("""
SELECT count(*) FILTER (o_orderkey % 3 = 0) AS inserted, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderstatus <> 'X') AS updated, count(*) FILTER (o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderstatus = 'X')) AS skipped FROM orders""")
def migration_counts(spark, d):
    source = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    target = source.where("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 1, "X").otherwise(F.col("o_orderstatus")))
    return store.migrated(source, target, "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("""
SELECT event_id, '{"a":' || coalesce(trunc(value)::INT::VARCHAR, 'null') || ',"b":{"x":"' || event_type || '","y":null}}' AS canonical FROM events""")
def canonical_payloads(spark, d):
    raw = F.concat(F.lit('{"b": {"y": null, "x": "'), "event_type", F.lit('"}, "a": '), F.coalesce(F.col("value").cast("int").cast("string"), F.lit("null")), F.lit("}"))
    return t(spark, d, "events").select("event_id", store.canonical_json(raw).alias("canonical"))
