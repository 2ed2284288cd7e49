"""Registered queries of place resolution and of datasets of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import gis
from .registry import query, t

# Villages are suppliers, mandals and districts nations, states regions; a third
# of the states have no feature of their own. Queries are customers, whose place
# names are written in various ways.
_VILLAGES = """
  SELECT lower(r_name) AS state, lower(n_name) AS district, CASE WHEN s_suppkey % 3 = 0 THEN 'old ' || lower(r_name) ELSE '' END AS old_district,
    'circle ' || (s_suppkey % 4) AS mandal, 'town' || (s_suppkey % 30) || CASE WHEN s_suppkey % 7 = 0 THEN ' east' ELSE '' END AS village, s_suppkey + 10000 AS feature
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_FEATURES = """
  SELECT lower(r_name) AS state, 'state' AS level, '' AS district, '' AS mandal, r_regionkey + 5000 AS feature FROM region WHERE r_regionkey <> 2
  UNION ALL SELECT lower(r_name), 'district', lower(n_name), '', n_nationkey + 3000 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(r_name), CASE WHEN n_nationkey % 2 = 0 THEN 'mandal' ELSE 'taluk' END, lower(n_name), 'north ring ' || n_nationkey, n_nationkey + 1000
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
_ASKED = """
  SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 'atlantis' ELSE lower(r_name) END AS state,
    CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN '' ELSE left(lower(n_name), 4) END AS q_district,
    CASE c_custkey % 5 WHEN 0 THEN 'circle ' || (c_custkey % 4) WHEN 1 THEN 'ring ' || n_nationkey WHEN 2 THEN 'north ring ' || n_nationkey ELSE '' END AS q_mandal,
    CASE c_custkey % 6 WHEN 0 THEN 'town' || (c_custkey % 30) WHEN 1 THEN 'town' || (c_custkey % 30) WHEN 2 THEN 'own' || (c_custkey % 30) || ' ea' WHEN 3 THEN 'nowhere' ELSE '' END AS q_village
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _nations(spark, d) -> DataFrame:
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _villages(spark, d) -> DataFrame:
    k, mark = F.col("s_suppkey"), lambda s: F.concat(F.lit(s), (F.col("s_suppkey") % 30).cast("string"))
    return t(spark, d, "supplier").join(_nations(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lower("r_name").alias("state"), F.concat(F.lower("n_name"), F.lit(" District")).alias("district"),
        F.when(k % 3 == 0, F.concat(F.lit("Old "), "r_name")).otherwise("").alias("old_district"),
        F.concat(F.lit("Circle "), (k % 4).cast("string"), F.lit(" Taluk")).alias("mandal"),
        F.when(k % 7 == 0, F.concat(mark("Town"), F.lit("-East Village"))).otherwise(mark("Town")).alias("village"), (k + 10000).alias("feature"),
    )


def _features(spark, d) -> DataFrame:
    nations, region = _nations(spark, d), t(spark, d, "region")
    n, state = F.col("n_nationkey").cast("long"), F.lower("r_name").alias("state")
    rows = region.where("r_regionkey <> 2").select(
        state, F.lit("state").alias("level"), F.lit("").alias("district"), F.lit("").alias("mandal"), (F.col("r_regionkey").cast("long") + 5000).alias("feature")
    )
    rows = rows.unionByName(nations.select(state, F.lit("district").alias("level"), F.col("n_name").alias("district"), F.lit("").alias("mandal"), (n + 3000).alias("feature")))
    level = F.when(n % 2 == 0, "mandal").otherwise("taluk").alias("level")
    return rows.unionByName(nations.select(state, level, F.col("n_name").alias("district"), F.concat(F.lit("North Ring "), n.cast("string")).alias("mandal"), (n + 1000).alias("feature")))


@query(f"""
WITH q AS ({_ASKED}), v AS ({_VILLAGES}), f AS ({_FEATURES}),
e AS (SELECT q.id, v.* EXCLUDE state FROM q JOIN v ON q.state = v.state AND q.q_village = v.village WHERE q_village <> ''),
s AS (SELECT q.id, v.* EXCLUDE state FROM q JOIN v ON q.state = v.state AND (contains(q.q_village, v.village) OR contains(v.village, q.q_village))
  WHERE q_village <> '' AND q.id NOT IN (SELECT id FROM e)),
c AS (SELECT x.id, count(DISTINCT x.feature) AS n, min(x.feature) AS feature FROM (SELECT * FROM e UNION ALL SELECT * FROM s) x JOIN q USING (id)
  WHERE (q_mandal = '' OR contains(q_mandal, mandal) OR contains(mandal, q_mandal))
    AND (q_district = '' OR contains(q_district, district) OR contains(district, q_district) OR (old_district <> '' AND (contains(q_district, old_district) OR contains(old_district, q_district))))
  GROUP BY x.id),
m AS (SELECT q.id, arg_min(f.feature, (CASE WHEN f.mandal = q_mandal THEN 0 ELSE 1 END) * 1000000 + f.feature) AS feature FROM q JOIN f ON q.state = f.state AND level IN ('mandal', 'taluk')
  WHERE q_mandal <> '' AND contains(f.mandal, q_mandal) AND (q_district = '' OR contains(q_district, f.district) OR contains(f.district, q_district)) GROUP BY q.id),
d AS (SELECT q.id, min(f.feature) AS feature FROM q JOIN f ON q.state = f.state AND level = 'district' WHERE q_district <> '' AND (contains(q_district, f.district) OR contains(f.district, q_district)) GROUP BY q.id),
st AS (SELECT state, min(feature) FILTER (level = 'state') AS own, min(feature) AS rest FROM f GROUP BY state),
l AS (SELECT q.*, n, CASE WHEN n = 1 THEN 'village' WHEN n > 1 THEN 'ambiguous' WHEN m.feature IS NOT NULL THEN 'mandal' WHEN d.feature IS NOT NULL THEN 'district' WHEN own IS NOT NULL THEN 'state' WHEN rest IS NOT NULL THEN 'other' ELSE 'none' END AS lv,
    CASE WHEN n = 1 THEN c.feature WHEN n > 1 THEN NULL ELSE coalesce(m.feature, d.feature, own, rest) END::BIGINT AS feature
  FROM q LEFT JOIN c USING (id) LEFT JOIN m USING (id) LEFT JOIN d USING (id) LEFT JOIN st USING (state))
SELECT id, CASE lv WHEN 'other' THEN 'district' ELSE lv END AS level, feature,
  CASE WHEN lv = 'village' THEN 'CONSISTENT' WHEN lv = 'ambiguous' THEN 'AMBIGUOUS' WHEN lv = 'mandal' THEN CASE WHEN q_village <> '' THEN 'PARTIAL' ELSE 'CONSISTENT' END
    WHEN lv IN ('district', 'other') THEN CASE WHEN q_village <> '' OR q_mandal <> '' THEN 'CONTRADICTORY' ELSE 'CONSISTENT' END WHEN lv = 'state' THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS hierarchy,
  CASE lv WHEN 'village' THEN 90 WHEN 'ambiguous' THEN 40 WHEN 'mandal' THEN 70 WHEN 'district' THEN 50 WHEN 'state' THEN 30 WHEN 'other' THEN 30 ELSE 0 END::BIGINT AS confidence
FROM l""")
def gis_hierarchy(spark, d):
    k, n = F.col("c_custkey"), F.col("n_nationkey").cast("string")
    spot = (k % 30).cast("string")
    asked = t(spark, d, "customer").join(_nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.when(k % 19 == 0, "atlantis").otherwise(F.lower("r_name")).alias("state"),
        F.when(k % 4 == 0, F.initcap("n_name")).when(k % 4 == 1, F.concat("n_name", F.lit(" District"))).when(k % 4 == 3, F.substring("n_name", 1, 4)).alias("district"),
        F.when(k % 5 == 0, F.concat(F.lit("Circle "), (k % 4).cast("string"))).when(k % 5 == 1, F.concat(F.lit("ring "), n, F.lit(" tehsil")))
        .when(k % 5 == 2, F.concat(F.lit("NORTH RING-"), n)).otherwise(" ").alias("mandal"),
        F.when(k % 6 == 0, F.concat(F.lit("Property situated at Town"), spot, F.lit(" Village"))).when(k % 6 == 1, F.concat(F.lit("ii. town"), spot))
        .when(k % 6 == 2, F.concat(F.lit("own"), spot, F.lit(" ea"))).when(k % 6 == 3, "nowhere").alias("village"),
    )
    return gis.resolve_places(asked, _villages(spark, d), _features(spark, d))


@query("""
SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 6 WHEN 0 THEN 'demo_state' WHEN 1 THEN 'telangana' WHEN 2 THEN NULL WHEN 3 THEN 'telangana' WHEN 4 THEN 'karnataka' ELSE 'karnataka' END AS state_key FROM nation""")
def state_names(spark, d):
    k = F.col("n_nationkey").cast("long")
    asked = t(spark, d, "nation").select(
        k.alias("id"), F.when(k % 6 == 0, "Demo-State").when(k % 6 == 1, "State of Telangana").when(k % 6 == 2, "Tel").when(k % 6 == 3, " ").when(k % 6 == 4, "").alias("state"),
        F.when(k % 6 == 3, "Ranga Reddy").when(k % 6 == 4, "Mysore").alias("district"), F.lit(None).cast("string").alias("mandal"), F.lit("x").alias("village"),
    )
    states = t(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "demo_state").when(F.col("r_regionkey") == 1, "telangana").otherwise("karnataka").alias("state"))
    return gis.states_of(asked, states)


_GIVEN = """
  SELECT 'd' || (p_partkey % 9) AS dataset, p_partkey % 997 AS feature, CASE WHEN p_partkey % 9 = 4 THEN 'mandal' WHEN p_partkey % 31 = 0 THEN 'galaxy' ELSE 'district' END AS level,
    CASE WHEN p_partkey % 37 = 0 AND p_partkey % 9 <> 4 THEN ' ' ELSE p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN 'Point' ELSE 'Polygon' END AS kind,
    CASE WHEN p_partkey % 41 = 0 AND p_partkey % 9 <> 4 THEN 3 ELSE p_size + 4 END AS vertices, p_size * 2.0 AS lng, p_size * 2.0 AS lat FROM part"""
_ERRORS = f"""
WITH g AS ({_GIVEN}), x AS (
  SELECT dataset, feature, 'unknown level' AS error FROM g WHERE level = 'galaxy' UNION ALL SELECT dataset, feature, 'no name' FROM g WHERE trim(name) = ''
  UNION ALL SELECT dataset, feature, 'ring too short' FROM g WHERE kind = 'Polygon' AND vertices < 4 UNION ALL SELECT dataset, feature, 'outside the world' FROM g WHERE lat > 90
  UNION ALL SELECT dataset, feature, 'repeated id' FROM (SELECT *, count(*) OVER (PARTITION BY dataset, feature) AS n FROM g) WHERE n > 1)"""


def _given(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    clean = k % 9 == 4
    return t(spark, d, "part").select(
        F.concat(F.lit("d"), (k % 9).cast("string")).alias("dataset"), (k % 997).alias("feature"),
        F.when(clean, "mandal").when(k % 31 == 0, "galaxy").otherwise("district").alias("level"), F.when((k % 37 == 0) & ~clean, " ").otherwise(F.col("p_name")).alias("name"),
        F.lit("s").alias("state"), F.when(k % 3 == 0, "Point").otherwise("Polygon").alias("geometry_type"),
        F.when((k % 41 == 0) & ~clean, 3).otherwise(F.col("p_size") + 4).alias("vertices"), (F.col("p_size") * 2.0).alias("lng"), (F.col("p_size") * 2.0).alias("lat"),
    )


@query(_ERRORS + " SELECT * FROM x")
def dataset_errors(spark, d):
    return gis.dataset_errors(_given(spark, d))


@query(f"""{_ERRORS},
n AS (SELECT dataset, count(*) AS features FROM g GROUP BY dataset), e AS (SELECT dataset, count(*) AS errors FROM x GROUP BY dataset),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY feature, error) AS nth FROM x)
SELECT n.dataset, features, coalesce(errors, 0) AS errors, (SELECT string_agg(feature || ': ' || error, '; ' ORDER BY nth) FROM r WHERE r.dataset = n.dataset AND nth <= 15) AS first,
  coalesce(errors, 0) = 0 AND n.dataset <> 'd1' AS taken FROM n LEFT JOIN e USING (dataset)""")
def dataset_onboarding(spark, d):
    given = _given(spark, d)
    there = t(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("dataset"))
    return gis.onboarding(given, gis.dataset_errors(given), there).withColumn("first", F.array_join("first", "; "))


@query("""
SELECT coalesce(state, 'all') AS state, coalesce(level, 'all') AS level, count(*) AS features FROM (
  SELECT lower(r_name) AS state, 'district' AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT lower(r_name), CASE WHEN n_nationkey % 2 = 0 THEN 'mandal' ELSE 'taluk' END FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT lower(r_name), 'state' FROM region WHERE r_regionkey <> 2) GROUP BY ROLLUP (state, level)""")
def dataset_inventory(spark, d):
    n = _features(spark, d).rollup("state", "level").agg(F.count("*").alias("features"))
    return n.na.fill("all", ["state", "level"])


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 1.0 ELSE (2.0 * s_suppkey + 3) / 3 END AS lng, CASE WHEN s_suppkey % 4 = 0 THEN 2.0 ELSE 5.0 / 3 END AS lat,
  round(s_acctbal * 0.836127, 4) AS sqm, round_even(s_acctbal / 1.5, 0)::BIGINT AS x_min, CASE WHEN s_suppkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM supplier""")
def feature_points(spark, d):
    k = F.col("s_suppkey").cast("double")
    corner = lambda x, y: F.array(x, F.lit(float(y)))
    ring = F.array(corner(k, 1), corner(k + 3, 4), corner(F.lit(0.0), 0))
    rings = F.when(F.col("s_suppkey") % 2 == 0, F.array(ring)).otherwise(F.array(ring, ring))
    kind = F.when(F.col("s_suppkey") % 4 == 0, "Point").otherwise("Polygon")
    p = geometry.feature_point(kind, corner(k, 2), ring)
    box = geometry.unscaled_box({"x_min": F.col("s_acctbal")}, F.lit(1.5))
    return t(spark, d, "supplier").select(
        "s_suppkey", p["lng"].alias("lng"), p["lat"].alias("lat"), F.round(geometry.square_metres(F.col("s_acctbal")), 4).alias("sqm"), box["x_min"].alias("x_min"),
        geometry.ring_geometry(rings)["type"].alias("kind"),
    )


@query("""
SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'Demo State' ELSE 'Old Coast' END AS display_name, r_regionkey, r_regionkey % 2 = 0 OR r_regionkey = 3 AS is_synthetic FROM region""")
def state_notes(spark, d):
    k = F.col("r_regionkey")
    m = gis.state_metadata(F.when(k == 3, "This is SYNTHETIC data"), F.when(k % 2 == 0, "demo_state").otherwise("old_coast"))
    return t(spark, d, "region").select(m["display_name"].alias("display_name"), "r_regionkey", m["is_synthetic"].alias("is_synthetic"))
