"""Registered queries of what a single deed's fields go through: dates, sizes,
boxes, cleaned texts, scored candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence, dates, geometry, text
from ..operators import duplicates
from ..sources import files
from .registry import query, t


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d-%-m-%Y')
  WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'undated' END AS written FROM orders)
SELECT o_orderkey, written, try_strptime(written, ['%Y-%m-%d', '%d-%m-%Y', '%d/%m/%Y', '%Y/%m/%d'])::DATE AS parsed FROM s""")
def numeric_dates(spark, d):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    written = (
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "d-M-yyyy"))
        .when(k == 2, F.date_format(at, "dd/MM/yyyy")).when(k == 3, F.date_format(at, "yyyy/MM/dd")).otherwise("undated")
    )
    return t(spark, d, "orders").select("o_orderkey", written.alias("written")).withColumn("parsed", dates.numeric_date(F.col("written")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%d-%m-%Y') END AS executed,
  strftime(o_orderdate, '%-d-%-m-') || '20' || strftime(o_orderdate, '%y') AS stamped FROM orders""")
def written_dates(spark, d):
    at = F.col("o_orderdate")
    clause = F.concat(F.lit("made on this "), F.date_format(at, "d"), F.lit("th day of "), F.date_format(at, "MMMM"), F.lit(", "), F.date_format(at, "yyyy"))
    rows = t(spark, d, "orders").withColumn("clause", F.when(F.col("o_orderkey") % 7 == 0, "made on this ____ day of ____").otherwise(clause))
    return rows.select("o_orderkey", dates.written_date(F.col("clause")).alias("executed"), dates.full_year(F.date_format(at, "d.M.yy")).alias("stamped"))


_SIZED = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' ft x ' || (p_partkey % 50 + 1) || ' ft' WHEN 1 THEN p_size || 'X' || (p_partkey % 50 + 1)
  WHEN 2 THEN 'East-West ' || p_size || 'ft, North-South ' || (p_partkey % 50 + 1) || ' m' ELSE 'unknown' END AS size FROM part"""


def _sized(spark, d):
    k, other = F.col("p_partkey") % 4, (F.col("p_partkey") % 50 + 1).cast("string")
    a = F.col("p_size").cast("string")
    size = (
        F.when(k == 0, F.concat(a, F.lit(" ft x "), other, F.lit(" ft"))).when(k == 1, F.concat(a, F.lit("X"), other))
        .when(k == 2, F.concat(F.lit("East-West "), a, F.lit("ft, North-South "), other, F.lit(" m"))).otherwise("unknown")
    )
    rows = files.spread(t(spark, d, "part"), "p_partkey")
    return rows.select("p_partkey", size.alias("size")).withColumn("m", geometry.dimensions(F.col("size")))


@query(f"""
WITH n AS (SELECT p_partkey, regexp_extract_all(size, '[0-9]+') AS v, p_partkey % 4 AS k FROM ({_SIZED})),
m AS (SELECT p_partkey, v[1]::DOUBLE * 0.3048 AS ew, v[2]::DOUBLE * CASE k WHEN 2 THEN 1 ELSE 0.3048 END AS ns FROM n)
SELECT p_partkey, round(ew, 4) AS ew, round(ns, 4) AS ns, round(round(ew * ns, 2) * 10.7639, 1) AS sqft FROM m""")
def plot_dimensions(spark, d):
    m = F.col("m")
    sqft = F.round(geometry.area_sqm(m) * geometry.SQM_SQFT, 1)
    return _sized(spark, d).select("p_partkey", F.round(m["ew"], 4).alias("ew"), F.round(m["ns"], 4).alias("ns"), sqft.alias("sqft"))


@query("""
SELECT s_suppkey, round(lng - 30 / (111000 * cos(radians(lat))), 6) AS west, round(lat - 20 / 111000.0, 6) AS south, round(lng + 30 / (111000 * cos(radians(lat))), 6) AS east,
  round(lat + 20 / 111000.0, 6) AS north, round((lng + 180) / 360 * 256 * 4096, 3) AS px, round((1 - asinh(tan(radians(lat))) / pi()) / 2 * 256 * 4096, 3) AS py
FROM (SELECT s_suppkey, (s_suppkey % 60)::DOUBLE AS lat, (s_suppkey % 170)::DOUBLE AS lng FROM supplier)""")
def plot_on_map(spark, d):
    lat, lng = (F.col("s_suppkey") % 60).cast("double"), (F.col("s_suppkey") % 170).cast("double")
    size = F.struct(F.lit(60.0).alias("ew"), F.lit(40.0).alias("ns"))
    rows = t(spark, d, "supplier").select("s_suppkey", geometry.rectangle(lat, lng, size).alias("ring"), geometry.map_pixel(lat, lng, 12).alias("p"))
    corner = {"west": (0, 0), "south": (0, 1), "east": (2, 0), "north": (2, 1)}
    sides = [F.round(F.col("ring")[i][j], 6).alias(name) for name, (i, j) in corner.items()]
    return rows.select("s_suppkey", *sides, F.round("p.x", 3).alias("px"), F.round("p.y", 3).alias("py"))


@query("""
WITH b AS (SELECT l_orderkey, l_quantity - 5 AS x0, l_quantity + 10 - 4 * l_linenumber AS x1, l_linenumber - 2 AS y0, l_linenumber + 3 AS y1 FROM lineitem)
SELECT l_orderkey, count(*) FILTER (x0 >= 0 AND y0 >= 0 AND x0 < 40 AND y0 < 8 AND x1 > 0 AND y1 > 0 AND x1 <= 40 AND y1 <= 8 AND x0 <= x1 AND y0 <= y1) AS strict,
  count(*) FILTER (x0 >= 0 AND y0 >= 0 AND x0 <= 40 AND y0 <= 8 AND x1 <= 40 AND y1 <= 8 AND x0 <= x1 AND y0 <= y1) AS inclusive FROM b GROUP BY l_orderkey""")
def boxes_on_page(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    box = {"x_min": q - 5, "x_max": q + 10 - 4 * n, "y_min": n - 2, "y_max": n + 3}
    strict, loose = (geometry.box_within(box, F.lit(40), F.lit(8), i) for i in (False, True))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(strict).alias("strict"), F.count_if(loose).alias("inclusive"))


@query("""
SELECT p_partkey, (10 + 75 * i)::BIGINT AS top, (CASE WHEN h <= 112.5 THEN 10 + h ELSE least(10 + h, 85 + 75 * i) END)::BIGINT AS bottom
FROM (SELECT p_partkey, h, unnest(range(CASE WHEN h <= 112.5 THEN 1 ELSE (h + 74) // 75 END)) AS i FROM (SELECT p_partkey, p_size * 9 AS h FROM part))""")
def line_crops(spark, d):
    bands = geometry.line_bands(F.lit(10).cast("long"), 10 + 9 * F.col("p_size").cast("long"))
    return t(spark, d, "part").select("p_partkey", F.explode(bands).alias("b")).select("p_partkey", "b.top", "b.bottom")


@query("""
SELECT p_partkey, nullif(trim(' ,' || p_name || ' .;-', ' ,.;:-'), '') AS cleaned, translate(upper(p_brand || '|OI'), 'OI|', '01/') AS repaired,
  trim(regexp_replace('(' || p_type || '/' || p_brand || ')', '[^\\p{L}\\p{N}]', '-', 'g'), '-') AS slug FROM part""")
def cleaned_fields(spark, d):
    name = F.concat(F.lit(" ,"), "p_name", F.lit(" .;-"))
    slug = text.file_slug(F.concat(F.lit("("), "p_type", F.lit("/"), "p_brand", F.lit(")")))
    repaired = text.number_noise(F.concat("p_brand", F.lit("|OI")))
    return t(spark, d, "part").select("p_partkey", text.clean_field(name).alias("cleaned"), repaired.alias("repaired"), slug.alias("slug"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def model_answers(spark, d):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")))
    answer = answer.when(F.col("event_id") % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" I think"))).otherwise("I can't say.")
    k = F.get_json_object(text.embedded_json(answer), "$.k").try_cast("long")
    return t(spark, d, "events").select("event_id", k.alias("k"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, 0.6 * (1 - l_discount) + 0.4 * (1 - l_tax) AS c, l_returnflag = 'A' AS fixed, l_returnflag = 'R' AS review, l_linestatus = 'F' AS conflict, l_quantity > 10 AS found FROM lineitem),
b AS (SELECT *, CASE WHEN fixed THEN least(c * 0.82, 0.78) WHEN review THEN least(c, 0.78) ELSE c END AS c1 FROM a),
e AS (SELECT *, CASE WHEN conflict THEN least(c1 * 0.75, 0.65) ELSE c1 END AS c2 FROM b)
SELECT l_orderkey, l_linenumber, round(least(0.98, greatest(0.2, CASE WHEN found THEN c2 ELSE least(c2 * 0.8, 0.7) END)), 6)::DOUBLE AS confidence FROM e""")
def provenance_scores(spark, d):
    score = confidence.provenance_confidence(
        1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_returnflag") == "A", F.col("l_returnflag") == "R",
        F.col("l_linestatus") == "F", F.col("l_quantity") > 10,
    )
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("confidence"))


@query(r"""
WITH lines AS (SELECT doc_id, i, line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i)),
c AS (SELECT doc_id, i, regexp_extract(line, '[0-9]{3,6}') AS value, CASE WHEN (i - 1) % 20 <= 3 THEN 0.98 WHEN (i - 1) % 20 <= 5 THEN 0.90 ELSE 0.70 END::DOUBLE AS score FROM lines)
SELECT doc_id AS doc, 'document_number' AS field, value, score, ((i - 1) // 20 + 1)::BIGINT AS page FROM c WHERE value <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1""")
def document_numbers(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    high = F.col("i") % 20  # place of a line on its page of twenty
    c = lines.select(
        F.col("doc_id").alias("doc"), F.lit("document_number").alias("field"), F.regexp_extract("line", "[0-9]{3,6}", 0).alias("value"),
        F.when(high <= 3, 0.98).when(high <= 5, 0.90).otherwise(0.70).alias("score"), (F.floor(F.col("i") / 20) + 1).alias("page"), F.col("i").alias("ordinal"),
    )
    return duplicates.ranked_best(c.where("value <> ''")).drop("ordinal")
