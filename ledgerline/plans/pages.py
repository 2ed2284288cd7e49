"""Registered queries of what is read from whole pages: plots and areas by the
words around them, stamps, handwriting, words, parties; and of tables compared
or merged field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import merging, parcels, parties, regions, stamps, store
from .registry import query, t


def _text(*parts: Column | str) -> Column:
    """Parts as one text: columns as they are, words as literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Deeds of orders. Page 1 names one or two plots and, in the same line, a
# neighbour's; two thirds have a second page, a schedule or a plan, whose plot
# is the first one or another.
_PLOTS = """
  SELECT o_orderkey AS doc, (o_orderkey % 900 + 100)::BIGINT AS base, o_custkey % 9 + 1 AS a, o_custkey % 8 + 1 AS b, o_orderkey % 3 AS kind, o_orderkey % 5 = 0 AS house
  FROM orders"""


def _plot_pages(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base, a, b = k % 900 + 100, c % 9 + 1, c % 8 + 1
    first = _text(
        F.when(k % 5 == 0, "H.No. 4 beside a flat and plot 17/9. ").otherwise("Deed of sale. "), "Sold are plot Nos. ", base, "/", a, " & ", b,
        "; bounded on the NORTH by Plot No. ", base + 1, "/7, EAST : plot 5/5\nsite 40 wide road",
    )
    second = F.when(k % 3 == 0, _text("SCHEDULE OF THE PROPERTY\nPlot No. ", base, "/", a)).when(k % 3 == 1, _text("REGISTRATION PLAN\nplot no. ", base + 1, "/", a))
    each = F.array(F.struct(F.lit(1).cast("long").alias("page"), first.alias("text")), F.struct(F.lit(2).cast("long").alias("page"), second.alias("text")))
    rows = t(spark, d, "orders").select(k.alias("doc"), F.inline(each)).where("text is not null")
    return rows.withColumn("scores", F.array(F.lit(0.9), F.lit(0.8)))


@query(f"""
WITH p AS (SELECT *, CASE WHEN a = b THEN 1 ELSE 2 END AS n, base || '/' || a AS one, (base + 1) || '/' || a AS other FROM ({_PLOTS}))
SELECT doc, CASE WHEN n = 2 THEN one || ', ' || base || '/' || b WHEN kind = 1 THEN other ELSE one END AS value,
  CASE WHEN n = 2 THEN 0.93 WHEN kind = 1 THEN 1.05 WHEN kind = 0 THEN 0.95 ELSE 0.88 END::DOUBLE AS score,
  CASE WHEN kind = 1 THEN 'CONFLICT' ELSE 'EXTRACTED' END AS status, kind = 1 AS needs_review,
  CASE WHEN kind = 1 THEN CASE WHEN n = 2 THEN one || ', ' || base || '/' || b ELSE one END || '; ' || other ELSE '' END AS conflicting
FROM p""")
def plot_spans(spark, d):
    """Plots of a deed, told from a neighbour's in the same line."""
    best = parcels.resolved_plots(parcels.plots(_plot_pages(spark, d)))
    return best.withColumn("conflicting", F.array_join("conflicting", "; "))


@query("""
WITH a AS (SELECT o_orderkey AS doc, o_orderkey % 6 AS kind, o_custkey % 700 + 60 AS yards, CASE WHEN o_custkey % 2 = 0 THEN 0.9 ELSE 0.7 END AS s FROM orders),
m AS (SELECT *, round(yards * 0.836127, 1) AS metres FROM a)
SELECT doc, yards::DOUBLE AS yards, metres::DOUBLE AS metres, yards || ' sq. yards (' || regexp_replace(metres::VARCHAR, '\\.0$', '') || ' sq. metres)' AS value,
  round(CASE kind WHEN 0 THEN least(1.05, s + 0.08) WHEN 1 THEN least(0.98, s + 0.02) WHEN 2 THEN least(0.98, s + 0.03) ELSE
    CASE WHEN s >= 0.8 THEN least(CASE kind WHEN 3 THEN 0.99 WHEN 4 THEN 0.95 ELSE 0.6 END, s + 0.05) ELSE least(CASE kind WHEN 3 THEN 0.99 WHEN 4 THEN 0.95 ELSE 0.6 END, s) END END, 4)::DOUBLE AS score,
  ['schedule extent', 'plan area', 'piece of land', 'described', 'sold', 'alone'][kind + 1] AS reason
FROM m UNION ALL SELECT doc, NULL, NULL, 'AC. 5-' || (doc % 40) || ' GTS', 0.0, 'acres' FROM a WHERE doc % 7 = 0""")
def area_spans(spark, d):
    """Areas of deeds by what is said around them."""
    k, yards = F.col("o_orderkey"), F.col("o_custkey") % 700 + 60
    metres = F.regexp_replace(F.round(yards * 0.836127, 1).cast("string"), r"\.0$", "")
    said = F.element_at(F.array(*map(F.lit, ("an extent of ", "PLOT AREA: ", "piece of land measuring about ", "ad-measuring in all of ", "the property being sold is ", "there are "))), (k % 6 + 1).cast("int"))
    unit = F.when(k % 6 == 1, " Sq. Yds").otherwise(" sq.yards")
    told = F.when(k % 2 == 0, _text(" or ", metres, " Sq. Mtrs.")).otherwise(".")
    acres = F.when(k % 7 == 0, _text(" Of a holding of AC. 5-", k % 40, " GTS")).otherwise("")
    text = _text("first line\n", said, yards, unit, told, acres)
    scores = F.array(F.lit(0.3), F.when(F.col("o_custkey") % 2 == 0, 0.9).otherwise(0.7))
    pages = t(spark, d, "orders").select(k.alias("doc"), F.lit(1).alias("page"), text.alias("text"), scores.alias("scores"))
    return parcels.areas(pages).select("doc", "yards", "metres", "value", "score", "reason")


@query("""
SELECT o_orderkey AS doc, nullif(CASE WHEN o_orderkey % 4 <> 0 THEN 'H.No. ' || (o_custkey % 90 + 10) || '-2 Main Street, ' ELSE '' END || n, '') AS address FROM (
  SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'Warangal ' || (500000 + o_custkey) ELSE 'Near The ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Old' ELSE 'New' END || ' Mill' END AS n FROM orders)""")
def residual_addresses(spark, d):
    """What is left of a party's block once the party is taken out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name, relation, age = _text("Sri. Customer ", c), F.when(k % 2 == 0, _text("S/o Father ", k)), _text(c % 60 + 20, " years")
    place = F.when(k % 3 == 0, _text("warangal ", c + 500000)).otherwise(_text("near the ", F.when(k % 2 == 0, "old").otherwise("new"), " mill"))
    house = F.when(k % 4 != 0, _text(" H. No. ", c % 90 + 10, "-2 main street.")).otherwise("")
    block = _text("1) ", name, ", ", F.coalesce(relation, F.lit("")), ", Age: ", F.upper(age), ", Occupation: Trade. R/o. ", place, ".", house, " Aadhaar No. XXXX 1234. Hereinafter called the Vendor")
    return t(spark, d, "orders").select(k.alias("doc"), parcels.residual_address(block, name, relation, age, F.lit("Trade")).alias("address"))


@query("""
WITH p AS (SELECT o_orderkey AS doc, unnest([1, 2, 3])::BIGINT AS page, o_custkey, o_orderkey % 4 AS kind FROM orders),
s AS (SELECT *, o_custkey + page * 10000 AS number FROM p WHERE page < 3 OR kind = 1)
SELECT doc, page, CASE WHEN kind = 2 AND page = 2 THEN NULL ELSE format('{:,}', number) END AS serial,
  NOT (kind = 2 AND page = 2) AND NOT (kind = 3 AND page = 1) AS labelled, CASE page WHEN 1 THEN 'Rs. 100' WHEN 2 THEN 'Rs. 50' END AS denomination,
  CASE WHEN page = 1 THEN 'Buyer ' || (o_custkey % 50) END AS purchased_by, CASE WHEN page = 1 AND doc % 3 = 0 THEN 'Firm ' || doc ELSE 'Self' END AS for_whom, round(1 - (page - 1) * 0.02, 4)::DOUBLE AS score
FROM s""")
def stamp_pages(spark, d):
    """Two stamps on neighbouring pages, one of them without a serial or with
    one that has no label; a third page only sometimes shows one."""
    k, c, kind = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 4
    number = lambda page: F.format_number(c + page * 10000, 0) if page == 2 else (c + page * 10000)
    line = lambda page, ordinal, text: F.struct(F.lit(page).cast("long").alias("page"), F.lit(ordinal).alias("ordinal"), text.alias("text"))
    serial = F.when(kind == 3, number(1).cast("string")).otherwise(_text("Sl. No. ", number(1)))
    lines = F.array(
        line(1, 1, F.lit("INDIA NON JUDICIAL Rs. 100")), line(1, 2, serial), line(1, 3, _text("Purchased by: BUYER ", c % 50, " S/o someone")),
        line(1, 4, F.when(k % 3 == 0, _text("For whom : Firm ", k)).otherwise("For whom:")), line(1, 5, F.lit("also 999999")),
        line(2, 1, F.lit("fifty rupees")), line(2, 2, F.when(kind == 2, "stamp").otherwise(_text("stamp, Serial Number: ", number(2)))), line(2, 3, F.when(kind != 2, "also 999999").otherwise("nothing")),
        line(3, 1, F.when(kind == 1, _text("SL. NO. ", number(3))).otherwise("page 31234")), line(3, 2, F.when(kind == 1, "sold to one").otherwise("deed")),
    )
    return stamps.stamp_blocks(t(spark, d, "orders").select(k.alias("doc"), F.inline(lines)))


# Lines of deeds: what each says and where it stands follow from its line item.
_LINES = """
  SELECT l_orderkey AS doc, l_linenumber AS n, l_quantity AS q, l_discount AS disc, (l_partkey % 4)::INT AS says, l_suppkey,
    0.55 + l_discount * 3 AS score, (l_linenumber - 1) * 150 + 20 AS y FROM lineitem"""


def _deed_lines(spark, d) -> DataFrame:
    says, n = F.col("l_partkey") % 4, F.col("l_linenumber")
    text = F.when(says == 0, _text("Noted ", F.col("l_suppkey"))).when(says == 1, "Sub Registrar 4").when(says == 2, "signature of the executant").otherwise("SALE DEED 1 hereinafter")
    y = ((n - 1) * 150 + 20).cast("int")
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).cast("long").alias("page"), n.alias("ordinal"), text.alias("text"), (0.55 + F.col("l_discount") * 3).alias("score"),
        F.lit(5).alias("x_min"), y.alias("y_min"), F.col("l_quantity").cast("int").alias("x_max"), (y + 10).alias("y_max"), F.lit(1000).alias("page_height"),
    )


@query(f"""
WITH f AS (SELECT *, CASE WHEN says = 1 THEN NULL WHEN says = 2 AND y + 5 >= 820 THEN NULL WHEN y + 5 <= 160 AND says = 0 THEN 'margin'
  WHEN score < 0.72 AND says IN (0, 2) THEN 'doubtful' END AS found_by FROM ({_LINES}))
SELECT doc, n::BIGINT AS ordinal, found_by, 5 AS x_min, y::BIGINT AS y_min, q::BIGINT AS x_max, y + 10 AS y_max,
  round(CASE found_by WHEN 'margin' THEN least(0.85, greatest(0.4, 1 - score * 0.4)) ELSE least(0.65, score) END, 4)::DOUBLE AS confidence
FROM f WHERE found_by IS NOT NULL""")
def handwriting_boxes(spark, d):
    """Regions that may be handwriting, with their boxes."""
    rows = regions.handwriting_regions(_deed_lines(spark, d))
    sides = [F.col("box")[i].cast("long").alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return rows.select("doc", F.col("ordinal").cast("long").alias("ordinal"), "found_by", *sides, "confidence")


@query(f"""
WITH f AS (SELECT doc, says = 0 AND (y + 5 <= 160 OR score < 0.72) OR says = 2 AND y + 5 < 820 AND score < 0.72 AS hit, q > 40 AS read FROM ({_LINES}))
SELECT doc, bool_or(hit) AS detected, count(*) FILTER (hit AND read) AS recognised_regions, count(*) FILTER (hit AND NOT read) AS unrecognised_regions, bool_or(hit) AS needs_review
FROM f GROUP BY doc""")
def handwriting_summary(spark, d):
    """Counts of the regions of every deed, those without any too."""
    lines = _deed_lines(spark, d)
    found = regions.handwriting_metadata(regions.handwriting_regions(lines), lines, F.col("box")[2] > 40)
    return found.drop("pages")


@query(r"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i, len(a) - doc_id % 3 AS n FROM w),
k AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(x, '[\s\x0B]+', ' ', 'g')), '^ +| +$', '', 'g') AS x FROM e WHERE i < n)
SELECT doc_id, count(*) AS words, sum(length(x))::BIGINT AS chars, sum(i * 7 % 500)::BIGINT AS left_sum, max(i // 10 * 20 + 6)::DOUBLE AS lowest, sum(length(x) % 5 + 8)::BIGINT AS heights
FROM k WHERE x <> '' GROUP BY doc_id""")
def recognised_page_words(spark, d):
    """A recogniser's three arrays, of unlike lengths, as words with boxes."""
    words = F.split("text", " ")
    shorter = F.greatest(F.size(words) - (F.col("doc_id") % 3).cast("int"), F.lit(0))
    clean = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))

    def polygon(x, i):
        left, top = i * 7 % 500, F.floor(i / 10).cast("int") * 20 + 2
        bottom = top + F.length(clean(x)) % 5 + 8
        corner = lambda a, b: F.array((a * 2).cast("int"), (b * 2).cast("int"))
        return F.array(corner(left, top), corner(left + 30, top), corner(left + 30, bottom), corner(left, bottom))

    pages = t(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("doc"), F.lit(1).alias("page"), words.alias("rec_texts"), F.array_repeat(F.lit(0.9), shorter).alias("rec_scores"), F.transform(words, polygon).alias("rec_polys")
    )
    found = regions.recognised_words(pages, 2.0)
    return found.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count("*").alias("words"), F.sum(F.length("text")).alias("chars"), F.sum("x_min").alias("left_sum"), F.max(F.col("y_min") + 4).cast("double").alias("lowest"), F.sum("height").alias("heights")
    )


@query("""
WITH p AS (SELECT o_orderkey AS doc, unnest([1, 2, 3, 4])::BIGINT AS party, o_custkey, o_orderkey % 2 = 0 AS corrected FROM orders),
l AS (SELECT *, CASE party WHEN 1 THEN 'name' WHEN 2 THEN 'representative' WHEN 3 THEN 'words' ELSE 'none' END AS found_by,
  CASE party WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS ordinal, CASE party WHEN 1 THEN 0.95 WHEN 2 THEN 0.80 WHEN 3 THEN 0.45 END AS line FROM p),
c AS (SELECT *, CASE WHEN line IS NULL THEN 0.6 ELSE least(0.98, greatest(0.5, line)) END AS c FROM l)
SELECT doc, party, found_by, ordinal::BIGINT AS ordinal, round(CASE WHEN corrected THEN least(c * 0.85, 0.78) WHEN line IS NULL OR c < 0.85 THEN least(c, 0.82) ELSE c END, 4)::DOUBLE AS score,
  corrected OR line IS NULL OR c < 0.85 AS needs_review FROM c""")
def deed_parties(spark, d):
    """Each party of a deed by the pass that finds its line."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = lambda n, text, score: F.struct(F.lit(n).cast("long").alias("ordinal"), F.lit(1).alias("page"), text.alias("text"), F.lit(score).alias("score"))
    lines = F.array(
        line(1, _text("Deed ", k), 0.99), line(2, _text("sold by CUSTOMER #", c, " of here"), 0.95), line(3, _text("through agent ", c, " and customer #", c, "x"), 0.80),
        line(4, _text("Messrs holdings at segment ", c % 5), 0.45), line(5, F.lit("segment"), 0.9),
    )
    party = lambda n, name, other: F.struct(F.lit(n).cast("long").alias("party"), name.alias("name"), other.cast("string").alias("representative"))
    none = F.lit(None)
    people = F.array(
        party(1, _text("Customer #", c), _text("Agent ", c)), party(2, F.lit("Unnamed Heirs"), _text("AGENT ", c)), party(3, F.lit("Segment & Holdings, Inc"), F.lit(" ")), party(4, F.lit("Zed"), none), party(5, F.lit(" "), none)
    )
    orders = t(spark, d, "orders")
    asked = orders.select(k.alias("doc"), (k % 2 == 0).alias("corrected"), F.lit(None).cast("double").alias("given"), F.inline(people))
    return parties.party_lines(asked, orders.select(k.alias("doc"), F.inline(lines))).drop("page", "line")


@query("""
WITH RECURSIVE c AS (
  SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, p_name AS name, string_split(p_name, ' ') AS tokens,
    CASE WHEN l_partkey % 3 = 0 THEN 'agent ' || l_partkey END AS rep, 0.5 + (l_partkey % 40) / 100.0 AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey
), n AS (SELECT doc, max(i) AS n, list(tokens ORDER BY i) AS t FROM c GROUP BY doc), f AS (
  SELECT doc, 0::BIGINT AS i, []::BIGINT[] AS leaders, NULL::BIGINT AS own, t, n FROM n
  UNION ALL
  SELECT doc, i + 1, CASE WHEN hit IS NULL THEN list_append(leaders, i + 1) ELSE leaders END, coalesce(hit, i + 1), t, n
  FROM (SELECT *, list_filter(leaders, lambda x: len(list_intersect(t[x], t[i + 1])) > 0)[1] AS hit FROM f WHERE i < n)
), g AS (SELECT c.*, f.own FROM f JOIN c USING (doc, i)),
w AS (SELECT doc, own, round(sum(score), 9) AS w FROM g GROUP BY doc, own),
top AS (SELECT doc, own FROM w QUALIFY row_number() OVER (PARTITION BY doc ORDER BY w DESC, own) = 1),
best AS (SELECT g.*, first_value(rep IGNORE NULLS) OVER (PARTITION BY g.doc ORDER BY (rep IS NULL), i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lent
  FROM g JOIN top USING (doc, own) QUALIFY row_number() OVER (PARTITION BY g.doc ORDER BY (rep IS NULL), score DESC, i) = 1),
k AS (SELECT doc, count(*) AS groups, string_agg(name, '; ' ORDER BY i) AS names FROM g WHERE own = i GROUP BY doc)
SELECT doc, name, coalesce(rep, lent) AS representative, groups, groups > 1 AS conflict, CASE WHEN groups > 1 THEN names ELSE '' END AS names FROM best JOIN k USING (doc)""")
def party_groups(spark, d):
    """Names that share a word are one party's, in the order they come."""
    part = t(spark, d, "part").select("p_partkey", "p_name")
    rows = t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_partkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    found = parties.reconciled(rows.select(F.col("l_orderkey").alias("doc"), nth.alias("ordinal"), F.col("p_name").alias("name"), F.when(k % 3 == 0, _text("agent ", k)).alias("representative"), (0.5 + (k % 40) / 100.0).alias("score")))
    return found.select("doc", "name", "representative", F.col("groups").cast("long").alias("groups"), "conflict", F.array_join("names", "; ").alias("names"))


_MIGRATED = """
  SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price, '{"b": 1, "a": ' || o_custkey || '}' AS payload, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0"""


@query(f"""
WITH a AS ({_MIGRATED}), told AS (
  SELECT id, 'id' AS field, id::VARCHAR AS value, 1 AS l, CASE WHEN id % 13 = 0 THEN 0 ELSE 1 END AS r FROM a
  UNION ALL SELECT id, 'owner', owner::VARCHAR, 1, CASE WHEN id % 13 = 0 THEN 0 ELSE 1 END FROM a
  UNION ALL SELECT id, 'price', rtrim(rtrim(price::DECIMAL(18, 2)::VARCHAR, '0'), '.'), 1, CASE WHEN id % 13 = 0 OR id % 5 = 0 THEN 0 ELSE 1 END FROM a
  UNION ALL SELECT id, 'price', rtrim(rtrim((price + 1)::DECIMAL(18, 2)::VARCHAR, '0'), '.'), 0, 1 FROM a WHERE id % 13 <> 0 AND id % 5 = 0
  UNION ALL SELECT id, 'payload', '{{"a":' || owner || ',"b":1}}', 1, CASE WHEN id % 13 = 0 THEN 0 ELSE 1 END FROM a
  UNION ALL SELECT id, 'status', status, 1, 0 FROM a WHERE id % 13 = 0
  UNION ALL SELECT id, field, value, 0, 2 FROM (SELECT o_orderkey AS id, unnest(['id', 'owner', 'price', 'payload', 'status']) AS field,
      unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, rtrim(rtrim(o_totalprice::DECIMAL(18, 2)::VARCHAR, '0'), '.'), '{{"a":' || o_custkey || ',"b":1}}', o_orderstatus]) AS value FROM orders WHERE o_orderkey % 22 = 0)
), same AS (SELECT id, 'status' AS field FROM a WHERE id % 13 <> 0)
SELECT id, field, value, l::BIGINT AS left_rows, r::BIGINT AS right_rows FROM told WHERE l <> r""")
def record_differences(spark, d):
    """A migrated table beside its source, field by field: rows that are missing
    or came twice, one field altered, types and key order changed without
    meaning."""
    orders = t(spark, d, "orders")
    k, owner = F.col("o_orderkey"), F.col("o_custkey")
    source = orders.where(k % 11 != 0).select(k.alias("id"), owner.alias("owner"), F.col("o_totalprice").alias("price"), _text('{"b": 1, "a": ', owner, "}").alias("payload"), F.col("o_orderstatus").alias("status"))
    changed = F.when((k % 5 == 0) & (k % 11 != 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    target = orders.where(((k % 11 != 0) & (k % 13 != 0)) | (k % 22 == 0)).select(
        k.cast("string").alias("id"), owner.cast("string").alias("owner"), F.format_string("%.4f", changed).alias("price"), _text('{"a":', owner, ',"b":1}').alias("payload"),
        F.when(k % 11 == 0, F.col("o_orderstatus")).alias("status"), F.when(k % 22 == 0, 2).otherwise(1).alias("n"),
    )
    target = target.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "copy").withColumn("id", F.col("id").cast("long"))
    status = orders.select(k.alias("id"), F.col("o_orderstatus").alias("of"))
    target = target.join(status, "id").withColumn("status", F.coalesce("status", "of")).drop("of")
    return store.field_differences(source, target, "id", ["owner", "price", "payload", "status"])


@query("""
WITH r AS (SELECT o_orderkey AS doc, o_orderkey % 7 AS k, o_custkey FROM orders),
v AS (SELECT doc, 'village' AS field, CASE WHEN k = 0 THEN NULL ELSE 'Town ' || o_custkey END AS mine, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'town-' || o_custkey ELSE 'Place ' || o_custkey END AS theirs, false AS over FROM r
  UNION ALL SELECT doc, 'mandal', CASE WHEN k IN (0, 3) THEN NULL ELSE 'North' END, CASE WHEN k < 5 THEN 'South' END, false FROM r
  UNION ALL SELECT doc, 'consideration_amount', CASE WHEN k < 4 THEN '100' END, CASE WHEN k > 2 THEN '2' || k END, true FROM r),
s AS (SELECT *, CASE WHEN mine IS NULL AND theirs IS NULL THEN 'none' WHEN mine IS NOT NULL AND theirs IS NOT NULL AND lower(replace(theirs, '-', ' ')) = lower(mine) THEN 'both'
  WHEN mine IS NOT NULL AND theirs IS NOT NULL THEN CASE WHEN over THEN 'model' ELSE 'rules' END WHEN mine IS NOT NULL THEN 'rules' ELSE 'model' END AS source FROM v)
SELECT doc, field, CASE source WHEN 'model' THEN theirs ELSE mine END AS value, source, CASE source WHEN 'both' THEN 0.85 WHEN 'rules' THEN 0.7 WHEN 'model' THEN 0.8 ELSE 0 END::DOUBLE AS score,
  source = 'none' OR (mine IS NOT NULL AND theirs IS NOT NULL AND source <> 'both') AS needs_review, CASE WHEN mine IS NOT NULL AND theirs IS NOT NULL AND source <> 'both' THEN CASE source WHEN 'model' THEN mine ELSE theirs END END AS other
FROM s""")
def merged_fields(spark, d):
    """Fields of two extractions by a policy table."""
    orders = t(spark, d, "orders")
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey")
    told = lambda f, v, score: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), F.lit(score).alias("score"))
    mine = F.array(
        told("village", F.when(k == 0, " ").otherwise(_text("Town ", c)), 0.7), told("mandal", F.when(k == 3, "the mandal of").when(k != 0, "North"), 0.7),
        told("consideration_amount", F.when(k < 4, "100"), 0.7),
    )
    theirs = F.array(
        told("village", F.when(k == 2, _text("town-", c)).when(k != 1, _text("Place ", c)), 0.8), told("mandal", F.when(k < 5, "South Mandal"), 0.8),
        told("consideration_amount", F.when(k > 2, _text("2", k)), 0.8),
    )
    of = lambda values: orders.select(F.col("o_orderkey").alias("doc"), F.inline(values)).where("value is not null or field = 'mandal' or field = 'consideration_amount'")
    policy = [("village", "rules", None, None), ("mandal", "rules", "(?i)mandal", r"(?i)\s+mandal\b"), ("consideration_amount", "model", None, None)]
    rows = spark.createDataFrame(policy, "field string, wins string, noise string, cut string")
    return merging.merged_extractions(of(mine), of(theirs), rows)
