"""Place resolution against an administrative hierarchy, and dataset checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable
from ..sources.versions import written
from .names import within

# Confidence of each level; words in front of and behind names;
# words that tell the state where none is named.
CONFIDENCE = {"village": 90, "mandal": 70, "district": 50, "state": 30, "other": 30, "ambiguous": 40, "none": 0}
PLACE_PREFIX = r"^(property situated at|situated at|located at|at)\s+"
ORDINAL_PREFIX = r"^(ii|i|iii|iv|v)\b[\s_.,-]*"
AREA_SUFFIX = r"\s+(district|mandal|taluk|taluka|tehsil)$"
ANCHORS = {
    "telangana": (
        "ranga", "rangareddy", "r r", "rr", "medchal", "malkajgiri", "hyderabad", "ghatkesar", "quthbullapur", "keesara", "aushapur", "uppal",
        "shamshabad", "rajendranagar", "serilingampally", "sangareddy", "vikarabad", "secunderabad", "warangal", "khammam", "karimnagar",
        "nizamabad", "mahbubnagar", "nalgonda",
    ),
    "karnataka": (
        "bangalore", "bengaluru", "mandya", "mysore", "mysuru", "tumkur", "tumakuru", "kolar", "hassan", "chikkaballapur", "ramnagara",
        "ramanagara", "bellary", "ballari", "belgaum", "belagavi", "dharwad", "hubli", "shimoga", "shivamogga",
    ),
}
DEFAULT_STATE = "karnataka"


def village_name(c: Column) -> Column:
    """A village's name without the wording of deeds around it."""
    bare = F.regexp_replace(comparable(c), PLACE_PREFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ORDINAL_PREFIX, ""), r"\s+village$", ""))


def area_name(c: Column) -> Column:
    """A district's, mandal's or taluk's name without that word."""
    return F.trim(F.regexp_replace(comparable(c), AREA_SUFFIX, ""))


def states_of(queries: DataFrame, states: DataFrame) -> DataFrame:
    """queries (id, state, district, mandal, village) -> id, state_key.

    A state that is named is a known one spelt with or without blanks, else the
    first known one (in name order) found as words within it, else, for an old
    name, the state that has its records now, else none. Where
    none is named, words of the other places tell it, else the default holds;
    all only for known states. states: (state), a handful of rows."""
    known = states.select(F.lower("state").alias("k")).distinct()
    listed = F.sort_array(F.collect_list("k"))
    table = F.broadcast(known.agg(listed.alias("known")))  # one row: the states there are data for
    plain = F.trim(F.translate(comparable(F.col("state")), "_", " "))
    dense = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    spelt = F.get(F.filter("known", lambda k: dense(k) == dense(plain)), F.lit(0))
    within = F.get(F.filter("known", lambda k: F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(F.lit(" "), F.translate(k, "_", " "), F.lit(" ")))), F.lit(0))
    # records from before the state was divided
    old = plain.contains("andhra") | plain.isin("ap", "a p")
    legacy = F.when(old, F.coalesce(*[F.when(F.array_contains("known", s), s) for s in ("andhra_pradesh", "telangana")]))
    others = F.concat_ws(" ", *[F.coalesce(comparable(F.col(c)), F.lit("")) for c in ("district", "mandal", "village")])
    told = F.lit(None).cast("string")
    for state, words in reversed(ANCHORS.items()):
        here = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(others, w))
        told = F.when(F.array_contains("known", state) & here, state).otherwise(told)
    default = F.when(F.array_contains("known", DEFAULT_STATE), DEFAULT_STATE)
    named = F.coalesce(F.trim("state") != "", F.lit(False))
    return queries.crossJoin(table).select("id", F.when(named, F.coalesce(spelt, within, legacy)).otherwise(F.coalesce(told, default)).alias("state_key"))


def _either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _name_pairs(asked: DataFrame, told: DataFrame) -> DataFrame:
    """(kind, state, asked, told) of names of which one holds the other. An
    asked village that is spelt like a known one meets only that. A mandal is
    met by names that hold it. Distinct names are matched, not rows."""
    names, spots = (x.select("kind", "state", "name").distinct() for x in (asked, told))
    way = lambda x, way, c: x.select("kind", "state", F.lit(way).alias("way"), F.col("name").alias(c))
    some = spots.where("kind <> 'mandal'")
    inner = way(names, "in", "inner").unionByName(way(some, "out", "inner"))
    outer = way(spots, "in", "outer").unionByName(way(names.where("kind <> 'mandal'"), "out", "outer"))
    pairs = within(inner, outer, ["kind", "state", "way"])
    first, second = F.col("inner"), F.col("outer")
    pairs = pairs.select("kind", "state", F.when(F.col("way") == "in", first).otherwise(second).alias("asked"), F.when(F.col("way") == "in", second).otherwise(first).alias("told"))
    spelt = F.max(F.col("asked") == F.col("told")).over(Window.partitionBy("kind", "state", "asked"))
    pairs = pairs.distinct().withColumn("spelt", spelt)
    return written(pairs.where((F.col("kind") != "village") | ~F.col("spelt") | (F.col("asked") == F.col("told"))).drop("spelt"), "name-pairs")


def resolve_places(queries: DataFrame, villages: DataFrame, features: DataFrame) -> DataFrame:
    """queries (id, state, district, mandal, village: as written, state cleaned),
    villages (state, district, old_district, mandal, village, feature), features
    (state, level, district, mandal, feature: level is state, district, mandal
    or taluk) -> id, level, feature, confidence, hierarchy.

    Villages of the exact cleaned name are looked at, or else those of which one
    name holds the other; mandal and district must not contradict. One is the
    village, several are ambiguous whatever else matches. Then the mandal, by
    its name and then by a name that holds it, the district, either way, the
    state, and any feature of the state, each the first in file order.

    Villages, mandals and districts take one way together: their distinct names
    are paired, the pairs lead from queries to places, and one aggregate decides.
    Queries that ask for the same names are decided once, and places that are
    named alike in all count as one row, so their numbers don't multiply."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    q = queries.select(
        "id", "state", F.nullif(village_name(F.col("village")), F.lit("")).alias("q_village"),
        F.nullif(area_name(F.col("mandal")), F.lit("")).alias("q_mandal"), F.nullif(area_name(F.col("district")), F.lit("")).alias("q_district"),
    )
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(f"q_{k}").alias("name")) for k in ("village", "mandal", "district")]
    parts = ["state", "q_village", "q_mandal", "q_district"]
    asked = q.select(*parts).distinct().select(*parts, F.explode(F.array(*kinds)).alias("k")).select("*", "k.*").drop("k").where("name is not null")
    v = villages.select(
        F.lit("village").alias("kind"), "state", "feature", village_name(F.col("village")).alias("name"), filled(area_name(F.col("mandal"))).alias("mandal"),
        area_name(F.col("district")).alias("district"), area_name(F.col("old_district")).alias("old_district"),
    )
    mandal, district = filled(comparable(F.col("mandal"))), filled(comparable(F.col("district")))
    kind = F.when(F.col("level") == "district", "district").when(F.col("level").isin("mandal", "taluk"), "mandal")
    f = features.select(
        kind.alias("kind"), "state", "feature", F.when(kind == "district", district).otherwise(mandal).alias("name"), mandal.alias("mandal"),
        district.alias("district"), F.lit(None).cast("string").alias("old_district"), "level",
    )
    places = v.unionByName(f.drop("level").where("kind is not null")).where("name <> ''")
    # of places that are named alike in all, their first and last feature tell how many there are: none, one or several
    own = ["kind", "state", "name", "mandal", "district", "old_district"]
    places = places.groupBy(*own).agg(F.min("feature").alias("first"), F.max("feature").alias("last"))
    pairs = _name_pairs(asked, places)

    met = asked.withColumnRenamed("name", "asked").join(pairs, ["kind", "state", "asked"])
    met = met.join(places.withColumnRenamed("name", "told"), ["kind", "state", "told"])
    ranga = F.col("q_district").contains("ranga") | F.col("q_district").contains("rr")

    def fits(c: str) -> Column:
        return F.coalesce((F.col(c) != "") & (_either(F.col("q_district"), F.col(c)) | (ranga & F.col(c).contains("ranga"))), F.lit(False))

    in_mandal = F.col("q_mandal").isNull() | (F.col("mandal") == "") | _either(F.col("q_mandal"), F.col("mandal"))
    in_district = F.col("q_district").isNull() | (F.col("district") == "") | _either(F.col("q_district"), F.col("district"))
    fitting = (
        F.when(F.col("kind") == "village", in_mandal & (F.col("q_district").isNull() | fits("district") | fits("old_district")))
        .when(F.col("kind") == "mandal", in_district).otherwise(True)
    )
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    order = F.struct((F.col("told") != F.col("asked")).alias("unlike"), F.col("first").alias("feature"))
    decided = met.where(fitting).groupBy(*parts).agg(
        F.min(of("village", F.col("first"))).alias("village_feature"), F.max(of("village", F.col("last"))).alias("last_village"),
        F.min(of("mandal", order))["feature"].alias("mandal_feature"), F.min(of("district", F.col("first"))).alias("district_feature"),
    ).withColumnsRenamed({c: f"d_{c}" for c in parts})
    by_state = f.groupBy("state").agg(F.min(F.when(F.col("level") == "state", F.col("feature"))).alias("state_feature"), F.min("feature").alias("any_feature"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in parts])
    found = q.join(decided, same, "left").join(by_state, "state", "left")

    has = lambda c: F.col(c).isNotNull()
    single, several = F.col("village_feature") == F.col("last_village"), F.col("village_feature") != F.col("last_village")
    level = (
        F.when(single, "village").when(several, "ambiguous").when(has("mandal_feature"), "mandal")
        .when(has("district_feature"), "district").when(has("state_feature"), "state").when(has("any_feature"), "other").otherwise("none")
    )
    feature = F.when(single, F.col("village_feature")).when(several, None).otherwise(
        F.coalesce("mandal_feature", "district_feature", "state_feature", "any_feature")
    )
    named = F.col("q_village").isNotNull()
    hierarchy = (
        F.when(level == "village", "CONSISTENT").when(level == "ambiguous", "AMBIGUOUS")
        .when(level == "mandal", F.when(named, "PARTIAL").otherwise("CONSISTENT"))
        .when(level.isin("district", "other"), F.when(named | F.col("q_mandal").isNotNull(), "CONTRADICTORY").otherwise("CONSISTENT"))
        .when(level == "state", "PARTIAL").otherwise("NOT_FOUND")
    )
    scores = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    out = found.select("id", level.alias("level"), feature.alias("feature"), hierarchy.alias("hierarchy"))
    # any feature of the state stands for a district, with less confidence
    level = F.when(F.col("level") == "other", "district").otherwise(F.col("level"))
    return out.withColumns({"confidence": scores[F.col("level")].cast("long"), "level": level})


def vertex_centroid(vertices: DataFrame, key: str) -> DataFrame:
    """Mean of all vertices (lng, lat), closing ones counted as they come."""
    return vertices.groupBy(key).agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count("*").alias("vertices"))


def dataset_errors(features: DataFrame, levels: tuple = ("state", "district", "mandal", "taluk")) -> DataFrame:
    """(dataset, feature, error) of features (dataset, feature, level, name,
    state, geometry_type, vertices, lng, lat): what keeps a dataset from being
    taken in. An id that occurs twice is an error of each such feature."""
    twice = F.count("*").over(Window.partitionBy("dataset", "feature")) > 1
    kinds = ("Point", "Polygon", "MultiPolygon")
    missing = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("level").isin(*levels), F.lit(False)), "unknown level"), F.when(missing("name"), "no name"), F.when(missing("state"), "no state"),
        F.when(~F.coalesce(F.col("geometry_type").isin(*kinds), F.lit(False)), "unknown geometry"),
        F.when(F.col("geometry_type").isin("Polygon", "MultiPolygon") & (F.coalesce("vertices", F.lit(0)) < 4), "ring too short"),
        F.when(~F.coalesce(F.col("lng").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False)), "outside the world"),
        F.when(twice, "repeated id"),
    ))
    return features.withColumn("errors", errors).select("dataset", "feature", F.explode("errors").alias("error"))


def onboarding(features: DataFrame, errors: DataFrame, onboarded: DataFrame, force: bool = False, shown: int = 15) -> DataFrame:
    """dataset, features, errors, first (up to `shown` of them), taken: a
    dataset is taken in if it has no error and isn't there already, unless
    forced."""
    n = features.groupBy("dataset").agg(F.count("*").alias("features"))
    said = F.concat_ws(": ", F.col("feature").cast("string"), "error")
    nth = F.row_number().over(Window.partitionBy("dataset").orderBy("feature", "error"))
    few = errors.withColumn("said", said).withColumn("nth", nth).where(F.col("nth") <= shown)
    few = few.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("nth", "said")))["said"].alias("first"))
    counted = errors.groupBy("dataset").agg(F.count("*").alias("errors"))
    there = onboarded.select("dataset", F.lit(True).alias("there")).distinct()
    rows = n.join(counted, "dataset", "left").join(few, "dataset", "left").join(there, "dataset", "left").na.fill({"errors": 0, "there": False})
    return rows.withColumn("taken", (F.col("errors") == 0) & (F.lit(force) | ~F.col("there"))).drop("there")


def state_metadata(notes: Column, state: Column) -> Column:
    """struct(display_name, is_synthetic) of a dataset: it is synthetic if its
    name or its notes say so."""
    said = F.coalesce(F.lower(notes).rlike("synthetic|not real"), F.lit(False)) | F.lower(state).rlike("demo|synthetic")
    return F.struct(F.initcap(F.translate(F.lower(state), "_", " ")).alias("display_name"), said.alias("is_synthetic"))
