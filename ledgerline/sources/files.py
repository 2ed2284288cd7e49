"""File sources and sinks: JSON stores, GeoJSON collections, COPY text, result
caches and appended logs. Readers and writers are Spark's own, so paths can be
in any store it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import ring_geometry
from . import versions


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of fewer partitions than there are cores, dealt out by a key: for
    much work on each row of a small file, which one task would read and do.
    Larger inputs have partitions enough and aren't moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def read_json_store(spark: SparkSession, path: str, schema: StructType | str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A multi-line JSON store, or what `write_json_store` has stored last;
    malformed content raises. Columns in `defaults` take that where the store
    has null."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    there = versions.versions(spark, path)
    rows = reader.json(versions.folder(path, there[-1])) if there else reader.option("multiLine", True).json(path)
    return rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})


def read_store_map(spark: SparkSession, path: str, value: str, key: str) -> DataFrame:
    """A JSON store that is one object, record by id: a row per record."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", f"map<string, {value}>", {"mode": "FAILFAST"}))
    return text.select(entries.alias(key, "record")).select(key, "record.*")


def write_json_store(rows: DataFrame, path: str) -> None:
    """Replaces a store by a new version, so `rows` may read the store itself,
    and readers see all of the old rows or all of the new ones."""
    versions.commit(rows, path, form="json")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines, or to what `write_json_store` has
    stored last at that path."""
    there = versions.versions(rows.sparkSession, path)
    rows.write.mode("append").json(versions.folder(path, there[-1]) if there else path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of (gzipped or plain) FeatureCollections."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.select(F.posexplode("features").alias("feature_idx", "f")).select("feature_idx", "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates_json"))


def read_villages(spark: SparkSession, path: str, aliases: dict[str, tuple], needed: tuple) -> DataFrame:
    """Features of a raw extract under names of our own: each is the first of
    some property names that isn't blank. Rows that lack a needed one go."""
    props = read_geojson(spark, path)
    named = {k: F.coalesce(*[F.nullif(F.trim(F.try_element_at("properties", F.lit(n))), F.lit("")) for n in names]) for k, names in aliases.items()}
    rows = props.select("feature_idx", *[c.alias(k) for k, c in named.items()])
    return rows.dropna(subset=list(needed))


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (objectid, rings) as geometries, each objectid once."""
    rows = spark.read.schema("objectid long, rings array<array<array<double>>>").json(path)
    return rows.dropDuplicates(["objectid"]).select("objectid", ring_geometry(F.col("rings")).alias("geometry"))


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """(search_key, state) of the folders below `path` that hold GeoJSON: each
    by its name with blanks, with underscores and with neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(path).select("path")
    folder = F.element_at(F.split("path", "/"), -2)
    names = files.select(F.lower(folder).alias("slug")).distinct()
    keys = F.array_distinct(F.array("slug", F.translate("slug", "_", " "), F.regexp_replace("slug", "[^a-z0-9]", "")))
    return names.select(F.explode(keys).alias("search_key"), F.upper("slug").alias("state"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(field, ground_truth, extracted, confidence, needs_review) of a
    comparison: a JSON object of fields."""
    value = "struct<ground_truth: string, extracted: string, confidence: double, needs_review: boolean>"
    return read_store_map(spark, path, value, "field")


def read_ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """(page, ordinal, text, confidence) of stored recognition results."""
    schema = "page int, ocr_elements array<struct<text: string, confidence: double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("page", F.posexplode("ocr_elements").alias("ordinal", "e")).select("page", (F.col("ordinal") + 1).alias("ordinal"), "e.*")


def text_lines(pages: DataFrame, least: int = 120, top: int = 50, step: int = 20) -> DataFrame:
    """(doc, page, text) of digital documents -> (doc, page, line_no, text,
    y_min, y_max) of lines that say something, spread evenly down the page.
    Documents of fewer than `least` characters in all have no text layer."""
    sizes = pages.groupBy("doc").agg(F.sum(F.length(F.trim("text"))).alias("chars")).where(F.col("chars") >= least)
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    lines = pages.join(sizes.select("doc"), "doc").select("doc", "page", F.posexplode(kept).alias("at", "text"))
    y = F.lit(top) + F.col("at") * step
    return lines.select("doc", "page", (F.col("at") + 1).alias("line_no"), F.trim("text").alias("text"), y.alias("y_min"), (y + step - 4).alias("y_max"))


def read_copy_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated COPY text: \\N is null; tabs, line ends and backslashes
    are unescaped; a line with another number of fields raises."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value") != "\\.")
    arity = F.when(F.size(fields) == len(columns), fields).otherwise(F.raise_error(F.lit("COPY row with a wrong number of fields")))

    def decoded(c):
        plain = c
        for mark, char in ((r"\\\\", "\u0000"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), ("\u0000", r"\\")):
            plain = F.regexp_replace(plain, mark, char)
        return F.when(c != "\\N", plain)

    return rows.select(arity.alias("f")).select(*[decoded(F.col("f")[i]).alias(n) for i, n in enumerate(columns)])


def typed(rows: DataFrame, booleans: tuple = (), json: dict[str, str] | None = None, binary: tuple = ()) -> DataFrame:
    """COPY columns in their types: t and f, JSON of a given schema, and bytes
    written as \\x and hex digits or as text."""
    out = {c: F.col(c) == "t" for c in booleans}
    out |= {c: F.from_json(c, schema, {"mode": "FAILFAST"}) for c, schema in (json or {}).items()}
    out |= {c: F.when(F.col(c).startswith("\\x"), F.unhex(F.substring(c, 3, 2**31 - 1))).otherwise(F.encode(c, "UTF-8")) for c in binary}
    return rows.withColumns(out)
