"""Duplicate registrations against approved records.

The rule is an OR of conditions; written so it would plan as a nested loop.
Here each branch is an equi-join, the branches are united with a priority, and
the earliest approved record wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_KEYS = ["file_hash", "doc_no", "stamp_no", "village", "survey"]


def _first_two(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first two rows of each group; cut to two before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth <= 2").drop("nth")


def _earliest_others(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group at most six rows, among which is, for any file hash and
    document number, the earliest row that has neither (a null is never equal).
    They are found by sums over the group, one after the other, so nothing of
    its size meets in one place: A is the earliest; B, C and D the earliest with
    another hash, another number, both; E and F stand in for B and C where these
    have the other value of the one who asks."""
    row = F.struct("b_created", "b_id", "b_file_hash", "b_doc_no", "b_mark")
    differs = lambda c, of: ~F.coalesce(F.col(f"b_{c}") == F.col(f"{of}.b_{c}"), F.lit(False))
    keyed = rows.where(" and ".join(f"{c} is not null" for c in by))
    keyed = keyed.withColumn("b_mark", F.coalesce("b_file_hash", F.concat(F.lit("id "), F.col("b_id").cast("string"))))
    a = keyed.groupBy(*by).agg(F.min(row).alias("A"))
    hash_a, doc_a = differs("mark", "A"), differs("doc_no", "A")
    bcd = keyed.join(a, by).groupBy(*by, "A").agg(
        F.min(F.when(hash_a, row)).alias("B"), F.min(F.when(doc_a, row)).alias("C"), F.min(F.when(hash_a & doc_a, row)).alias("D")
    )
    ef = keyed.join(bcd, by).groupBy(*by, "A", "B", "C", "D").agg(
        F.min(F.when(hash_a & differs("doc_no", "B"), row)).alias("E"), F.min(F.when(doc_a & differs("mark", "C"), row)).alias("F")
    )
    few = F.array_distinct(F.array_compact(F.array(*"ABCDEF")))
    return ef.select(*by, F.inline(F.transform(few, lambda r: F.struct(*[r[c].alias(c) for c in ("b_created", "b_id", "b_file_hash", "b_doc_no") if c not in by]))))


def duplicate_of(incoming: DataFrame, approved: DataFrame) -> DataFrame:
    """incoming and approved: id, created, file_hash, doc_no, stamp_no, village,
    survey (normalised, null where absent). Returns id, match_id, reason.
    A pair whose document numbers are equal but whose place differs doesn't go
    on to the stamp rule. Null keys never join, so sentinels form no hot key.

    Rows alike in all five keys are one class. Classes are joined, not rows,
    and carry their two earliest approved records, of which a row is one at
    most itself. A number is represented by the few approved rows of which one
    is the answer for every class (`_earliest_others`), so neither a large group
    of copies nor a number that many classes share makes pairs of its members.
    A class that matches by several rules takes the earliest record."""
    named = F.to_json(F.struct(*_KEYS)).alias("class")  # null keys are left out, so names are exact
    a = incoming.select(named, *_KEYS).distinct().select("class", *[F.col(c).alias(f"a_{c}") for c in _KEYS])
    b = _first_two(approved.select("id", "created", *_KEYS), _KEYS, "created", "id")
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))

    def branch(reason: str, by: list[str], rows: DataFrame, asked, test) -> DataFrame:
        pairs = a.where(asked).join(rows, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]).where(test)
        return pairs.select("class", F.col("b_id").alias("match_id"), F.col("b_created").alias("created"), F.lit(reason).alias("reason"))

    def others(key: str, places: tuple, long: int, reason: str, test) -> list[DataFrame]:
        """A long enough number matches alone, a short one with a place."""
        size = F.length(f"a_{key}")
        found = [branch(reason, [key], _earliest_others(b, [f"b_{key}"]), size >= long, test)]
        for place in places:
            short = b.where(F.length(f"b_{key}") < long)
            found.append(branch(reason, [key, place], _earliest_others(short, [f"b_{key}", f"b_{place}"]), size < long, test))
        return found

    earliest = _first_two(b, ["b_file_hash"], "b_created", "b_id").where("b_file_hash is not null")
    found = branch("file", ["file_hash"], earliest.select("b_file_hash", "b_created", "b_id"), F.lit(True), F.lit(True))
    for part in (
        *others("doc_no", ("village", "survey"), 4, "document", ~same("file_hash")),
        *others("stamp_no", ("village", "survey"), 6, "stamp", ~same("file_hash") & ~same("doc_no")),
    ):
        found = found.unionByName(part)
    best = _first_two(found.distinct(), ["class"], "created", "match_id")
    matched = incoming.select("id", named).join(best, "class").where(F.col("id") != F.col("match_id"))
    top = F.min(F.struct("created", "match_id", "reason")).alias("m")
    return matched.groupBy("id").agg(top).select("id", "m.match_id", "m.reason")


def ranked_best(candidates: DataFrame) -> DataFrame:
    """(doc, field, value, score, page, ordinal) -> the best candidate of each
    field by score, then page, then order of appearance."""
    w = Window.partitionBy("doc", "field").orderBy(F.desc("score"), "page", "ordinal")
    return candidates.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
