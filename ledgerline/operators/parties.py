"""Parties: the line of a deed that names one, and names that are one party's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import party_confidence
from ..functions.text import core_tokens


def party_lines(parties: DataFrame, lines: DataFrame) -> DataFrame:
    """parties (doc, party, name, representative, given, corrected), lines (doc,
    ordinal, page, text, score) -> doc, party, found_by, ordinal, page, line,
    score, needs_review of every party.

    Three passes, each over the parties that those before left: the first line
    that holds the name; the first that holds the representative's; the line of
    most words of the name that are longer than three letters, the first of
    several. A party that no pass finds has no line and less confidence. Blank
    names are no party. A document's lines fit a row."""
    named = parties.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    line = F.struct("ordinal", "page", F.col("text").alias("line"), F.col("score").alias("line_score"), F.lower("text").alias("low"))
    # sorted by document on both sides: small files can hold more lines than a driver can broadcast
    told = lines.groupBy(F.col("doc").alias("of")).agg(F.collect_list(line).alias("said"))
    rows = named.join(told.hint("merge"), F.col("doc") == F.col("of"), "left")

    def holding(c: str) -> Column:
        asked = F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
        return F.array_min(F.filter("said", lambda x: F.contains(x["low"], asked)))

    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3))
    shared = lambda x: F.size(F.filter("words", lambda w: F.contains(x["low"], w)))
    met = F.transform("said", lambda x: F.struct(shared(x).alias("n"), (-x["ordinal"]).alias("before"), x.alias("s")))
    most = F.array_max(F.filter(met, lambda x: x["n"] > 0))["s"]
    # a later pass is computed only where those before found nothing
    by = lambda name, m: F.when(m.isNotNull(), F.struct(F.lit(name).alias("found_by"), m.alias("m")))
    rows = rows.withColumn("words", words)
    rows = rows.withColumn("found", F.coalesce(by("name", holding("name")), by("representative", holding("representative")), by("words", most)))
    rows = rows.select("*", "found.found_by", "found.m")
    sure = party_confidence(F.col("given"), F.col("m.line_score"), F.coalesce("corrected", F.lit(False)))
    return rows.select("doc", "party", F.coalesce("found_by", F.lit("none")).alias("found_by"), "m.ordinal", "m.page", "m.line", sure["score"].alias("score"), sure["needs_review"].alias("needs_review"))


_GROUPS = "array<struct<tokens: array<string>, members: array<int>>>"


def entity_groups(names: Column) -> Column:
    """array<struct<tokens, members>> of an array of names: each name in turn
    joins the first group whose first name shares a core word with it, else it
    begins one. A name without core words is a group of its own. `members` are
    places in the array, from 0; a fold, since a name may fit several groups."""
    items = F.transform(names, lambda x, i: F.struct(i.alias("i"), core_tokens(F.coalesce(x, F.lit(""))).alias("t")))

    def step(groups: Column, x: Column) -> Column:
        fits = F.transform(groups, lambda g: F.arrays_overlap(g["tokens"], x["t"]))
        at = F.array_position(fits, True)
        joined = F.transform(groups, lambda g, k: F.struct(g["tokens"].alias("tokens"), F.when(k + 1 == at, F.concat(g["members"], F.array(x["i"]))).otherwise(g["members"]).alias("members")))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(F.struct(x["t"].alias("tokens"), F.array(x["i"]).alias("members")))))

    return F.aggregate(items, F.array().cast(_GROUPS), step)


def reconciled(candidates: DataFrame) -> DataFrame:
    """(doc, ordinal, name, representative, score) -> doc, name, representative,
    groups, conflict, names: the party that a document's candidates speak of.

    Names of one party are grouped (`entity_groups`, in order); the group of
    the highest sum of scores holds, the first of several; of it the candidate
    with a representative, then of most confidence, then the first. Without a
    representative of its own it takes the group's first. Several groups are a
    conflict, and their first names are listed. A document's candidates are few
    and fit a row."""
    item = F.struct("ordinal", "name", F.nullif(F.trim("representative"), F.lit("")).alias("representative"), "score")
    rows = candidates.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("c"))
    rows = rows.withColumn("g", entity_groups(F.col("c.name")))
    of = lambda members: F.transform(members, lambda i: F.get(F.col("c"), i))
    weight = lambda members: F.aggregate(of(members), F.lit(0.0), lambda s, x: s + x["score"])
    weighed = F.transform("g", lambda g, k: F.struct(F.round(weight(g["members"]), 9).alias("w"), (-k).alias("k"), g["members"].alias("m")))
    rows = rows.withColumn("own", of(F.array_max(weighed)["m"]))
    rank = F.transform("own", lambda x: F.struct(x["representative"].isNotNull().alias("r"), x["score"].alias("s"), (-x["ordinal"]).alias("o"), x["name"].alias("name"), x["representative"].alias("p")))
    best = F.array_max(rank)
    other = F.get(F.filter("own", lambda x: x["representative"].isNotNull()), F.lit(0))["representative"]
    firsts = F.transform("g", lambda g: F.get(F.col("c"), g["members"][0])["name"])
    several = F.size("g") > 1
    return rows.select(
        "doc", best["name"].alias("name"), F.coalesce(best["p"], other).alias("representative"), F.size("g").alias("groups"), several.alias("conflict"),
        F.when(several, firsts).otherwise(F.array().cast("array<string>")).alias("names"),
    )
