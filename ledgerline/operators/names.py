"""Names that lie within other names, by an index of their rarest parts.

A name that lies in another one shares all its parts of three letters with it
(or itself, if shorter). Of these the one that the fewest others have, counted
over all of them, leads to the fewest candidates; the rest is a `contains`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import written

GRAM = 3
HOT = 10_000  # names behind one part in one task


def _grams(c: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.array_distinct(F.transform(F.when(F.length(c) >= size, places), lambda i: F.substring(c, i, size)))


def candidates(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inner, outer) that share the inner name's rarest part. inner:
    (keys, inner), outer: (keys, outer), distinct and not empty. A part that very
    many outer names have is dealt out over tasks."""
    every = F.concat(*[F.coalesce(_grams(F.col("outer"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)])
    parts = outer.select(*keys, "outer", F.explode(every).alias("gram"))
    counted = parts.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    own = inner.select(*keys, "inner", F.explode(_grams(F.col("inner"), F.least(F.length("inner"), F.lit(GRAM)))).alias("gram"))
    met = own.join(counted, [*keys, "gram"], "left")
    rarest = met.groupBy(*keys, "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    # a part that no outer name has: the inner name lies in none
    chosen = rarest.where("m.n > 0").select(*keys, "inner", "m.gram", F.ceil(F.col("m.n") / HOT).cast("int").alias("salts"))
    chosen = written(chosen, "rarest-parts")
    wanted = chosen.select(*keys, "gram", "salts").distinct()
    dealt = parts.join(wanted, [*keys, "gram"]).withColumn("salt", F.pmod(F.xxhash64("outer"), F.col("salts")).cast("int")).drop("salts")
    asked = chosen.select(*keys, "inner", "gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.join(asked, [*keys, "gram", "salt"]).select(*keys, "inner", "outer")


def within(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inner, outer) of inner names that lie in outer ones, equal ones
    included."""
    return candidates(inner, outer, keys).where(F.col("outer").contains(F.col("inner")))
