"""What a published snapshot carries beside its rows: completions of place names, and figures about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Completions of a prefix, and how many letters a prefix has at most.
MOST, LETTERS = 8, 6


def held(places: DataFrame, listings: DataFrame, live: Column) -> DataFrame:
    """places (suburb, state) with ``listings``: how many live rows each holds, by name and state whatever the case; listings are counted before they are joined."""
    key = lambda c: F.lower(F.trim(c))
    n = listings.where(live).groupBy(key("suburb").alias("_s"), F.upper(F.trim("state")).alias("_t")).agg(F.count("*").alias("listings"))
    j = places.join(n, (key(F.col("suburb")) == F.col("_s")) & (F.upper(F.trim(F.col("state"))) == F.col("_t")), "left")
    return j.select(*[places[c] for c in places.columns], F.coalesce("listings", F.lit(0).cast("long")).alias("listings"))


def completions(places: DataFrame, most: int = MOST, letters: int = LETTERS) -> DataFrame:
    """prefix, place, suburb, state, listings: of the names that begin with a prefix those with most listings, then by name. places: suburb, state, listings.
    The limit on the rank is kept on the map side too, so of a prefix that very many names share each task hands on ``most`` rows."""
    name = F.lower(F.trim("suburb"))
    each = places.where(F.length(F.trim("suburb")) > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.length(name), F.lit(letters)))))
    rows = each.select(F.substring(name, F.lit(1), F.col("n")).alias("prefix"), "suburb", "state", "listings")
    rank = Window.partitionBy("prefix").orderBy(F.col("listings").desc(), F.lower("suburb"), "suburb", "state")
    return rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most)


def figures(df: DataFrame, reason: str) -> DataFrame:
    """key, n: total rows, named, companies, with a state, with a suburb, and rows per ``reason``; one pass, partial sums on the map side."""
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    total = df.agg(F.count("*").alias("total"), F.count_if(said("builder_name")).alias("named"), F.count_distinct(F.when(said("builder_name"), F.trim("builder_name"))).alias("builders"), F.count_if(said("state")).alias("with_state"), F.count_if(said("suburb")).alias("with_suburb"))
    keys = total.columns
    one = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("n")) for k in keys])).alias("x")).select("x.*")
    return one.unionByName(df.groupBy(F.concat(F.lit(f"{reason}: "), F.coalesce(reason, F.lit("none"))).alias("key")).agg(F.count("*").alias("n")))
