"""Distance joins. Points are put in grid cells as wide as the radius, so a radius join is an equi-join on nine cells with an exact test behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import haversine_km

KM_PER_DEGREE = 111.19
#: Origins of a search; a list of localities typed by hand.
MAX_ORIGINS = 10_000


def km(a: str, b: str) -> Column:
    return haversine_km(F.col(f"{a}lat"), F.col(f"{a}lng"), F.col(f"{b}lat"), F.col(f"{b}lng"))


def within_radius(places: DataFrame, origins: DataFrame, radius_km: float | None) -> DataFrame:
    """places (id, lat, lng, ...) with the nearest origin and its distance; those beyond the radius go. Without a radius every place meets
    every origin, which is for a short list of origins only."""
    o = origins.select(F.col("id").alias("origin"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    if radius_km is None:
        if origins.limit(MAX_ORIGINS + 1).count() > MAX_ORIGINS:
            raise ValueError("too many origins for a search without a radius")
        pairs = places.join(F.broadcast(o), F.lit(True))
    else:
        step = radius_km / KM_PER_DEGREE
        row = lambda c: F.floor(F.col(c) / step)
        # a degree of longitude shrinks with latitude; cells are as wide as the radius at the band's far edge
        wide = lambda lat: step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), (F.abs(F.floor(F.col(lat) / step)) + 2) * step))))
        near = o.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("dy")).withColumn("cy", row("o_lat") + F.col("dy"))
        span = step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), (F.abs(F.col("cy")) + 2) * step))))
        near = near.withColumn("cx0", F.floor(F.col("o_lng") / span)).select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("dx")).withColumn("cx", F.col("cx0") + F.col("dx")).drop("dx", "dy", "cx0")
        cells = places.withColumn("cy", row("lat")).withColumn("cx", F.floor(F.col("lng") / wide("lat")))
        pairs = cells.join(near, ["cy", "cx"]).drop("cy", "cx")
    pairs = pairs.withColumn("km", haversine_km(F.col("o_lat"), F.col("o_lng"), F.col("lat"), F.col("lng")))
    if radius_km is not None:
        pairs = pairs.where(F.col("km") <= radius_km)
    best = pairs.groupBy("id").agg(F.min(F.struct("km", "origin")).alias("_b"))
    return places.join(best, "id").select(*places.columns, "_b.km", "_b.origin")
