"""Stocklist rows to listings: each row's facts are columns, computed in steps so that none is computed twice; localities meet a gazetteer in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows as r
from ..functions.links import is_column_header, is_price_fragment
from ..functions.listing import STREET, WALL
from ..functions.text import clean, features, lot_number, specs
from .places import gazetteer_side

FIELDS = ("price", "land_price", "build_price", "price_confidence", "bedrooms", "bathrooms", "car_spaces", "land_size_sqm", "house_size_sqm", "lot_address", "title_status", "suburb", "state")
FILLED = ("bedrooms", "land_size_sqm", "suburb", "house_size_sqm")


def _located(df: DataFrame, gaz: DataFrame, key: str, places: Column, state: Column, pick) -> DataFrame:
    """key, locality: of a row's places (at, name) that the gazetteer knows (in the state, if there is one) the one that ``pick`` takes by position."""
    e = df.select(F.col(key), F.nullif(F.upper(F.trim(state)), F.lit("")).alias("_st"), F.explode(places).alias("p"))
    known = (F.lower(F.col("p.name")) == F.col("g_key")) & (F.col("_st").isNull() | (F.col("_st") == F.upper("g_state")))
    hit = e.join(gazetteer_side(gaz), known, "left_semi")
    return hit.groupBy(key).agg(pick(F.col("p.name"), F.col("p.at")).alias("_name")).select(key, r.titled(F.col("_name")).alias("locality"))


def banner_localities(df: DataFrame, gaz: DataFrame, key: str, banner: str, state: Column | None = None) -> DataFrame:
    """key, locality: the last segment of a banner that as a whole is a locality, since an address ends with its own. ``key`` has to be unique."""
    return _located(df, gaz, key, r.banner_places(F.col(banner)), F.lit(None).cast("string") if state is None else state, F.max_by)


def with_fields(df: DataFrame, text: str, gaz: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """df with the facts of a card or row (``FIELDS``; they replace columns of these names, whatever their case). With a gazetteer and a unique key, a row
    without a state's code takes the first of its first six lines that is a suburb's name. A null text has no facts."""
    t = F.col(text)
    out = df.withColumn("_said", r.stated_prices(t)).withColumn("_size", r.sizes(t)).withColumn("_rooms", r.rooms(t)).withColumn("_place", r.place_and_state(t)).withColumn("_price", r.price_fields(t, F.col("_said")))
    at_lot = F.get(F.filter(r.lines(t), lambda x: x.rlike(r.LOT)), F.lit(0))
    out = out.select(
        *[c for c in df.columns if c.lower() not in FIELDS], "_price.*", "_rooms.*", F.col("_size.land").alias("land_size_sqm"), F.col("_size.house").alias("house_size_sqm"),
        F.left(at_lot, F.lit(120)).alias("lot_address"), r.title_status(t).alias("title_status"), "_place.*",
    )
    if gaz is None or key is None:
        return out
    # from df, so that only what the filter needs is read again
    named = _located(df.where(r.place_and_state(t)["suburb"].isNull()).select(key, text), gaz, key, r.lines_like_places(t), F.lit(None).cast("string"), F.min_by)
    return out.join(named, key, "left").withColumn("suburb", F.coalesce("suburb", "locality")).drop("locality")


def _no_listing(text: Column, lot: Column, beds: Column, land: Column) -> Column:
    """Whether a priced row with these facts is a fragment or a wall of prices; a lot, a street or rooms make it a listing."""
    line = F.coalesce(text, F.lit(""))
    told = lot.isNotNull() | line.rlike(STREET) | (F.coalesce(beds, F.lit(0)) > 0)
    fragment = is_price_fragment(line) & ~(F.coalesce(land, F.lit(0)) > 0)
    wall = (F.size(F.regexp_extract_all(line, F.lit(rf"({r.AMOUNT})"), 1)) >= WALL) & r.leading_lot(line).isNull()
    return ~told & (fragment | wall)


def judged_again(df: DataFrame, text: str) -> DataFrame:
    """df with ``reason`` (it replaces a column of that name): why today's reader would not take a stored row for a listing; empty where it would, or where
    there is no text to judge. The tests are those that ``to_listings`` makes."""
    t = F.col(text)
    refused = r.price_fields(t, r.stated_prices(t))["price"].isNull() | _no_listing(t, lot_number(t), F.coalesce(specs(t)["bedrooms"], r.rooms(t)["bedrooms"]), r.sizes(t)["land"])
    reason = F.when(F.coalesce(t, F.lit("")) == "", "").when(is_column_header(t), "a column header").when(refused, "no longer a listing").otherwise("")
    return df.withColumn("reason", reason)


def to_listings(df: DataFrame, gaz: DataFrame, key: str, text: str, context: str, links: str | None = None) -> DataFrame:
    """A listing for every row that is one: it has a price, and is neither a fragment nor a wall of prices. Facts stated in the row beat those of the banner
    above it (``context``); the label beats the raw row as address. ``links``, if given, is an array of (anchor, url)."""
    t, above = F.col(text), F.col(context)
    kept = list(dict.fromkeys([key, text, context, *([links] if links else [])]))
    out = with_fields(df.select(*kept), text, gaz, key).where("price IS NOT NULL")
    more = features(t, above, F.col("price"))
    out = out.withColumns({f"_f_{k}": v for k, v in more.items()})
    beaten = {k: F.coalesce(F.col(f"_f_{k}"), F.col(k)) if k in out.columns else F.col(f"_f_{k}") for k in more}
    out = out.withColumns(beaten).drop(*[f"_f_{k}" for k in more])
    out = out.where(~_no_listing(t, F.col("lot_number"), F.col("bedrooms"), F.col("land_size_sqm"))).withColumn("estate_name", F.coalesce("estate_name", r.banner_estate(above)))
    out = out.withColumn("lot_address", F.coalesce(r.address_label(t, F.col("lot_number"), F.col("estate_name")), F.nullif(F.col("lot_address"), F.lit("")), F.left(clean(t), F.lit(110))))
    place = df.select(key, context, r.place_and_state(t).alias("_place")).where("_place.suburb IS NULL")  # from df, so that nothing else is read again
    banner = banner_localities(place, gaz, key, context, F.col("_place.state"))
    out = out.join(banner, key, "left").withColumn("suburb", F.coalesce("suburb", "locality")).drop("locality")
    filled = sum((F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0").cast("int") * -1 + 1 for c in FILLED), F.lit(0))
    out = out.withColumn("estate_context", F.left(clean(above), F.lit(110))).withColumn("extraction_confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.12 * filled), 2))
    return out.withColumn(links, r.first_links(F.col(links))) if links else out


def builders_of_files(df: DataFrame, file: str, banner: str, label: str) -> DataFrame:
    """file, builder, project: the company in a file's own title row and the development in its name; empty where they name none. One row per file."""
    return df.groupBy(file).agg(F.min(banner).alias("_b"), F.min(label).alias("_l")).select(file, r.builder_of_banner(F.col("_b")).alias("builder"), r.project_of_file(F.col("_l")).alias("project"))
