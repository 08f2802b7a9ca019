"""Columns that judge and present a listing: walls of prices, lots, document titles, suburbs. Patterns and word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .links import is_column_header, is_price_fragment
from .text import amounts, clean, let, lot_number, price_first, specs
from .values import STATE_NAMES, STATES

# --- fixed values ---
STREET = (
    r"\b\d+[A-Za-z]?(?:[/-]\d+[A-Za-z]?)?\s+[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+)?\s+(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Crescent|Cres|Way|"
    r"Circuit|Cct|Parade|Pde|Boulevard|Blvd|Terrace|Tce|Close|Cl|Lane|Ln|Grove|Gr|Rise|Loop|Esplanade|Esp|Walk|Mews|Green)\b\.?"
)
GENERIC_TITLES = (
    "download brochure", "download floorplan", "download", "brochure", "floorplan", "floorplans", "specification", "specifications", "download specification", "view brochure", "view floorplan", "download pdf", "pdf", "more info",
    "view full terms and conditions", "terms and conditions", "download flyer", "flyer",
)
TRAILING_CALL = r"(?i)[\s\-–—:|]*\b(?:download|view)?\s*(?:brochure|floorplans?|specifications?|flyer|pdf)\s*$"
FILE_JUNK = r"(?i)^\d{6,8}[-_]?|[-_](?:v?\d+|final|web|lr|hr|copy|updated)$"
WALL = 5


def wall_of_prices(c: Column) -> Column:
    """Five amounts or more and nothing that identifies a property: a summary or a table on its side."""
    return let(clean(c), _is_wall)


def _is_wall(t: Column) -> Column:
    own = lot_number(t).isNotNull() | specs(t)["bedrooms"].isNotNull() | t.rlike(STREET) | t.rlike(r"^\d{1,5}[A-Za-z]?\s+[A-Za-z]{3,}")
    return (F.size(F.regexp_extract_all(t, F.lit(r"(\$\s?[\d,.]+)"), 1)) >= WALL) & ~own


def judge(c: Column) -> Column:
    """Why a stored line would not be read as a listing today; empty if it would, or if there is nothing to judge."""
    return let(clean(c), lambda t: _judged(c, t))


def _judged(c: Column, t: Column) -> Column:
    priced = price_first(t).isNotNull() | (F.size(amounts(t)) > 0)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(is_column_header(t), "a column header")
        .when(~priced, "no price")
        .when(is_price_fragment(t) & lot_number(t).isNull() & ~t.rlike(STREET), "a fragment of prices")
        .when(wall_of_prices(t), "a wall of prices")
        .otherwise("")
    )


def bare_lot(c: Column) -> Column:
    """``00000014/00000014`` to ``14``; null if nothing is left."""
    return F.nullif(F.ltrim(F.trim(F.split_part(c, F.lit("/"), F.lit(1))), F.lit("0")), F.lit(""))


def document_title(title: Column, url: Column) -> Column:
    """A title that tells one document from another: the given one without its call to action, else the file's own name."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    t = F.when(t.rlike(r"(?i)\bicons?\b"), "").otherwise(t)
    generic = lambda x: F.lower(x).isin(*GENERIC_TITLES)
    short = F.regexp_replace(F.regexp_replace(t, TRAILING_CALL, ""), r"^[ \-–—:|]+|[ \-–—:|]+$", "")
    path = F.regexp_replace(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), r"/+$", "")
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(pdf|docx?|xlsx?|jpe?g|png)$", "")
    name = F.trim(F.regexp_replace(F.translate(F.regexp_replace(name, FILE_JUNK, ""), "-_", "  "), r"\s+", " "))
    name = F.when(F.lower(name) == name, F.initcap(name)).otherwise(name)
    own = F.when((F.length(short) > 3) & ~generic(short), short).otherwise(t)
    return F.when((t != "") & ~generic(t), own).when(name.rlike("[A-Za-z]{3}"), name).otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("Untitled document")))


def display_suburb(suburb: Column, address: Column) -> Column:
    """The suburb, or where a state stands in its place the one that the address names before its state and postcode."""
    stored = F.trim(F.coalesce(suburb, F.lit("")))
    is_state = lambda x: F.upper(x).isin(*STATES, *[n.upper() for n in STATE_NAMES])
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    code = F.get(parts, F.size(parts) - 1).rlike(r"^\d{4}$").cast("int")
    last = F.size(parts) - 1 - F.coalesce(code, F.lit(0))
    last = last - F.coalesce(is_state(F.get(parts, F.greatest(last, F.lit(0)))).cast("int"), F.lit(0))
    named = F.when(last >= 0, F.get(parts, F.greatest(last, F.lit(0))))
    fits = (F.size(parts) >= 2) & named.isNotNull() & ~is_state(named) & ~named.rlike(r"^\d+\s")
    return F.when(is_state(stored) & F.coalesce(fits, F.lit(False)), F.initcap(named)).otherwise(stored)
