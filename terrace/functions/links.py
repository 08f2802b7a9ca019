"""Links, addresses, names of files and headers: native columns. Word lists and patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS, first_match, let
from .values import STATE_NAMES, STATES, lookup

HEADER_WORDS = (
    "status lot lots street st no num number land size sizes sqm m2 area floor price prices title titled est estimated building build design designs name facade type types bed beds "
    "bedroom bedrooms bath baths bathroom bathrooms car cars garage contract package packages portal link links suburb estate address frontage storey storeys total totals yield rent "
    "rental house houses furniture date dates stage release avail available availability region state postcode deposit gross net weekly annual comments notes ref code product "
    "completion settlement developer builder agent width depth aspect orientation"
).split()
ASSET_KINDS = (("floorplan", r"floor-plan|floorplan|floor plan"), ("pricelist", r"price|pricing|pricelist"), ("brochure", r"brochure|booklet|flyer|flier|range|inclusions|spec"))
DROPPED_KEYS = ("pli", "authuser", "usp", "urp", "hl", "rtpof", "sd", "ts", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "_hsmi", "_hsenc")


def link_kind(url: Column, anchor: Column) -> Column:
    both = F.concat_ws(" ", anchor, url)
    return F.when(both.rlike(r"(?i)floor\s*-?\s*plan|floorplan|site\s*plan"), "floorplan_url").when(both.rlike(r"(?i)brochure|flyer|booklet|fact\s*sheet|spec\w*sheet"), "brochure_url").otherwise("listing_url")


def asset_kind(text: Column, url: Column) -> Column:
    both, out = F.lower(F.concat_ws(" ", text, url)), F.lit("brochure")
    for kind, pattern in reversed(ASSET_KINDS):
        out = F.when(both.rlike(pattern), kind).otherwise(out)
    return out


def registrable(host: Column) -> Column:
    h = F.split_part(F.lower(host), F.lit(":"), F.lit(1))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    three = (n >= 3) & F.get(labels, n - 2).isin("com", "net", "org", "gov", "edu") & (F.length(F.get(labels, n - 1)) == 2)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return F.when(F.regexp_replace(h, r"\.", "").rlike(r"^\d+$") | (h == "localhost"), h).when(three, last(3)).otherwise(last(2))


def file_key(url: Column) -> Column:
    """One key for every spelling of one file: tracking keys go, a tab in the fragment joins the query, view suffixes go, keys are sorted."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, r"^([A-Za-z][\w+.-]*)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", ""), r"(?i)/(edit|export|view|preview|htmlview|pub)$", "")
    query, tab = F.regexp_extract(u, r"\?([^#]*)", 1), F.regexp_extract(u, r"#gid=(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*DROPPED_KEYS))
    pairs = F.when((tab != "") & ~F.exists(pairs, lambda p: F.lower(p).startswith("gid=")), F.concat(pairs, F.array(F.concat(F.lit("gid="), tab)))).otherwise(pairs)
    text = F.array_join(F.array_sort(pairs), "&")
    return F.when(host == "", F.lower(u)).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")))


def address_tail(c: Column) -> dict[str, Column]:
    """postcode, state, suburb, label and street of an address, read from its end. Parts that can't be told are null."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")

    def cut(p: Column) -> Column:
        code = F.get(p, F.size(p) - 1).rlike(r"^\d{4}$")
        post = F.when(code, F.get(p, F.size(p) - 1))
        rest = F.when(code, F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
        return let(rest, lambda r: let(F.upper(F.get(r, F.size(r) - 1)), lambda tail: before_code(post, r, tail)))

    def before_code(post: Column, rest: Column, tail: Column) -> Column:
        st = F.coalesce(F.when(tail.isin(*STATES), tail), lookup(F.lower(tail), STATE_NAMES))
        return let(st, lambda state: before_state(post, rest, state))

    def before_state(post: Column, rest: Column, st: Column) -> Column:
        rest2 = F.when(st.isNotNull(), F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        return let(rest2, lambda r: place_of(post, st, r))

    def place_of(post: Column, st: Column, rest2: Column) -> Column:
        suburb = F.get(rest2, F.size(rest2) - 1)
        head = F.slice(rest2, F.lit(1), F.greatest(F.size(rest2) - 1, F.lit(0)))
        lab = F.get(head, F.lit(0)).rlike(r"(?i)^\s*(lot|unit)\b")
        label = F.when(lab, F.get(head, F.lit(0)))
        street = F.array_join(F.when(lab, F.slice(head, F.lit(2), F.size(head))).otherwise(head), ", ")
        return F.struct(post.alias("postcode"), st.alias("state"), suburb.alias("suburb"), label.alias("label"), F.nullif(street, F.lit("")).alias("street"))

    s = let(parts, cut)
    return {k: s[k] for k in ("postcode", "state", "suburb", "label", "street")}


def counter(c: Column) -> dict[str, Column]:
    """``Name (a/b)``: name, available, total."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    p = r"\s*\(\s*(\d+)\s*/\s*(\d+)\s*\)\s*$"
    return {"name": F.coalesce(F.nullif(F.trim(F.regexp_replace(t, p, "")), F.lit("")), t), "available": first_match(t, p, 1).cast("int"), "total": first_match(t, p, 2).cast("int")}


def display_address(c: Column) -> Column:
    """An address without dates, money, long and decimal numbers; never emptied."""
    t = F.trim(c)
    out = t
    for p in (
        r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\b", r"\$\s?\d[\d,]*(?:\.\d+)?", rf"(?i)\b(?:{MONTHS}|sept)[a-z]*[\s\-/]*\d{{2,4}}\b", r"(?i)\bQ[1-4][\s\-/]*\d{2,4}\b",
        r"(?<![\w$])\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{1,2}(?![\w/])", r"(?<![\w$.,/-])\d{5,}(?![\w./-])", r"(?<![\w$/-])\d{1,4}\.\d{1,2}(?![\w/-])",
    ):
        out = F.regexp_replace(out, p, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*([,;:|])\s*(?=[,;:|])", ""), r"\s{2,}", " ")
    out = F.trim(F.regexp_replace(out, r"^[\s,;:|/\-]+|[\s,;:|/\-]+$", ""))
    return F.when(out.rlike("[A-Za-z]"), out).otherwise(t)


def is_column_header(c: Column) -> Column:
    """A row of column names: no amount; all words known (two or more), or four words and six tenths of them known."""
    w = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z']*)"), 1), lambda x: F.length(x) > 1)
    known = F.size(F.filter(w, lambda x: x.isin(*HEADER_WORDS)))
    n = F.size(w)
    return ~c.rlike(r"\$\s*\d") & (n > 0) & (((known == n) & (n >= 2)) | ((n >= 4) & (known / F.greatest(n, F.lit(1)) >= 0.6)))


def is_group_header(c: Column) -> Column:
    return ~c.rlike(r"\$\s*\d") & ~c.rlike(r"(?i)\blot\s*\d+") & (F.length(c) > 0) & (F.length(c) < 90) & (F.length(F.regexp_replace(c, r"[^0-9]", "")) <= 4)


def is_price_fragment(c: Column) -> Column:
    """Amounts broken out of a listing: no words of its own, one other figure at most."""
    bare = F.regexp_replace(c, r"\$\s*\d[\d,]*(?:\.\d+)?", " ")
    words = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(land|build|building|house|package|total|price|prices|from|inc|incl|gst|deposit|balance|rrp|est|approx|only|now|was|save|saving|plus)\b", " "), "[^A-Za-z]", "")
    return (F.length(words) < 4) & (F.size(F.regexp_extract_all(bare, F.lit(r"(\d+(?:\.\d+)?)"), 1)) <= 1)


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("builder"))


def file_state(name: Column) -> Column:
    """The state that a file's name holds."""
    return first_match(F.upper(F.regexp_replace(F.url_decode(name), r"[_\-.]+", " ")), r"\b(VIC|NSW|QLD|SA|WA|NT|ACT|TAS)\b")
