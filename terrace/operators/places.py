"""Localities and states: what a row's text says, checked against a gazetteer. Candidates are built per row and meet the gazetteer in one join.

A gazetteer (suburb, state, lat, lng) is some tens of thousands of rows; ``gazetteer_side`` broadcasts it only up to ``MAX_GAZETTEER``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import state_name, state_of_postcode

MAX_GAZETTEER = 200_000
#: Words that end a street's name (fixed values).
STREET_TYPES = (
    "st", "street", "rd", "road", "dr", "drive", "ave", "avenue", "av", "cres", "crescent", "cct", "circuit", "pde", "parade", "way", "wy", "ct", "court", "cl", "close", "pl", "place", "blvd", "boulevard", "tce", "terrace",
    "gr", "grove", "gve", "lane", "ln", "esp", "esplanade", "hwy", "highway", "mews", "walk", "loop", "link", "vista", "gdns", "gardens",
)
STATED, COMPOSITE, POSTCODE, ADDRESS = "stated", "composite", "postcode", "address"
LOCATED = (STATED, COMPOSITE, POSTCODE, ADDRESS)


def gazetteer_side(gaz: DataFrame) -> DataFrame:
    g = gaz.select(F.lower(F.trim("suburb")).alias("g_key"), F.col("suburb").alias("g_name"), F.col("state").alias("g_state")).dropDuplicates(["g_key", "g_state"])
    return F.broadcast(g) if gaz.limit(MAX_GAZETTEER + 1).count() <= MAX_GAZETTEER else g


def lookups(gaz: DataFrame) -> dict[str, DataFrame]:
    """What a gazetteer (suburb, state, lat, lng) answers, a table each: ``points`` of (key, state), ``by_state`` (each state's localities with their points), ``states``
    of a key, with ``only`` where there is one, and the one spelling (``names``) of a key. Keys are lower-cased; of repeated rows the smallest counts."""
    g = gaz.select(F.lower(F.trim("suburb")).alias("key"), F.trim("suburb").alias("suburb"), F.upper(F.trim("state")).alias("state"), "lat", "lng").where("key <> '' AND state <> ''")
    points = g.groupBy("key", "state").agg(F.min(F.struct("suburb", "lat", "lng")).alias("p")).select("key", "state", "p.suburb", "p.lat", "p.lng")
    states = points.groupBy("key").agg(F.array_sort(F.collect_set("state")).alias("states"))  # there are few states
    return {
        "points": points.select("key", "state", "lat", "lng"), "by_state": points.select("state", "suburb", "lat", "lng"), "states": states.withColumn("only", F.when(F.size("states") == 1, F.get("states", F.lit(0)))),
        "names": points.groupBy("key").agg(F.min("suburb").alias("name")),
    }


def composite_candidates(value: Column) -> Column:
    """(rank, text) for what may be the locality in a composite: the whole value, then its parts from the right without brackets and a trailing
    postcode, then each part's word tails, longest first."""
    plain = F.trim(F.regexp_replace(value, r"\([^)]*\)", " "))
    parts = F.transform(F.reverse(F.split(plain, r"[,:|/]")), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\s+\d{4}\s*$", ""), r"\s+", " ")))

    def tails(p: Column, at: Column) -> Column:
        w = F.split(p, " ")
        n = F.size(w)
        return F.transform(F.sequence(F.lit(0), F.least(n - 1, F.lit(8))), lambda i: F.struct((100 + at * 100 + i).alias("rank"), F.array_join(F.slice(w, i + 1, n), " ").alias("text")))

    inner = F.flatten(F.transform(F.filter(parts, lambda p: p != ""), tails))
    return F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.trim(value).alias("text"))), inner)


#: How much of a row's own text is read, and a name before a postcode in it (fixed values).
TEXT_LENGTH = 700
BEFORE_POSTCODE = r"\b([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,2})\s+(\d{4})\b"
UNCHECKED, NOT_A_PLACE, NO_STATE, ABSENT = "unchecked", "not a place", "no state", "absent"


def _before_postcodes(text: Column, state: Column) -> Column:
    """(rank, text) of names that stand before a postcode of the row's own state, in order; without that test lot numbers, years and areas would do."""
    names, codes = (F.regexp_extract_all(text, F.lit(BEFORE_POSTCODE), i) for i in (1, 2))
    at = F.filter(F.transform(names, lambda n, i: F.struct(i.alias("rank"), n.alias("text"), F.get(codes, i).alias("code"))), lambda x: state_of_postcode(x.code) == state)
    return F.transform(at, lambda x: F.struct(x.rank.alias("rank"), x.text.alias("text")))


def _is_street(name: Column, text: Column) -> Column:
    """Whether a name is a kind of street, or stands before one in the row's own text."""
    after = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?i)\Q"), F.regexp_replace(name, r"\\E", ""), F.lit(r"\E\s+([A-Za-z]+)")), F.lit(1))
    return F.lower(name).isin(*STREET_TYPES) | F.lower(after).isin(*STREET_TYPES)


def with_locality(df: DataFrame, gaz: DataFrame, key: str = "id", suburb: str = "suburb", state: str = "state", texts: tuple[str, ...] = ()) -> DataFrame:
    """df with locality (the gazetteer's spelling, null if none) and why, one of eight reasons. key tells rows apart; texts: columns with the row's own words.

    stated: a locality of the row's state. address: so it is, but the row's words have it as a street and another locality before a postcode. composite: found inside the
    value. postcode: not in the value, but before a postcode of the row's state. unchecked: a locality's name without a state to check it. not a place,
    no state, absent: nothing can be said. Whatever a row may mean is looked up in one join."""
    g = gazetteer_side(gaz)
    raw, st = F.trim(F.coalesce(F.col(suburb), F.lit(""))), F.nullif(F.upper(F.trim(F.coalesce(F.col(state), F.lit("")))), F.lit(""))
    said = F.substring(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts]), 1, TEXT_LENGTH) if texts else F.lit("")
    tag = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.rank.alias("rank"), x.text.alias("text")))
    asked = F.concat(tag("value", F.when(raw != "", composite_candidates(raw)).otherwise(F.array().cast("array<struct<rank:int,text:string>>"))), tag("postcode", _before_postcodes(said, st)))
    c = df.select(F.col(key).alias("_key"), st.alias("_st"), F.explode(asked).alias("c")).select("_key", "_st", "c.*")
    own = F.col("_st") == F.col("g_state")
    best = lambda ok: F.min(F.when(ok, F.struct("rank", "g_name")))
    hit = c.join(g, F.lower("text") == F.col("g_key")).groupBy("_key").agg(F.max((F.col("kind") == "value") & (F.col("rank") == 0)).alias("_named"), best(own & (F.col("kind") == "value")).alias("_v"), best(own & (F.col("kind") == "postcode")).alias("_p"))
    out = df.join(hit, F.col(key).eqNullSafe(F.col("_key")), "left")
    named, stated = F.coalesce("_named", F.lit(False)), F.coalesce(F.col("_v.rank") == 0, F.lit(False))
    moved = F.col("_p.g_name").isNotNull() & (F.lower("_p.g_name") != F.lower(raw)) & _is_street(raw, said)
    why = (
        F.when(stated, F.when(moved, ADDRESS).otherwise(STATED)).when(named & st.isNull(), F.when(_is_street(raw, said), NOT_A_PLACE).otherwise(UNCHECKED)).when(st.isNull(), F.when(raw != "", NO_STATE).otherwise(ABSENT))
        .when(F.col("_v").isNotNull(), COMPOSITE).when(F.col("_p").isNotNull(), POSTCODE).when(raw != "", NOT_A_PLACE).otherwise(ABSENT)
    )
    locality = F.when(F.col("why").isin(ADDRESS, POSTCODE), F.col("_p.g_name")).when(F.col("why").isin(STATED, COMPOSITE), F.col("_v.g_name")).when(F.col("why") == UNCHECKED, raw)
    return out.withColumn("why", why).withColumn("locality", locality).drop("_key", "_named", "_v", "_p")


def find_in_text(df: DataFrame, gaz: DataFrame, key: str, text: str, state: str) -> DataFrame:
    """key with the locality named in a free text: of the row's own state first, then three, two, one words; one before a street type only if
    there is no other; then the leftmost."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^a-z'\- ]+", " "), r"\s+"), lambda x: x != "")
    grams = F.flatten(
        F.transform(F.array(*map(F.lit, (3, 2, 1))), lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(n.alias("n"), i.alias("at"), F.array_join(F.slice("_w", i + 1, n), " ").alias("g"), F.get("_w", i + n).isin(*STREET_TYPES).alias("street")))))
    )
    e = df.select(key, F.upper(F.trim(F.col(state))).alias("_st"), w.alias("_w")).select(key, "_st", F.explode(grams).alias("c")).where("c IS NOT NULL")
    hit = e.join(gazetteer_side(gaz), F.col("c.g") == F.col("g_key"))
    rank = F.struct(F.coalesce(F.col("c.street"), F.lit(False)).cast("int").alias("street"), (F.col("g_state") != F.coalesce("_st", F.lit(""))).cast("int").alias("other"), (-F.col("c.n")).alias("n"), F.col("c.at").alias("at"), "g_state", "g_name")
    best = hit.groupBy(key).agg(F.min(rank).alias("b"))
    return best.select(key, F.col("b.g_name").alias("locality"), F.col("b.g_state").alias("found_state"))


def vote_state(df: DataFrame, candidates: str = "suburb_states", postcode: str = "postcode", hint: str = "page_state", stated: str = "listing_state") -> DataFrame:
    """df with voted_state and signal. A stated state wins; else two signals that agree; else the hint among a shared locality's states; else a single
    vote; else the hint, marked as contested. ``candidates`` holds the states of the row's locality name."""
    said, post, page = state_name(F.col(stated)), state_of_postcode(F.col(postcode)), state_name(F.col(hint))
    names = F.coalesce(F.col(candidates), F.array().cast("array<string>"))
    only = F.when(F.size(names) == 1, F.get(names, F.lit(0)))
    votes = F.filter(F.array(F.struct(post.alias("s"), F.lit("postcode").alias("by")), F.struct(only.alias("s"), F.lit("suburb").alias("by")), F.struct(page.alias("s"), F.lit("page").alias("by"))), lambda v: v.s.isNotNull())
    out = df.withColumn("_v", votes).withColumn("_said", said).withColumn("_page", page).withColumn("_names", names)
    distinct = F.array_distinct(F.transform("_v", lambda v: v.s))
    agreed = F.filter(distinct, lambda s: F.size(F.filter("_v", lambda v: v.s == s)) >= 2)
    out = out.withColumn("_a", F.when(F.size(agreed) == 1, F.get(agreed, F.lit(0)))).withColumn("_d", distinct)
    by = lambda s: F.array_join(F.transform(F.filter("_v", lambda v: v.s == s), lambda v: v.by), " + ")
    shared = (F.size("_names") > 1) & F.coalesce(F.array_contains("_names", F.col("_page")), F.lit(False))
    answer = F.coalesce("_said", "_a", F.when(shared, F.col("_page")), F.when(F.size("_d") == 1, F.get("_d", F.lit(0))), F.col("_page"))
    signal = (
        F.when(F.col("_said").isNotNull(), "listing").when(F.col("_a").isNotNull(), by(F.col("_a"))).when(shared, "suburb + page")
        .when(F.size("_d") == 1, by(F.get("_d", F.lit(0)))).when(F.col("_page").isNotNull(), "page (contested)").otherwise("")
    )
    return out.withColumn("voted_state", answer).withColumn("signal", signal).drop("_v", "_said", "_page", "_names", "_a", "_d")


def national_files(df: DataFrame, file: str, proven: str) -> DataFrame:
    """Files whose rows prove more than one state: their page's hint says nothing."""
    return df.where(F.col(proven).isNotNull()).groupBy(file).agg(F.count_distinct(proven).alias("states")).where("states > 1")


def carried(df: DataFrame, part: list[str], order: str, is_header: Column, text: str) -> DataFrame:
    """df with ``context`` (the last header text above a row) and ``banner`` (the first of the part)."""
    w = Window.partitionBy(*part).orderBy(order)
    head = F.when(is_header, F.col(text))
    return df.withColumn("context", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("banner", F.first(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def header_runs(df: DataFrame, part: list[str], order: str, is_header: Column) -> DataFrame:
    """df with ``run``: consecutive header rows, and the rows under them, share a number (gaps and islands)."""
    w = Window.partitionBy(*part).orderBy(order)
    starts = (is_header & ~F.coalesce(F.lag(is_header).over(w), F.lit(False))).cast("int")
    return df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
