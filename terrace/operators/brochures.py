"""Brochures and the listings that they belong to, told by the file's name alone, level by level.

A file of a known company: its lot, if the company has one such row; a lot of several rows ends the search, since the name doesn't say which. Then its
street, if one row's address has it. Then its design words in order: the first that stands in the company's rows, but not in so many that it can't be a
design, takes all of them. A file of nobody needs two signs at once: a lot and a word that stand together on one row of all.

Files meet what is summed up per key, not its rows: the first and last listing of a company's lot, of an address (met by a piece of it around the house number,
once per street), of a lot and word. Words are looked up in an index of those that some file asks for, with the number of rows that have each. Only a design takes
all its listings: that many rows are the result, and they are dealt out by pieces of a key's files (``FILES``), so that few keys are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word may stand in so many of a company's rows, or in this share of them, and still be a design.
MOST_ROWS, MOST_SHARE = 3, 4
#: Files, about, that meet the listings of a company's word in one piece.
FILES = 1000
# --- fixed values: lots, streets, words of file names that say nothing ---
LOT = r"(?i)\bl(?:ot)?[\s\-_]*(\d{1,5})\b"
STREET_TYPES = "st|street|rd|road|ave|avenue|dr|drive|ct|court|pl|place|cres|crescent|way|cct|circuit|pde|parade|blvd|boulevard|tce|terrace|cl|close|ln|lane|gr|grove|rise|loop|esp|esplanade|walk|mews|green"
STREET = rf"(?i)\b(\d+[A-Za-z]?)[\s\-_]+([A-Za-z][A-Za-z\-]+(?:[\s\-_]+[A-Za-z][A-Za-z\-]+)?)[\s\-_]+({STREET_TYPES})\b"
NOISE = r"(?i)\.(pdf|xlsx|xls|csv)$|\b(brochure|flyer|floor\s*plan|floorplan|package|price\s*list|pricelist|final|draft|copy|v\d+|rev\d*|web|digital|lo?res|hi?res)\b"
NO_DESIGN = ("lot", "the", "and", "with", "from", "home", "homes", "stage", "street", "road", "estate")
# --- ---


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\-_]+", " ")


def file_lot(name: Column) -> Column:
    """The lot that a file's name gives, without zeros in front; null if none."""
    found = F.regexp_extract(name, LOT, 1)
    return F.when(found != "", F.when(F.ltrim(found, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(found, F.lit("0"))))


def file_street(name: Column) -> Column:
    """Number and name of the street, lower case with single spaces; null if none."""
    return F.when(F.regexp_extract(name, STREET, 1) != "", _flat(F.concat(F.regexp_extract(name, STREET, 1), F.lit(" "), F.regexp_extract(name, STREET, 2))))


def file_words(name: Column) -> Column:
    """Words that may be a design's name, in order, in lower case."""
    stem = F.regexp_replace(F.regexp_replace(name, NOISE, " "), r"[_\-]+", " ")
    return F.filter(F.transform(F.regexp_extract_all(stem, F.lit(r"([A-Za-z][A-Za-z']{3,})"), 1), F.lower), lambda w: ~w.isin(*NO_DESIGN))


def _words_in(text: Column) -> Column:
    """Every stretch of a text that stands between word borders, as far as a word of a file's name can be one: words, and words joined by apostrophes."""
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w']+)"), 1), lambda r: F.split(r, "'"))
    pieces = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(F.sequence(i, F.size(p)), lambda j: F.array_join(F.slice(p, i, j - i + 1), "'"))))
    return F.array_distinct(F.filter(F.flatten(F.transform(runs, pieces)), lambda w: F.length(w) >= 4))


def _corners(address: Column) -> Column:
    """Every sign before a space with the two after it: where a number and a street's name meet."""
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length(address), F.lit(2))), lambda i: F.substr(address, i, F.lit(1)) == " "), lambda i: F.substr(address, i - 1, F.lit(4))))


def _dealt(files: DataFrame, index: DataFrame) -> DataFrame:
    """files joined to index by (b, word), in pieces of FILES files."""
    pieces = files.groupBy("b", "word").agg(F.ceil(F.count("*") / FILES).cast("int").alias("pieces"))
    tasks, keys = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["b", "word", "piece"]  # a number, or the few bytes that meet would be one task
    left = files.join(pieces, ["b", "word"]).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")).drop("pieces").repartition(tasks, *keys)
    right = index.join(pieces, ["b", "word"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces").repartition(tasks, *keys)
    return left.hint("merge").join(right, keys)


def match(docs: DataFrame, listings: DataFrame) -> DataFrame:
    """doc_id, listing_id, rule (lot, street, design, lot and word). docs: doc_id, builder, filename; listings: id, builder, lot_number, lot_address, suburb,
    estate_name, source_text. A design may take several listings, every other rule takes one; a file that fits nothing has no row."""
    company = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = docs.select("doc_id", company(F.col("builder")).alias("b"), file_lot(text("filename")).alias("lot"), file_street(text("filename")).alias("street"), file_words(text("filename")).alias("words"))
    lot = F.ltrim(F.trim(text("lot_number")), F.lit("0"))
    l = listings.select("id", company(F.col("builder")).alias("b"), lot.alias("lot"), _flat(text("lot_address")).alias("address"), "source_text", F.concat_ws(" ", "lot_address", "suburb", "estate_name", "source_text").alias("said"))
    ends = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))  # noqa: E731  one listing if they are the same
    known, unknown = d.where("b IS NOT NULL"), d.where("b IS NULL")

    lots = l.groupBy("b", "lot").agg(F.count("*").alias("n"), F.min("id").alias("listing_id"))
    by_lot = known.where("lot IS NOT NULL").join(lots, ["b", "lot"]).groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("listing_id").alias("listing_id"))
    rest = known.join(by_lot.select("doc_id"), "doc_id", "left_anti")

    corner = F.concat(F.substr(F.col("street"), F.instr("street", " ") - 1, F.lit(4)))
    streets = rest.where("street IS NOT NULL").select("doc_id", "b", "street", corner.alias("corner"))
    homes = l.where("b IS NOT NULL").groupBy("b", "address").agg(*ends("id", "id")).withColumn("corner", F.explode(_corners(F.col("address"))))
    met = streets.select("b", "street", "corner").distinct().join(homes, ["b", "corner"]).where(F.contains("address", "street")).groupBy("b", "street").agg(*ends("low", "high"))
    by_street = streets.join(met, ["b", "street"]).groupBy("doc_id").agg(*ends("low", "high")).where("low = high").withColumnRenamed("low", "listing_id")
    rest = rest.join(by_street.select("doc_id"), "doc_id", "left_anti")

    asked = rest.select("doc_id", "b", F.posexplode("words").alias("at", "word"))
    index = l.where("b IS NOT NULL").select("b", "id", F.explode(_words_in(text("source_text"))).alias("word")).join(asked.select("b", "word").distinct(), ["b", "word"], "left_semi")
    size = l.where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("rows"))
    rare = index.groupBy("b", "word").agg(F.count("*").alias("n")).join(size, "b").where(F.col("n") <= F.greatest(F.lit(MOST_ROWS), F.floor(F.col("rows") / MOST_SHARE)))
    first = asked.join(rare.select("b", "word"), ["b", "word"]).groupBy("doc_id", "b").agg(F.min_by("word", "at").alias("word"))
    by_design = _dealt(first, index).select("doc_id", F.col("id").alias("listing_id"))

    loose = unknown.where("lot IS NOT NULL").select("doc_id", "lot", F.explode("words").alias("word")).distinct()
    spoken = l.where("trim(lot) <> ''").join(loose.select("lot").distinct(), "lot", "left_semi").select("lot", "id", F.explode(_words_in(F.col("said"))).alias("word"))
    said = spoken.groupBy("lot", "word").agg(*ends("id", "id"))
    alone = loose.join(said, ["lot", "word"]).groupBy("doc_id").agg(*ends("low", "high")).where("low = high").withColumnRenamed("low", "listing_id")

    out = lambda df, rule: df.select("doc_id", "listing_id", F.lit(rule).alias("rule"))
    return out(by_lot.where("n = 1"), "lot").unionByName(out(by_street, "street")).unionByName(out(by_design, "design")).unionByName(out(alone, "lot and word"))
