"""Who sells a pooled row: rows without a company are named by rows that have one, over several kinds of keys at once, and a kind may only name rows once it
has been measured.

All keys of all rows are one long table (id, kind, key). What the named rows say is summed up per key, with map-side combine, to the number of
companies and the two that bound them in order; that suffices to take a row, or a whole company, out again and see whether one answer is left. So
neither the measures nor the names need a row to meet another; only the overlap of numbers is a join, by rare numbers first (``names.fingerprint_matches``), and
of each price's distinct sets of numbers, not of the rows that have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import VOLATILE
from ..session import cut
from . import names

#: Kinds of keys with one key per row, kinds with a key per word (they count where the word points at one company), and the overlap of numbers.
WHOLE = ("price_lot", "price_land", "text", "amounts", "price_parts", "price_suburb", "price")
WORDS = ("design", "design_often")
NUMBERS = "numbers"
#: How often a company has to use a word of the kind design_often; how long a text, and how many amounts of which size, make a key.
OFTEN, LEAST_TEXT, LEAST_AMOUNTS, LEAST_AMOUNT = 10, 30, 3, 1000
#: A kind may name rows if so few of its answers are wrong, and so few rows whose company is gone are given another.
LEAST_PRECISION, MOST_INVENTED = 0.99, 0.01
# --- fixed values: words of a stocklist that are no design's name ---
PLAIN_WORDS = tuple(
    "available unavailable hold onhold sold reserved leased under offer titled untitled registered unregistered dual key duplex house lot lots land build price total single double storey story beds bath baths bathrooms car cars spaces "
    "sqm frontage estate road street drive circuit avenue court close place way parade crescent boulevard terrace lane grove rise park hill view council city shire region north south east west mid contract part portal link due quarter january february "
    "march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec corner adaptable yield rent week deposit custom occ living design facade type status option options plus classic modern traditional "
    "contemporary elite bright elevate pavilion split std upgrade included approx tbc nil none new home homes property properties package packages".split()
)
# --- ---


def plain_text(text: Column) -> Column:
    """A line without what moves over a listing's life (money, statuses, dates, percentages), case and signs."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    for pattern in VOLATILE:
        t = F.regexp_replace(t, "(?i)" + pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9.+]+", " "), r"\s+", " "))


def amounts(text: Column) -> Column:
    """Every dollar amount of LEAST_AMOUNT or more, rounded, each once, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$\s?([\d,]+(?:\.\d+)?)"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x >= LEAST_AMOUNT), lambda x: F.rint(x).cast("long"))))


def design_words(text: Column) -> Column:
    """Words with a capital in front, or in capitals, that are no plain word of a stocklist, in lower case."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-zA-Z]{3,}|[A-Z]{4,})\b"), 1), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*PLAIN_WORDS)))


def place_words(rows: DataFrame, columns: list[str]) -> DataFrame:
    """word: every word of three letters or more in these columns; names of places and companies are no designs."""
    return rows.select(F.explode(F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z]{3,})"), 1) for c in columns]))).alias("word")).distinct()


def row_keys(rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """id, kind, key of rows with id, price, lot_number, land_sqm, land_price, build_price, suburb, source_text. A row has no key of a kind that it
    lacks a part for. places: word, the words that name no design."""
    price, text = F.col("price").cast("double"), F.col("source_text")
    whole = lambda c: F.when(c != 0, F.rint(c).cast("long").cast("string"))  # noqa: E731  0 is as good as unknown
    lot, suburb = F.nullif(F.lower(F.trim("lot_number")), F.lit("")), F.nullif(F.regexp_replace(F.lower("suburb"), "[^a-z]", ""), F.lit(""))
    joined = lambda *parts: F.concat(*[x for p in parts for x in (F.lit("|"), p)])  # noqa: E731  null if any part is
    sums, plain = amounts(text), plain_text(text)
    one = {
        "price_lot": joined(whole(price), lot), "price_land": joined(whole(price), F.when(F.col("land_sqm") != 0, F.format_string("%.1f", F.round(F.col("land_sqm").cast("double"), 1)))), "text": F.when(F.length(plain) >= LEAST_TEXT, plain),
        "amounts": F.when(F.size(sums) >= LEAST_AMOUNTS, F.array_join(sums.cast("array<string>"), "|")), "price_parts": joined(whole(F.col("land_price").cast("double")), whole(F.col("build_price").cast("double")), whole(price)),
        "price_suburb": joined(whole(price), suburb), "price": whole(price),
    }
    single = F.array(*[F.struct(F.lit(kind).alias("kind"), one[kind].alias("key")) for kind in WHOLE])
    keys = rows.select("id", F.explode(single).alias("x")).select("id", "x.*").where("key IS NOT NULL")
    words = rows.select("id", F.explode(design_words(text)).alias("key"))
    if places is not None:
        words = words.join(places.select(F.col("word").alias("key")), "key", "left_anti").select("id", "key")
    return keys.unionByName(words.select("id", F.explode(F.array(*map(F.lit, WORDS))).alias("kind"), "key"))


def what_keys_say(keys: DataFrame, builders: DataFrame) -> DataFrame:
    """kind, key, companies, low, high: per key the number of companies that use it, and of these the first and the last in order, each with its count.
    keys: of the named rows; builders: id, builder."""
    return _summed_up(keys.join(builders, "id").groupBy("kind", "key", "builder").agg(F.count("*").alias("n")))


def _summed_up(per: DataFrame) -> DataFrame:
    return per.groupBy("kind", "key").agg(F.count("*").alias("companies"), F.min(F.struct("builder", "n")).alias("low"), F.max(F.struct("builder", "n")).alias("high"), F.sum("n").alias("n"))


def _answers(keyed: DataFrame, left: Column, one: Column, n_of_one: Column) -> DataFrame:
    """id, kind, answers, answer: how many companies a row is offered, and which if it is one. left: companies of the key; one: the company if left is 1."""
    words = F.col("kind").isin(*WORDS)
    # a word that points at several companies says nothing; neither does a rare one of the kind that has to be frequent
    offered = F.when(~words, left).when((left == 1) & (n_of_one >= F.when(F.col("kind") == "design_often", F.lit(OFTEN)).otherwise(F.lit(1))), F.lit(1)).otherwise(F.lit(0))
    g = keyed.select("id", "kind", offered.alias("k"), one.alias("one")).where("k > 0").groupBy("id", "kind").agg(F.max("k").alias("k"), F.min("one").alias("low"), F.max("one").alias("high"))
    return g.select("id", "kind", F.when((F.col("k") == 1) & (F.col("low") == F.col("high")), F.lit(1)).otherwise(F.lit(2)).alias("answers"), F.col("low").alias("answer"))


def _without(own: Column, own_n: Column) -> tuple[Column, Column, Column]:
    """(companies left, the company if one is left, its count) of a key from which own_n of own's uses are taken."""
    gone = own_n <= 0
    left = F.col("companies") - F.when(gone, F.lit(1)).otherwise(F.lit(0))
    other = F.when(F.col("low.builder") == own, F.col("high")).otherwise(F.col("low"))
    return left, F.when(gone, other["builder"]).otherwise(F.col("low.builder")), F.when(gone, other["n"]).otherwise(F.when(F.col("low.builder") == own, own_n).otherwise(F.col("low.n")))


def _by_numbers(rows: DataFrame, builders: DataFrame, asked: DataFrame) -> DataFrame:
    """id, own, builder: companies of the named rows that share a row's price and enough other numbers. asked: id, own (null if pooled). Rows of one price and the
    same numbers are one class: classes meet, not rows, and a row is offered what its class is offered, itself left out."""
    price = F.col("price").cast("double")
    numbers = F.filter(names.numbers_of(F.coalesce("source_text", F.lit(""))), lambda x: x != F.round(price, 2))
    alike = ["p", "numbers"]
    sets = cut(rows.where("price <> 0").select("id", F.round(price).alias("p"), numbers.alias("numbers")).where(F.size("numbers") >= names.MIN_SHARED))  # read three times
    classes = cut(sets.groupBy(*alike).agg(F.min("id").alias("c")))  # read five times
    members = cut(sets.join(classes, alike).select("id", "c"))
    pairs = names.fingerprint_matches(classes.select(F.col("c").alias("id"), F.col("p").alias("price"), "numbers"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("x")).select("x.*")
    both = both.unionByName(classes.select("c", F.col("c").alias("other")))
    sold = members.join(builders, "id").groupBy(F.col("c").alias("other"), "builder").agg(F.count("*").alias("n"))
    offered = both.join(sold, "other").groupBy("c", "builder").agg(F.sum("n").alias("n"))
    found = members.join(asked, "id").join(offered, "c")
    return found.where(F.col("n") > F.when(F.col("builder") == F.col("own"), 1).otherwise(0)).select("id", "own", "builder")


def measure(rows: DataFrame, builders: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """kind, rows, answered, right, wrong, ambiguous, invented, precision, trusted: for each kind of key, over the named rows, what the others say of a row (its company
    is among them), and how many rows are given a company although all rows of their own are taken out. builders: id, builder of the named rows;
    labels that stand for one company are to be made one before (``repairs.label_classes``)."""
    named = rows.join(builders.select("id"), "id", "left_semi")
    own = builders.withColumnRenamed("builder", "own")
    keys = cut(row_keys(named, places).join(own, "id"))  # read five times
    mine = keys.groupBy("kind", "key", "own").agg(F.count("*").alias("own_n"))
    said = _summed_up(mine.toDF("kind", "key", "builder", "n"))
    keyed = keys.join(said, ["kind", "key"]).join(mine, ["kind", "key", "own"])
    recovered = _answers(keyed, *_without(F.col("own"), F.col("own_n") - 1))
    invented = _answers(keyed, *_without(F.col("own"), F.lit(0))).where("answers = 1")
    near = _by_numbers(named, builders, own)
    count = near.groupBy("id").agg(F.count("*").alias("k"), F.min("builder").alias("answer"), F.count_if(F.col("builder") != F.col("own")).alias("others"))
    recovered = recovered.unionByName(count.select("id", F.lit(NUMBERS).alias("kind"), F.when(F.col("k") == 1, 1).otherwise(2).alias("answers"), "answer"))
    invented = invented.select("id", "kind").unionByName(count.where("others = 1").select("id", F.lit(NUMBERS).alias("kind")))
    ok = F.col("answer") == F.col("own")
    a = recovered.join(own, "id").groupBy("kind").agg(F.count_if(F.col("answers") == 1).alias("answered"), F.count_if((F.col("answers") == 1) & ok).alias("right"), F.count_if((F.col("answers") == 1) & ~ok).alias("wrong"), F.count_if(F.col("answers") > 1).alias("ambiguous"))
    b = invented.groupBy("kind").agg(F.count("*").alias("invented"))
    kinds = rows.sparkSession.createDataFrame([(k,) for k in (*WHOLE, *WORDS, NUMBERS)], "kind string")
    zero = ["answered", "right", "wrong", "ambiguous", "invented"]
    out = kinds.join(a, "kind", "left").join(b, "kind", "left").fillna(0, zero).withColumn("rows", F.lit(builders.count()))
    precision = F.when(F.col("answered") > 0, F.col("right") / F.col("answered"))
    trusted = F.coalesce(precision >= LEAST_PRECISION, F.lit(False)) & (F.col("invented") <= MOST_INVENTED * F.col("rows"))
    return out.select("kind", "rows", *zero, precision.alias("precision"), trusted.alias("trusted"))


def name_rows(pooled: DataFrame, named: DataFrame, builders: DataFrame, kinds: list[str], places: DataFrame | None = None) -> DataFrame:
    """id, builder, status, kinds: the pooled rows that keys of these kinds (those that ``measure`` trusts) know. Kinds that agree name the row; a
    row of which they say different things is a conflict and stays without a name."""
    said = what_keys_say(row_keys(named, places).where(F.col("kind").isin(*kinds)), builders)
    keyed = row_keys(pooled, places).where(F.col("kind").isin(*kinds)).join(said, ["kind", "key"])
    found = _answers(keyed, F.col("companies"), F.col("low.builder"), F.col("low.n")).select("id", "kind", "answers", "answer")
    if NUMBERS in kinds:
        columns = ["id", "price", "source_text"]
        near = _by_numbers(named.select(*columns).unionByName(pooled.select(*columns)), builders, pooled.select("id", F.lit(None).cast("string").alias("own")))
        found = found.unionByName(near.groupBy("id").agg(F.count("*").alias("k"), F.min("builder").alias("answer")).select("id", F.lit(NUMBERS).alias("kind"), F.when(F.col("k") == 1, 1).otherwise(2).alias("answers"), "answer"))
    g = found.groupBy("id").agg(F.max("answers").alias("most"), F.min("answer").alias("low"), F.max("answer").alias("high"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))
    agreed = (F.col("most") == 1) & (F.col("low") == F.col("high"))
    return g.select("id", F.when(agreed, F.col("low")).alias("builder"), F.when(agreed, "accepted").otherwise("conflict").alias("status"), "kinds")
