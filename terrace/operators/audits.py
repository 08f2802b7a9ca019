"""Audits of stored rows with today's readers, and the small steps around a run: what each finds is a table, nothing is deleted by finding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listing import judge
from ..functions.text import MIN_PRICE, blank, postcode, rejoin_money, specs
from .names import lengths_of, pieces, singular, squash

#: A price is corrected only if the row's own text clearly beats it.
UNDERSTATED_BY = 1.25
MAX_TOTAL = 5_000_000.0
#: Letters and digits a label, and a company's name in it, must have.
LEAST_LABEL = 8
LEAST_MENTION = 4
#: Uses that make a design name one company's own.
STRONG_SUPPORT = 10


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- stored values against their own text ---
def fabricated_postcodes(df: DataFrame) -> DataFrame:
    """id, postcode, drop_state: stored postcodes that the row's text doesn't give today. A state that rested on the postcode alone goes with it."""
    read = F.coalesce(postcode(F.concat_ws(" ", _said("lot_address"), _said("suburb"), _said("source_text"))), F.lit(""))
    rests = F.coalesce(blank(F.col("state")).isNotNull() & (F.lower(F.trim("state_source")) == "postcode"), F.lit(False))
    stored = F.trim(F.col("postcode").cast("string"))
    return df.where(_said("postcode") != "").where(read != stored).select("id", "postcode", rests.alias("drop_state"))


def understated_prices(df: DataFrame) -> DataFrame:
    """id, price, total, land, build: rows whose rejoined amounts hold a total well above the price. Land and build are the two before a total that stands last."""
    text = _said("source_text")
    fixed = rejoin_money(text)
    found = F.transform(F.regexp_extract_all(fixed, F.lit(r"\$\s?(\d[\d,]*(?:\.\d+)?)"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    r = df.where((fixed != text) & (F.coalesce("price", F.lit(0)) != 0)).withColumn("_a", F.filter(found, lambda v: v.between(MIN_PRICE, MAX_TOTAL)))
    r = r.withColumn("total", F.array_max("_a")).where(F.col("total") > F.col("price") * UNDERSTATED_BY)
    n = F.size("_a")
    ordered = (n >= 3) & (F.get("_a", n - 1) == F.col("total"))
    return r.select("id", "price", "total", F.when(ordered, F.get("_a", n - 3)).alias("land"), F.when(ordered, F.get("_a", n - 2)).alias("build"))


def land_only(df: DataFrame) -> DataFrame:
    """id of untyped rows with land and no dwelling whose estate or text says land only."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    says = F.concat_ws(" ", _said("estate_name"), _said("source_text")).rlike(r"(?i)land\s*only|\bvacant\s+land\b")
    return df.where(blank(_said("product_type")).isNull() & none("bedrooms") & none("house_sqm") & ~none("land_sqm") & says).select("id")


def backfilled_specs(df: DataFrame) -> DataFrame:
    """df with missing bedrooms, bathrooms and car spaces read from its text (the address where there is none), and ``agrees``: whether a stored
    bedroom count is what the text says (null where one of both is missing)."""
    got = specs(F.coalesce(F.nullif(F.col("source_text"), F.lit("")), _said("lot_address")))
    r = df.withColumn("_s", got).withColumn("agrees", F.col("bedrooms").cast("int") == F.col("_s.bedrooms"))
    return r.withColumns({f: F.coalesce(F.col(f), F.col(f"_s.{f}")) for f in ("bedrooms", "bathrooms", "car_spaces")}).drop("_s")


def spec_audit(df: DataFrame) -> DataFrame:
    """One row of counts: before and after by field, agreements and disagreements of bedrooms."""
    fields = ("bedrooms", "bathrooms", "car_spaces")
    after = backfilled_specs(df.withColumns({f"_{f}": F.col(f) for f in fields}))
    counts = [F.count(c).alias(n) for f in fields for c, n in ((f"_{f}", f"{f}_before"), (f, f"{f}_after"))]
    return after.agg(*counts, F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"))


def rejected_today(df: DataFrame) -> DataFrame:
    """id, reason of stored rows that would not be read as listings any more."""
    return df.select("id", judge(F.col("source_text")).alias("reason")).where("reason <> ''")


def no_longer_extracted(stored: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without a row of the same keys in today's extraction; null keys are equal."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}"))
    return stored.alias("s").join(extracted.select(*keys).distinct().alias("e"), same, "left_anti")


# --- one lot under two projects, copies across files, names by map ---
def cross_listed(df: DataFrame, key: list[str], order: str, project: str) -> DataFrame:
    """df with ``kept_in``: null on the first row of a key (in page order), else the project that row has. Rows with it are the drops, so none vanishes uncounted."""
    first = df.groupBy(*key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(project).alias("p"))).alias("_f"))
    return df.join(first, key).withColumn("kept_in", F.when(F.col(order) != F.col("_f.o"), F.col("_f.p"))).drop("_f")


def relabelled(df: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """df with the columns of a plan (stored, then the columns to set) where the name is a stored one; a null in the plan leaves the column. The plan is a short list."""
    new = [c for c in plan.columns if c != "stored"]
    p = plan.select(F.col("stored").alias("_stored"), *[F.col(c).alias(f"_{c}") for c in new])
    return df.join(p, F.col(name) == F.col("_stored"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in new}).drop("_stored", *[f"_{c}" for c in new])


def retired_copies(df: DataFrame, is_copy: Column, key: list[str]) -> DataFrame:
    """Copies to retire: only those whose key another row, no copy, still has."""
    marked = df.withColumn("_copy", F.coalesce(is_copy, F.lit(False)))
    keepers = marked.where("NOT _copy").select(*key).distinct()
    return marked.where("_copy").join(keepers, key, "left_semi").drop("_copy")


# --- names in labels and texts ---
def contained_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """label, name: the one known company whose squashed name stands in the squashed label. Both have eight letters or more; two companies in it give none.
    A name in a label is one of its stretches: labels are cut in the lengths that names have and meet names whole, so a common beginning brings nobody together."""
    l = labels.select("label").distinct().withColumn("_l", squash(F.col("label"))).where(F.length("_l") >= LEAST_LABEL)
    k = known.select("name", squash(F.col("name")).alias("piece")).where(F.length("piece") >= LEAST_LABEL).groupBy("piece").agg(F.min("name").alias("name"))
    hit = pieces(l, "_l", lengths_of(k, F.length("piece"))).select("label", "piece").join(k, "piece")
    return hit.groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").select("label", "name")


def mentions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, name: the longest known name (four letters or more, then the first in order) that a text says as whole words. Texts are cut in runs of as many words as
    names have and meet names whole; of one spelling's names the first is told before. Every distinct text is read once."""
    words = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " "), " +", " "))
    first = F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("x")
    k = known.select("name", words(F.col("name")).alias("_k")).where(F.length("_k") >= LEAST_MENTION).groupBy("_k").agg(first)
    t = rows.select("id", words(F.col("text")).alias("_t"))
    w = F.split("_t", " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    said = t.select("_t").distinct().join(F.broadcast(lengths_of(k, F.size(F.split("_k", " ")))))
    said = said.select("_t", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.size(w)), runs)))).alias("_k"))
    best = said.join(k, "_k").groupBy("_t").agg(F.min("x").alias("x"))
    return t.join(best, "_t").groupBy("id").agg(F.min("x").alias("x")).select("id", "x.name")


def display_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, ord: spellings to canonicalise to. Registered names come first in their order, then stored ones by frequency; a name that an earlier one stands
    for already (by its letters, or without its plural) is not learned."""
    counted = names.where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    seeds = registry.select("name", F.lit(0).alias("kind"), F.col("ord").cast("long").alias("by"))
    all_ = seeds.unionByName(counted.select("name", F.lit(1).alias("kind"), (-F.col("n")).alias("by")))
    rank = F.struct("kind", "by", "name")
    first = all_.groupBy(squash(singular(F.col("name"))).alias("_p")).agg(F.min(rank).alias("x"))
    first = first.groupBy(squash(F.col("x.name")).alias("_s")).agg(F.min("x").alias("x")).where("_s <> ''")
    return first.select("x.name", "x.kind", "x.by")


def review_tier(rows: DataFrame, support: DataFrame, least: int = STRONG_SUPPORT) -> DataFrame:
    """id, builder, note for a person to clear, never written: exactly one company has a design name of the row ``least`` times or more. rows: id, tokens,
    header (the company its section header names, or null); support: token, builder, n."""
    strong = support.where(F.col("n") >= least).select("token", "builder")
    got = rows.select("id", "header", F.explode(F.array_distinct("tokens")).alias("token")).join(strong, "token")
    one = got.groupBy("id").agg(F.count_distinct("builder").alias("k"), F.min("builder").alias("builder"), F.min("header").alias("header")).where("k = 1")
    note = F.when(F.col("header").isNull(), "no section header").when(F.col("header") == F.col("builder"), "section header agrees").otherwise(F.concat(F.lit("section header DISAGREES ("), "header", F.lit(")")))
    return one.select("id", "builder", note.alias("note"))


# --- small steps of a run ---
def within_budget(df: DataFrame, budget: float) -> DataFrame:
    return df.where(F.col("price") <= budget)


def priced_once(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a price, each key's first page once, and the count of keys whose price is withheld everywhere (``withheld``)."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(F.col("price").isNull(), "page")).alias("x")).select(key, "x.*")
    return best.where("price IS NOT NULL"), best.agg(F.count_if(F.col("price").isNull()).alias("withheld"))


def larger_result(mapped: DataFrame, adaptive: DataFrame, part: str) -> DataFrame:
    """Of two readings of each part (a portal) the one with more rows; the mapped one if they tie."""
    size = lambda df, n: df.groupBy(part).agg(F.count("*").alias(n))
    pick = size(mapped, "_m").join(size(adaptive, "_a"), part, "full_outer").select(part, (F.coalesce("_a", F.lit(0)) > F.coalesce("_m", F.lit(0))).alias("_other"))
    take = lambda df, other: df.join(pick.where(F.col("_other") == other), part, "left_semi")
    return take(mapped, False).unionByName(take(adaptive, True))


def set_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, value: stored values, replaced by new ones of the same key."""
    return old.join(new, "key", "left_anti").unionByName(new)


def select_marks(df: DataFrame, marks: DataFrame, key: str, selected: bool, stamp: str) -> DataFrame:
    """df with promo_selected and promo_selected_at set, or unset, where the key is listed; ``changed`` tells which rows that were."""
    m = marks.select(F.col(key)).where(F.col(key) != "").distinct().withColumn("changed", F.lit(True))
    r = df.join(m, key, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return r.withColumns({"promo_selected": F.when(F.col("changed"), F.lit(int(selected))).otherwise(F.col("promo_selected")), "promo_selected_at": F.when(F.col("changed"), F.lit(stamp if selected else None)).otherwise(F.col("promo_selected_at"))})


def clear_marks(df: DataFrame) -> DataFrame:
    """df without any mark; ``changed`` tells which rows had one."""
    return df.withColumns({"changed": F.coalesce(F.col("promo_selected") == 1, F.lit(False)), "promo_selected": F.lit(0), "promo_selected_at": F.lit(None).cast("string")})


def promo_order(df: DataFrame) -> DataFrame:
    """The marked rows by state, suburb and price, nulls first."""
    return df.where("promo_selected = 1").orderBy("state", "suburb", "price")


def newest(df: DataFrame, at: str, n: int = 10) -> DataFrame:
    """The newest n records (a history page)."""
    return df.orderBy(F.col(at).desc_nulls_last()).limit(n)
