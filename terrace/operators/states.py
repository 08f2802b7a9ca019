"""The state that a row proves on its own: strict enough to overrule what is said of its whole file. Every name that a row may mean is looked up in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import STATE_NAMES, STATES, lookup, state_of_postcode
from .places import MAX_GAZETTEER

# --- fixed values ---
TOKEN = r"\b(VIC|NSW|QLD|SA|WA|NT|ACT|TAS)\b"
ADMINISTRATIVE = r"(?i)\b(council|city of|shire|regional|region)\b"
MOST_WORDS = 5
# --- ---
STATED, LOCALITY, BOTH, WHOLE = "listing text", "listing locality", "listing locality + postcode", "suburb + postcode"


def components(cell: Column) -> Column:
    """A cell's parts between the separators that files use."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[/|,]"), lambda p: F.trim(p)), lambda p: p != "")


def _words(p: Column) -> Column:
    return F.filter(F.split(p, r"\s+"), lambda w: w != "")


def stated(*cells: Column) -> Column:
    """The state that a part of a cell is, by name or in capitals by code; else one in capitals at the end of a part of a few words. Null if none."""

    def of(cell: Column) -> Column:
        parts = components(cell)
        whole = F.filter(F.transform(parts, lambda p: F.coalesce(lookup(F.lower(p), STATE_NAMES), F.when(p.isin(*STATES), p))), lambda s: s.isNotNull())
        code = lambda p: F.regexp_extract(p, TOKEN, 1)
        ends = F.filter(parts, lambda p: (F.size(_words(p)) <= MOST_WORDS) & (code(p) != "") & p.endswith(code(p)))
        return F.coalesce(F.get(whole, F.lit(0)), F.nullif(code(F.get(ends, F.lit(0))), F.lit("")))

    return F.coalesce(*map(of, cells))


def named_locality(*cells: Column) -> Column:
    """The last part of a cell with separators that isn't a state, without the state's code. Null if no cell has separators."""

    def of(cell: Column) -> Column:
        parts = components(cell)
        bare = lambda p: F.regexp_replace(F.regexp_replace(F.upper(p), TOKEN, ""), r"^[ \-]+|[ \-]+$", "")
        fit = F.filter(F.reverse(parts), lambda p: F.length(bare(p)) > 2)
        return F.when(F.size(parts) >= 2, F.array_join(F.filter(_words(F.get(fit, F.lit(0))), lambda w: ~F.upper(w).isin(*STATES)), " "))

    return F.coalesce(*map(of, cells))


def tails(cell: Column) -> Column:
    """The whole cell, then what is left as words go from the front; none of a single word, or of an administrative area, whose tail is a trap."""
    w = _words(F.coalesce(cell, F.lit("")))
    fits = (F.size(w) >= 2) & ~F.coalesce(cell, F.lit("")).rlike(ADMINISTRATIVE)
    return F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.size(w)), " "))).otherwise(F.array().cast("array<string>"))


def proven_states(df: DataFrame, gaz: DataFrame, key: str = "id") -> DataFrame:
    """key, own_state, proof (both null if the row proves nothing). df: key (once each), suburb, estate_name, lot_address, postcode; gaz: suburb, state.

    What the text states wins. Else the locality that stands between separators of suburb or estate, or the longest tail of the suburb cell that is a
    locality: alone if one state has it, with a postcode if that is one of its states. A postcode by itself proves nothing: it has to agree with the
    suburb as a whole."""
    low = lambda c: F.lower(F.trim(c))
    known = gaz.where(F.col("state").isin(*STATES)).groupBy(low("suburb").alias("g")).agg(F.array_sort(F.collect_set("state")).alias("states"))  # eight at most
    known = F.broadcast(known) if gaz.limit(MAX_GAZETTEER + 1).count() <= MAX_GAZETTEER else known
    s = df.select(key, stated(F.col("suburb"), F.col("estate_name"), F.col("lot_address")).alias("said"), F.nullif(named_locality(F.col("suburb"), F.col("estate_name")), F.lit("")).alias("loc"), "suburb", state_of_postcode(F.col("postcode")).alias("code"))
    asked = F.when(F.col("loc").isNotNull(), F.array(F.col("loc"))).otherwise(tails(F.col("suburb")))
    names = F.concat(F.transform(asked, lambda t, i: F.struct((i + 1).alias("rank"), low(t).alias("g"))), F.array(F.struct(F.lit(0).alias("rank"), low(F.coalesce("suburb", F.lit(""))).alias("g"))))
    hits = s.where("said IS NULL").select(key, F.explode(names).alias("x")).select(key, "x.*").where("g <> ''").join(known, "g")
    per = hits.groupBy(key).agg(F.max(F.when(F.col("rank") == 0, F.col("states"))).alias("whole"), F.min_by("states", F.when(F.col("rank") > 0, F.col("rank"))).alias("states"))
    j = s.join(per, key, "left")
    one, agrees = F.size("states") == 1, F.array_contains("states", F.col("code"))
    proof = F.when(F.col("said").isNotNull(), STATED).when(one, LOCALITY).when(F.coalesce(agrees, F.lit(False)), BOTH).when(F.coalesce(F.array_contains("whole", F.col("code")), F.lit(False)), WHOLE)
    return j.select(key, F.coalesce("said", F.when(proof == LOCALITY, F.get("states", F.lit(0))), F.when(proof.isNotNull(), F.col("code"))).alias("own_state"), proof.alias("proof"))
