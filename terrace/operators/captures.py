"""Captures: identity, duplicates, supersession, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order given. (``dropDuplicates`` keeps any.)"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def variant_ordinals(df: DataFrame, key: str, signature: list[str], row: str) -> DataFrame:
    """Within equal keys, distinct signatures are numbered 0, 1, ... by first appearance; equal repeats share a number."""
    first = F.min(row).over(Window.partitionBy(key, *signature))
    return df.withColumn("_f", first).withColumn("variant_ordinal", (F.dense_rank().over(Window.partitionBy(key).orderBy("_f")) - 1).cast("int")).drop("_f")


def same_listing(df: DataFrame, facts: list[str], order: list[Column], row: str) -> DataFrame:
    """Rows equal in facts (nulls equal) collapse to the best by order; the first appearance of the group is kept as ``first_row``."""
    w = Window.partitionBy(*facts)
    return first_by(df.withColumn("first_row", F.min(row).over(w)), facts, order)


def losers(df: DataFrame, key: list[str], fresh: list[str], nulls: bool = True) -> DataFrame:
    """id, winner for every row that a fresher one of its key replaces. Rows with a null in ``key`` are to be left out before, or are alike in it. Without nulls
    rows that are dealt out by their key already stay where they are."""
    top = df.groupBy(*key).agg(F.max(F.struct(*fresh, "id")).alias("_w"), F.count("*").alias("_n")).where("_n > 1")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if nulls else F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    return df.alias("a").join(top.alias("b"), same).select("a.id", F.col("b._w.id").alias("winner")).where("id <> winner")


def supersede(df: DataFrame, lot: list[str], lot_named: list[str], text: list[str], fresh: list[str]) -> DataFrame:
    """id, survivor: rows replaced by a fresher capture of the same lot or of the same source line. The lot decides first; a row that
    lost keeps that winner; winners that lose themselves are followed to the end (pointer doubling, which ends because freshness only grows).
    A row that has come to its end is not followed again."""
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in lot_named])
    said = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in text])
    one, two = losers(df.where(named), lot, fresh), losers(df.where(said), text, fresh, nulls=False)
    both = one.select("id", F.col("winner").alias("lot"), F.lit(None).cast(two.schema["winner"].dataType).alias("text")).unionByName(two.select("id", F.lit(None).cast(one.schema["winner"].dataType).alias("lot"), F.col("winner").alias("text")))
    at = both.groupBy("id").agg(F.coalesce(F.max("lot"), F.max("text")).alias("winner"))  # one row of each at most
    ended, open_ = None, at
    while True:  # freshness only grows along the links, so they have no cycle and doubling ends
        nxt = open_.alias("x").join(at.select(F.col("id").alias("_i"), F.col("winner").alias("_w")), F.col("x.winner") == F.col("_i"), "left")
        step = cut(nxt.select("x.id", F.coalesce("_w", "x.winner").alias("winner"), F.col("_w").isNotNull().alias("moved")))
        stay = step.where("NOT moved").drop("moved")
        ended = stay if ended is None else ended.unionByName(stay)
        open_ = step.where("moved").drop("moved")
        if open_.isEmpty():
            return ended.select("id", F.col("winner").alias("survivor"))
        at = ended.unionByName(open_)


#: How a column takes a new reading.
ALWAYS, STATED, FILL, NEVER = "always", "if stated", "if blank", "never"


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str], previous: dict[str, str]) -> DataFrame:
    """Idempotent upsert: one row per key with ``outcome`` (new, updated, unchanged, kept). rules name how each column takes a new reading;
    previous names, for a column, the one that keeps its last value when it changes."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    was, now = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    out, changed = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)], F.lit(False)
    for c, rule in rules.items():
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        take = {ALWAYS: now, STATED: now & ~empty(b), FILL: now & empty(a) & ~empty(b), NEVER: F.lit(False)}[rule]
        v = F.when(was & now, F.when(take, b).otherwise(a)).when(was, a).otherwise(b)
        differs = was & now & take & ~a.eqNullSafe(b)
        changed = changed | (differs if rule != ALWAYS else F.lit(False))
        out.append(v.alias(c))
        if c in previous:
            out.append(F.when(differs, a).otherwise(F.col(f"o.{previous[c]}")).alias(previous[c]))
    outcome = F.when(~was, "new").when(~now, "kept").when(changed, "updated").otherwise("unchanged")
    return both.select(*out, outcome.alias("outcome"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def registers(df: DataFrame, key: str, rules: dict[str, str], previous: dict[str, str], time: list[str]) -> DataFrame:
    """Captures as register rows: for each column of rules a struct (at, value), null where this capture has no say, and for each column of previous
    (stated columns only) an empty register of the value before. ``time`` orders captures and has to tell them apart."""
    if odd := [c for c in previous if rules[c] != STATED]:
        raise ValueError(f"only stated columns keep their value before: {odd}")
    at, out = F.struct(*time).alias("at"), [F.col(key)]
    for c, rule in rules.items():
        said = F.struct(at, F.col(c).alias("value"))
        out.append((F.when(~is_blank(F.col(c)), said) if rule in (STATED, FILL) else said).alias(c))
    kinds = {c: rows.dataType.simpleString() for rows in df.select(*out).schema for c in [rows.name]}
    return df.select(*out, *[F.lit(None).cast(kinds[c]).alias(p) for c, p in previous.items()])


def settle(rows: DataFrame, key: str, rules: dict[str, str], previous: dict[str, str]) -> DataFrame:
    """One register row per key, whatever the order and number of the rows that come together: a settled row is a register row again, and settling is
    associative. The latest capture counts for ALWAYS, the latest with a value for STATED, the earliest with one for FILL, the earliest for NEVER. The
    value before is the latest stated one that differs from the current one."""
    pick = {ALWAYS: F.max, STATED: F.max, FILL: F.min, NEVER: F.min}
    now = rows.groupBy(key).agg(*[pick[rule](c).alias(c) for c, rule in rules.items()])
    if not previous:
        return now
    # what was stated otherwise is known once the current value is: a row per key goes back to the rows, and the rest is summed up again
    current = now.select(F.col(key).alias("_key"), *[F.col(f"{c}.value").alias(f"_{c}") for c in previous])
    other = lambda r, c: F.when(~F.col(f"{r}.value").eqNullSafe(F.col(f"_{c}")), F.col(r))
    before = rows.join(current, F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key").agg(*[F.max(F.greatest(other(c, c), other(p, c))).alias(p) for c, p in previous.items()])
    return now.join(before, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def settled_values(state: DataFrame, key: str, rules: dict[str, str], previous: dict[str, str]) -> DataFrame:
    """The plain table that settled registers stand for."""
    return state.select(key, *[F.col(f"{c}.value").alias(c) for c in (*rules, *previous.values())])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]))
