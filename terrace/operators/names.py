"""Names and attribution: who a row belongs to, on evidence that agrees, with the evidence measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

MIN_SHARED = 5
CODE_USES = 20
#: Numbers of a price that are held as bits (of two words); rows of a block, where very many have one number; pairs that a task may have to look at.
PLACES = 128
BLOCK_ROWS = 8192
TASK_PAIRS = 2**26
#: A price whose rows all meet: of so few rows, or if that is at most so many times the pairs that meet by numbers. Rows of its blocks; numbers of such prices that are broadcast.
FEW_ROWS = 256
MOST_TIMES = 4
BLOCK_PRICE = 2**15
MOST_SENT = 2**20
#: Confirmed spellings by squashed form (fixed values are the caller's; none are built in).
NOT_A_COMPANY = r"(?i)^\s*(?:level|lvl|floor|storey|story|stage|tower|building|block|unit|apt|apartment|precinct|release)\s*[-#]?\s*[0-9]*[a-z]?\s*$"


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def singular(c: Column) -> Column:
    """The last word without its plural s."""
    return F.regexp_replace(F.trim(c), r"(?i)(?<=\S{3})(?<!s)s$", "")


def is_domain(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)+$")


def domain_label(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^www\.", ""), r"\.(?:com\.au|net\.au|org\.au|com|net|org|au|io|co|id)$", "")
    return F.when(is_domain(c), F.split_part(bare, F.lit("."), F.lit(1)))


def canonical(names: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """names (name) with canonical. known: name, ord (the first spelling wins). Confirmed alias, then a domain's label, then the squashed form, then
    the singular; a domain is never a target; an unknown name stays as it is."""
    k = known.where(F.trim("name") != "").where(~is_domain(F.col("name")))
    first = F.split_part(F.regexp_replace(F.trim("name"), "[^A-Za-z0-9]+", " "), F.lit(" "), F.lit(1))

    def target(kind: str, key: Column) -> DataFrame:
        return k.select(F.lit(kind).alias("kind"), key.alias("key"), "name", "ord").where(F.col("key") != "").groupBy("kind", "key").agg(F.min_by("name", "ord").alias("target"))

    table = reduce(DataFrame.unionByName, [target("label", F.when(F.length(first) >= 4, F.lower(first)).otherwise("")), target("squash", squash(F.col("name"))), target("plural", squash(singular(F.col("name"))))])
    if aliases is not None:
        table = table.unionByName(aliases.select(F.lit("alias").alias("kind"), F.col("key"), F.col("target")))
    n = F.col("name")
    keys = [(0, "alias", squash(n)), (1, "label", domain_label(n)), (2, "squash", F.when(~is_domain(n), squash(n))), (3, "plural", F.when(~is_domain(n), squash(singular(n))))]
    asked = names.select("name").distinct().select("name", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("kind"), v.alias("key")) for r, t, v in keys])).alias("q")).select("name", "q.*").where("key IS NOT NULL AND key <> ''")
    best = asked.join(table, ["kind", "key"]).groupBy("name").agg(F.min(F.struct("rule", "target")).alias("b"))
    return names.join(best.select(F.col("name").alias("_n"), F.col("b.target").alias("_t")), F.col("name") == F.col("_n"), "left").withColumn("canonical", F.coalesce("_t", F.trim("name"))).drop("_n", "_t")


def lengths_of(df: DataFrame, length: Column) -> DataFrame:
    """One row: the distinct lengths."""
    return df.agg(F.collect_set(length).alias("lengths"))


def pieces(df: DataFrame, text: str, lengths: DataFrame) -> DataFrame:
    """df with ``piece``: every distinct stretch of the text that has one of the lengths (one row: lengths)."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, n))
    return df.join(F.broadcast(lengths)).withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(text)), at))))).drop("lengths")


def numbers_of(text: Column) -> Column:
    """Every distinct number of a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.round(F.regexp_replace(x, ",", "").try_cast("double"), 2))))


def _said(rows: DataFrame, price: str, numbers: str) -> DataFrame:
    """id, p (the rounded price), v: each number of a row once."""
    return rows.select("id", F.round(F.col(price)).alias("p"), F.explode(F.array_distinct(numbers)).alias("v")).where("p IS NOT NULL AND v IS NOT NULL")


def _often(said: DataFrame) -> DataFrame:
    """p, v, n (rows of the price that have the number, two or more), r: its place among the PLACES most frequent numbers of the price, else null; g: one for
    each p and v, once this is written."""
    often = said.groupBy("p", "v").agg(F.count("*").alias("n")).where("n > 1")
    most = often.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), F.desc("v")))).where(F.col("r") <= PLACES)
    return often.join(most.select("p", "v", "r"), ["p", "v"], "left").withColumn("g", F.monotonically_increasing_id())


def _prefixes(said: DataFrame, often: DataFrame, least: int) -> DataFrame:
    """id, p and v, n, r, g of each row under the rarest of its numbers, with all of the row's: places as bits of w0 and w1, the others (g) rare first in rest (null if none)."""
    place = lambda i: F.when(F.col("r").between(64 * i + 1, 64 * i + 64), F.expr(f"shiftleft(1L, r - {64 * i + 1})"))
    bits = [F.coalesce(F.bit_or(place(i)), F.lit(0)).alias(f"w{i}") for i in range(PLACES // 64)]
    ordered = said.join(often.hint("merge"), ["p", "v"]).groupBy("id", "p").agg(F.array_sort(F.collect_list(F.struct("n", "v", "r", "g"))).alias("all"), *bits).where(F.size("all") >= least)  # the numbers of one row
    rest = F.transform(F.filter("all", lambda x: x.r.isNull()), lambda x: x.g)
    return ordered.select("id", "p", "w0", "w1", F.when(F.size(rest) > 0, rest).alias("rest"), F.explode(F.slice("all", F.lit(1), F.size("all") - (least - 1))).alias("x")).select("id", "p", "w0", "w1", "rest", "x.*")


def fingerprint_prefixes(rows: DataFrame, price: str = "price", numbers: str = "numbers", least: int = MIN_SHARED) -> DataFrame:
    """Each row (id, p: the rounded price) under the rarest of its numbers (v). Two rows that share ``least`` numbers share one of all but the last
    least - 1 of each, in any one order of the numbers; taken rare first, common numbers are hardly ever among those. Numbers that one row alone has are
    left out before, so a row with too few others is not there at all."""
    said = _said(rows, price, numbers)
    return _prefixes(said, _often(said), least)


def _cells(rows: DataFrame, n: Column, block: int) -> DataFrame:
    """The n rows of a key dealt to cells (x, y) of its blocks: those of block x may be a pair's first (as_a), those of block y its second (as_b). Few rows are one
    cell; of very many, no cell holds more than two blocks."""
    k, i, t = F.col("k"), F.col("i"), F.col("t")
    other = i - k + (i - k >= t).cast("long")
    cells = rows.withColumn("k", F.ceil(n / block)).withColumn("t", F.pmod(F.xxhash64("id"), k)).withColumn("i", F.explode(F.sequence(F.lit(0), 2 * k - 2)))
    return cells.withColumn("x", F.when(i < k, t).otherwise(other)).withColumn("y", F.when(i < k, i).otherwise(t)).withColumn("as_a", i < k).withColumn("as_b", (i >= k) | (i == t))


def _dealt(prefixes: DataFrame, tasks: int) -> DataFrame:
    """The rows of a number, by cells of its blocks."""
    return _cells(prefixes, F.col("n"), BLOCK_ROWS).select("g", "x", "y", "as_a", "as_b", "id", "r", "w0", "w1", "rest").repartition(tasks, "g", "x", "y")


def _tasks(spark: SparkSession, pairs: int) -> int:
    return max(1, -(-pairs // TASK_PAIRS), min(spark.sparkContext.defaultParallelism, pairs // (TASK_PAIRS // 64)))


def fingerprint_matches(rows: DataFrame, price: str = "price", numbers: str = "numbers", least: int = MIN_SHARED) -> DataFrame:
    """a, b, shared: pairs of rows (id, once each) of one rounded price that share ``least`` other numbers. The rows of a price all meet where hardly more pairs do so
    than by numbers (and its numbers have bits all); a row then travels once. Elsewhere rows meet under the rare numbers of their prefixes. Tasks are as many as
    the pairs that may meet ask for, not the bytes. rows is read several times."""
    spark, rows = rows.sparkSession, rows.select("id", F.round(F.col(price)).alias("p"), F.col(numbers).alias("numbers")).where("p IS NOT NULL")
    often = cut(_often(_said(rows, "p", "numbers")))
    met, all_pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2, F.col("m").cast("double") * (F.col("m") - 1) / 2
    placed = F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "v"))))  # PLACES at most
    prices = often.groupBy("p").agg(F.count("*").alias("n_often"), F.sum(met).alias("met"), placed.alias("placed")).join(rows.groupBy("p").agg(F.count("*").alias("m")), "p")
    whole = (F.col("n_often") <= PLACES) & ((F.col("m") <= FEW_ROWS) | (all_pairs <= MOST_TIMES * F.col("met")))
    prices = cut(prices.withColumn("whole", whole))
    n = prices.groupBy("whole").agg(F.sum(F.when(F.col("whole"), all_pairs).otherwise(F.col("met"))).alias("pairs"), F.sum("n_often").alias("numbers"))
    n = {r.whole: r for r in n.collect()}  # two rows at most
    found = []
    if True in n or not n:
        known = prices.where("whole").select("p", "m", F.transform("placed", lambda x: x.v).alias("vs"))
        found.append(_among_all(rows.join(F.broadcast(known) if n and n[True].numbers <= MOST_SENT else known, "p"), least, _tasks(spark, int(n[True].pairs) if n else 0)))
    if False in n:
        others = prices.where(~F.col("whole")).select("p")
        by_number = rows.join(others, "p", "left_semi") if True in n else rows
        found.append(_by_numbers(_prefixes(_said(by_number, "p", "numbers"), often, least), least, _tasks(spark, int(n[False].pairs))))
    return reduce(DataFrame.unionByName, found)


def _among_all(rows: DataFrame, least: int, tasks: int) -> DataFrame:
    """The pairs among all rows of a price. rows: id, p, numbers, m (rows of the price), vs (the price's numbers by their places)."""
    at = F.transform(F.array_distinct("numbers"), lambda v: F.array_position(F.col("vs"), v))
    word = lambda i: F.expr(f"coalesce(aggregate(at, 0L, (w, k) -> CASE WHEN k BETWEEN {64 * i + 1} AND {64 * i + 64} THEN w | shiftleft(1L, CAST(k AS INT) - {64 * i + 1}) ELSE w END), 0L)").alias(f"w{i}")
    placed = rows.select("id", "p", "m", F.explode(F.array(F.filter(at, lambda k: k > 0))).alias("at"))  # exploded, so that it is computed once
    bits = placed.where(F.size("at") >= least).select("id", "p", "m", word(0), word(1))
    side = F.col("as_a").cast("int") + 2 * F.col("as_b").cast("int")
    e = _cells(bits, F.col("m"), BLOCK_PRICE).select("p", "x", "y", side.alias("side"), "id", "w0", "w1").repartition(tasks, "p", "x", "y")
    # both sides read every column, and no condition is on one side alone: so rows are dealt out once for both
    a = e.select("p", "x", "y", F.col("side").alias("sa"), F.col("id").alias("a"), F.col("w0").alias("a0"), F.col("w1").alias("a1"))
    b = e.select("p", "x", "y", F.col("side").alias("sb"), F.col("id").alias("b"), F.col("w0").alias("b0"), F.col("w1").alias("b1"))
    shared = F.expr("bit_count(a0 & b0) + bit_count(a1 & b1)")
    return a.join(b.hint("merge"), ["p", "x", "y"]).where((F.col("a") < F.col("b")) & (shared >= least) & F.expr("(sa & 1) + (sb & 2) = 3")).select("a", "b", shared.cast("long").alias("shared"))


def _by_numbers(prefixes: DataFrame, least: int, tasks: int) -> DataFrame:
    """The pairs under the numbers of prefixes: each is taken at the rarest that both have, so it is verified and returned once."""
    e, keys = _dealt(prefixes, tasks), ["g", "x", "y"]
    # the row's bits of numbers rarer than v: none of the places if v has none itself
    rarer = lambda i: F.expr(f"CASE WHEN r <= {64 * i} THEN w{i} WHEN r < {64 * i + 64} THEN w{i} & shiftleft(-1L, r - {64 * i}) ELSE 0L END")
    a = e.where("as_a").select(*keys, "r", F.col("id").alias("a"), F.col("w0").alias("a0"), F.col("w1").alias("a1"), F.col("rest").alias("ra"), rarer(0).alias("h0"), rarer(1).alias("h1"))
    b = e.where("as_b").select(*keys, F.col("id").alias("b"), F.col("w0").alias("b0"), F.col("w1").alias("b1"), F.col("rest").alias("rb"))
    both = F.array_intersect("ra", "rb")
    n_rest = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), F.size(both)).otherwise(0)
    rarest = F.expr("((h0 & b0) | (h1 & b1)) = 0") & F.when(F.col("r").isNull(), F.get(both, F.lit(0)) == F.col("g")).otherwise(n_rest == 0)
    shared = F.expr("bit_count(a0 & b0) + bit_count(a1 & b1)") + n_rest
    return a.join(b.hint("merge"), keys).where((F.col("a") < F.col("b")) & rarest & (shared >= least)).select("a", "b", shared.cast("long").alias("shared"))


def code_owners(rows: DataFrame, prefix: str, builder: str, uses: int = CODE_USES) -> DataFrame:
    """Prefixes that one builder alone uses, often enough."""
    return rows.groupBy(prefix).agg(F.count_distinct(builder).alias("builders"), F.count("*").alias("uses"), F.min(builder).alias("owner")).where((F.col("builders") == 1) & (F.col("uses") >= uses)).select(prefix, "owner", "uses")


def file_titles(labels: DataFrame, file: str, row: str, label: str) -> DataFrame:
    """Labels that stand on every row of a file."""
    all_ = labels.groupBy(file).agg(F.count_distinct(row).alias("rows"))
    each = labels.groupBy(file, label).agg(F.count_distinct(row).alias("n"))
    return each.join(all_, file).where("n = rows").select(file, label, "rows")


def relabels(rows: DataFrame, label: str, key: str, least: int = 3, share: float = 0.4) -> DataFrame:
    """Pairs of labels that share ``least`` keys and ``share`` of the smaller one's: one company under two names."""
    l = rows.select(F.col(label).alias("l"), F.col(key).alias("k")).where("l IS NOT NULL AND k IS NOT NULL").distinct()
    size = l.groupBy("l").agg(F.count("*").alias("size"))
    both = l.select(F.col("l").alias("a"), "k").join(l.select(F.col("l").alias("b"), "k"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(size.select(F.col("l").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("l").alias("b"), F.col("size").alias("sb")), "b")
    return out.where((F.col("shared") >= least) & (F.col("shared") >= share * F.least("sa", "sb"))).select("a", "b", "shared")


def merge_channels(evidence: DataFrame) -> DataFrame:
    """evidence: id, channel, answer. One distinct answer is accepted, several are a conflict."""
    g = evidence.where("answer IS NOT NULL").groupBy("id").agg(F.count_distinct("answer").alias("n"), F.min("answer").alias("one"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))
    return g.select("id", F.when(F.col("n") == 1, F.col("one")).alias("answer"), F.when(F.col("n") == 1, "accepted").otherwise("conflict").alias("status"), "channels")


def holdout(rows: DataFrame, key: str, builder: str) -> DataFrame:
    """How well a key names a row's builder from the other rows: recovered (without the row itself) right or wrong, and how often the key would name
    someone although the true builder's rows are gone. Counts per key suffice: no row meets another."""
    k = rows.where(F.col(key).isNotNull() & F.col(builder).isNotNull())
    per = k.groupBy(key, builder).agg(F.count("*").alias("own"))
    tot = per.groupBy(key).agg(F.sum("own").alias("total"), F.count("*").alias("builders"))
    j = per.join(tot, key)
    others = F.col("builders") - F.when(F.col("own") == 1, 1).otherwise(0)  # builders left once the row itself is out
    alone = (others == 1) & (F.col("total") > 1)
    right = alone & (F.col("own") > 1)
    gone = F.col("builders") - 1 == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("own"))), F.lit(0))
    return j.agg(F.sum("own").alias("rows"), n(right).alias("recovered_right"), n(alone & ~right).alias("recovered_wrong"), n(gone).alias("false_positive"))


def unique_match(docs: DataFrame, candidates: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, listing_id, rule: the first rule that fits decides; if it fits several listings, the document stays without one. Of the listings of a key only the
    first and the last id matter, so no document meets them all."""
    found = []
    for n, (name, keys) in enumerate(rules):
        c = candidates.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min("id").alias("low"), F.max("id").alias("high"))
        found.append(docs.join(c, keys).select("doc_id", F.lit(n).alias("n"), F.lit(name).alias("rule"), "low", "high"))
    per = reduce(DataFrame.unionByName, found).groupBy("doc_id", "n", "rule").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    first = per.groupBy("doc_id").agg(F.min_by(F.struct("rule", "low", "high"), "n").alias("x"))
    return first.where("x.low = x.high").select("doc_id", F.col("x.low").alias("listing_id"), "x.rule")
