"""Repairs and enrichment: values that cannot be, duplicates by text, relabelled companies, states that a row proves itself, header columns, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.values import STATE_NAMES, STATES, lookup
from ..session import cut

#: Highest counts, and the smallest house, that a stored value may have.
MOST_ROOMS, LEAST_HOUSE = 12, 40.0


def null_impossible(df: DataFrame) -> DataFrame:
    """Counts over twelve, houses under 40 square metres and blank urls become null."""
    out = {c: F.when(F.col(c) <= MOST_ROOMS, F.col(c)) for c in ("bedrooms", "bathrooms", "car_spaces") if c in df.columns}
    if "house_sqm" in df.columns:
        out["house_sqm"] = F.when(~((F.col("house_sqm") > 0) & (F.col("house_sqm") < LEAST_HOUSE)), F.col("house_sqm"))
    return df.withColumns(out | {c: blank(F.col(c)) for c in df.columns if c.endswith("_url")})


def project_names(df: DataFrame) -> DataFrame:
    """Where a name belongs to a project's developer, the builder is blank and the developer has it."""
    project = F.col("attribution_scope") == "project"
    return df.withColumn("developer_name", F.when(project, F.col("builder_name"))).withColumn("builder_name", F.when(project, F.lit(None)).otherwise(F.coalesce(blank(F.col("builder_name")), F.lit("not stated"))))


def duplicates_by_text(df: DataFrame, text: str, weights: dict[str, int], fields: list[str]) -> DataFrame:
    """id, keeper: rows of a repeated text that say nothing their keeper doesn't. The keeper is the most complete, then the latest seen, then the first."""
    full = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.lit(w)).otherwise(0) for c, w in weights.items()), F.lit(0))
    top = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.max(F.struct(full.alias("full"), "last_seen", (-F.col("id")).alias("first"), *[F.col(f).alias(f"k_{f}") for f in fields])).alias("k"), F.count("*").alias("n")).where("n > 1")
    j = df.join(top, text).withColumn("keeper", -F.col("k.first")).where("id <> keeper")
    says = F.lit(True)
    for f in fields:
        v = F.nullif(F.col(f).cast("string"), F.lit(""))
        says = says & (v.isNull() | v.eqNullSafe(F.nullif(F.col(f"k.k_{f}").cast("string"), F.lit(""))))
    return j.where(says).select("id", "keeper")


def label_classes(pairs: DataFrame) -> DataFrame:
    """label, class for pairs (a, b) of one company's labels: the smallest label that can be reached. Each round takes the least among neighbours, then that
    label's own, so a chain of n labels takes about log n rounds; it ends when nothing moves."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    at = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")))
    moved = True
    while moved:
        seen = both.join(at.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        # a class takes the least that any of its labels sees, and its labels follow
        hook = at.join(seen, "a").groupBy("c").agg(F.min("near").alias("near")).select("c", F.least("c", "near").alias("to"))
        step = at.join(hook, "c").select("a", "c", "to")
        jump = step.select(F.col("a").alias("to"), F.col("to").alias("far"))
        new = cut(step.join(jump, "to").select("a", F.least("to", "far").alias("n"), (F.least("to", "far") < F.col("c")).alias("moved")))
        at, moved = new.select("a", F.col("n").alias("c")), not new.where("moved").isEmpty()
    return at.select(F.col("a").alias("label"), F.col("c").alias("class"))


def own_state(text: Column, localities: Column) -> Column:
    """The state that a row proves itself: a part of the text that is a state, else the only state of the localities named between separators
    (``localities``: a map from lower-cased name to its states)."""
    parts = F.transform(F.split(text, r"[/|,]"), lambda p: F.lower(F.trim(p)))
    named = F.filter(F.transform(parts, lambda p: F.coalesce(F.when(F.upper(p).isin(*STATES), F.upper(p)), lookup(p, STATE_NAMES))), lambda s: s.isNotNull())
    found = F.filter(F.transform(parts, lambda p: F.element_at(localities, p)), lambda s: s.isNotNull() & (F.size(s) == 1))
    one = F.array_distinct(F.transform(found, lambda s: F.get(s, F.lit(0))))
    return F.coalesce(F.when(F.size(F.array_distinct(named)) == 1, F.get(named, F.lit(0))), F.when(F.size(one) == 1, F.get(one, F.lit(0))))


def header_columns(rows: DataFrame, part: list[str], order: str, is_header: Column) -> DataFrame:
    """part, row, at, label, value: each data cell under what the header rows above it say of its column. Consecutive header rows add up."""
    w = Window.partitionBy(*part).orderBy(order)
    head = is_header.cast("int")
    starts = ((head == 1) & (F.coalesce(F.lag(head).over(w), F.lit(0)) == 0)).cast("int")
    r = rows.withColumn("_h", head).withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = r.select(*part, order, "run", "_h", F.posexplode("cells").alias("at", "value"))
    labels = cells.where("_h = 1 AND trim(value) <> ''").groupBy(*part, "run", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: F.lower(F.trim(x["value"]))), " ").alias("label"))
    return cells.where("_h = 0").join(labels, [*part, "run", "at"], "left").select(*part, order, "at", "label", "value")


def source_links(df: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """id, primary, others: a row's http links, each url once, the nearest to the lot first. ranks: column to rank."""
    items = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(c).alias("kind"), F.trim(F.col(c)).alias("url")) for c, r in ranks.items()])
    web = F.array_sort(F.filter(items, lambda x: x.url.rlike("(?i)^https?://")))
    out = df.select("id", web.alias("_w"))
    firsts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda i: F.struct(F.get("_w", i - 1).alias("x"), F.array_position(F.transform("_w", lambda y: y.url), F.get("_w", i - 1).url).alias("p"), i.alias("i"))), lambda z: z.p == z.i)
    out = out.withColumn("_u", firsts)
    return out.select("id", F.get("_u", F.lit(0)).x.kind.alias("primary_kind"), F.get("_u", F.lit(0)).x.url.alias("primary_url"), F.size("_u").alias("n_links"))


def directory_upsert(old: DataFrame, new: DataFrame, key: str, texts: list[str], flags: list[str]) -> DataFrame:
    """A text is replaced by one that isn't blank; a flag, once set, stays."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    text = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    flag = lambda c: F.greatest(F.coalesce(f"o.{c}", F.lit(0)), F.coalesce(f"n.{c}", F.lit(0))).alias(c)
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *map(text, texts), *map(flag, flags))


def route(urls: DataFrame, handlers: DataFrame) -> DataFrame:
    """urls with the handler of their host or of a parent domain, the longest fit first; none is a row of its own kind, never an error. handlers: domain, handler."""
    labels = F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((n - i).alias("len"), F.array_join(F.slice(labels, i, n), ".").alias("domain")))
    e = urls.select("id", F.explode(ends).alias("d")).select("id", "d.*").join(F.broadcast(handlers), "domain")
    best = e.groupBy("id").agg(F.max_by("handler", "len").alias("handler"))
    return urls.join(best, "id", "left").withColumn("handler", F.coalesce("handler", F.lit("unsupported")))


def crawl(links: DataFrame, start: DataFrame, depth: int, most: int) -> DataFrame:
    """url, depth: breadth first over stored links (src, dst), ``most`` new pages a round (a bounded crawl), each page once."""
    seen = cut(start.select(F.col("url"), F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        new = links.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = cut(new.orderBy("url").limit(most).withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen
