"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources share the wanted total by weight, each up to ``max_epochs`` times its own size, the
   excess going to the others (water filling over one row per source).
2. Documents are cut into blocks. Each source's blocks are permuted by a keyed hash, once per epoch; the
   first ones, up to the target, are drawn. So no block is drawn twice in an epoch and a source misses its
   target by half a block at most. That fixes each source's exact quota of blocks.
3. A binary tree splits the quotas among the output shards: at each node the left half's share of every
   source is drawn from the multivariate hypergeometric law (by inversion, one source after another), so
   every shard gets the same number of blocks and the quotas add up exactly.
4. Each shard takes the next run of every source's permutation and orders its blocks by another hash.

Everything is DataFrame operations. Ranks come from a histogram of hash buckets (a thousand blocks each)
and a window inside one bucket, so a source that holds a third of all rows spreads over as many tasks as
it has buckets. Only one-row-per-source tables are ever gathered (``max_sources`` guards the broadcast).

Defined results: null or empty texts have size 0 and are never drawn from; rows equal in doc_id, source and
text are numbered and each is drawn on its own (which of equal rows is which is arbitrary); ties in the hash are broken by doc_id and block; other columns,
whatever their names, are not read; an empty table gives an empty result.
Draws depend on ids, sizes and ``seed`` only: reruns, other partitions and lost executors change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, let, materialize, words

WEIGHTS = (3, 1, 2)
FRACTION = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 256
SHARDS = 16
SEED = 7
#: Per-source tables with more rows are joined by a shuffle instead of a broadcast.
MAX_SOURCES = 50_000
#: Blocks of a hash bucket, on average.
BUCKET = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: ``source``, ``source_size``. Adds ``target``. Weights repeat over the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    total, used, w_used = F.sum("source_size").over(every) * float(fraction), F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", F.greatest(F.lit(0.0), total - used) / (F.sum("w").over(every) - w_used))
    # full sources are a prefix of this order; the first that isn't full sets the level for the rest
    t = t.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w"))).drop("w", "cap", "level", "full")


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are among ``drawn``, by inversion of u. The law is summed over eight standard
    deviations around its mean; what lies outside is below 1e-14."""
    f = lambda c: c.cast("double")
    z = F.struct(f(total).alias("tot"), f(marked).alias("K"), f(drawn).alias("n"))

    def inside(z: Column) -> Column:
        N, K, n = z.tot, z.K, z.n
        mean = n * K / F.greatest(N, F.lit(1.0))
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - K / F.greatest(N, F.lit(1.0))) * (N - n) / F.greatest(N - 1, F.lit(1.0))))
        lo = F.greatest(F.lit(0.0), n - (N - K), F.floor(mean - 8 * sd - 2)).cast("long")
        hi = F.greatest(lo, F.least(K, n, F.ceil(mean + 8 * sd + 2)).cast("long"))
        return let(F.struct(N.alias("tot"), K.alias("K"), n.alias("n"), lo.alias("lo"), hi.alias("hi")), search)

    def ratio(z: Column, k: Column) -> Column:  # P(k) / P(k - 1)
        return (z.K - k + 1) * (z.n - k + 1) / (k * (z.tot - z.K - z.n + k))

    def search(z: Column) -> Column:
        steps = F.when(z.hi > z.lo, F.sequence(z.lo + 1, z.hi)).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
        whole = F.aggregate(steps, start, lambda a, k: let(a.p * ratio(z, f(k)), lambda p: F.struct(p.alias("p"), (a.sum + p).alias("sum"))), lambda a: a.sum)
        begin = lambda goal: F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), z.lo.alias("k"), goal.alias("goal"))
        step = lambda a, k: F.when(a.sum > a.goal, a).otherwise(let(a.p * ratio(z, f(k)), lambda p: F.struct(p.alias("p"), (a.sum + p).alias("sum"), k.alias("k"), a.goal.alias("goal"))))
        return let(whole * u, lambda goal: F.aggregate(steps, begin(goal), step, lambda a: a.k))

    return let(z, inside)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas: ``skey``, ``quota``. Returns skey, ``cuts``: where each shard's run of the source's draws ends. shards: a power of two."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", F.col("quota").cast("long").alias("q")))).alias("qs")).select(F.lit(0).alias("node"), "qs")
    sum_q = lambda qs: F.aggregate(qs, F.lit(0).cast("long"), lambda a, x: a + x.q)
    for depth in range(shards.bit_length() - 1):

        def left(qs: Column) -> Column:
            start = F.struct(sum_q(qs).alias("tot"), F.floor(sum_q(qs) / 2).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

            def step(a: Column, x: Column) -> Column:
                u = _uniform(F.lit(seed), F.lit(depth), F.col("node"), x.skey)
                return let(hypergeometric(a.tot, x.q, a.n, u), lambda k: F.struct((a.tot - x.q).alias("tot"), (a.n - k).alias("n"), F.concat(a.out, F.array(k)).alias("out")))

            return F.aggregate(qs, start, step, lambda a: a.out)

        tree = tree.withColumn("l", left(F.col("qs")))
        lefts = F.zip_with("qs", "l", lambda x, k: F.struct(x.skey.alias("skey"), k.alias("q")))
        rights = F.zip_with("qs", "l", lambda x, k: F.struct(x.skey.alias("skey"), (x.q - k).alias("q")))
        tree = tree.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), lefts.alias("qs")), F.struct((F.col("node") * 2 + 1).alias("node"), rights.alias("qs")))).alias("t")).select("t.*")
    flat = tree.select("node", F.explode("qs").alias("x")).groupBy("x.skey").agg(F.sort_array(F.collect_list(F.struct("node", "x.q"))).alias("runs"))
    sums = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["sum"] + x.q).alias("sum"), F.concat(a.out, F.array(a["sum"] + x.q)).alias("out")), lambda a: a.out)
    return flat.select("skey", sums.alias("cuts"))


def _with_sources(df: DataFrame, per_source: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(per_source) if n <= MAX_SOURCES else per_source, "skey")


def draw_blocks(docs: DataFrame, weights=WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, block_words: int | None = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs: ``doc_id``, ``source``, ``size``, ``variant`` (tells texts apart). One row per block and epoch that some source may need: the document's columns,
    source_size, target, copies and copy (equal rows, and the number among them), epoch, block, block_size, ``shard`` (null: not drawn) and ``order_key`` (the order inside a shard).
    block_words None: a document is one block."""
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    docs = materialize(docs.groupBy("doc_id", "source", "size", "variant").agg(F.count("*").alias("copies")).withColumn("skey", skey))
    n_blocks = F.lit(1) if block_words is None else F.greatest(F.lit(1), F.ceil(F.col("size") / block_words)).cast("int")
    sizes = docs.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(n_blocks * F.col("copies")).alias("blocks"))
    targets = materialize(source_targets(sizes, weights, fraction, max_epochs))
    n = targets.count()
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("blocks") / BUCKET))).cast("int")
    t = targets.select("skey", "source_size", "target", bits.alias("bits"))
    b = _with_sources(docs, t, n)
    b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_epochs - 1), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") - 1)))))
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    b = b.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    b = b.withColumn("block_size", F.col("size") if block_words is None else F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    b = b.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id", "size", "variant", "copy", "block"))
    b = b.withColumn("bucket", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)"))).drop("bits")
    amount = F.col("block_size")
    place = ["skey", "epoch", "bucket"]
    sums = b.groupBy(*place).agg(F.sum(amount).alias("sum"), F.count("*").alias("cnt"))
    before = Window.partitionBy("skey").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*place, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"), F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("cnt0"))
    inside = Window.partitionBy(*place).orderBy("h", "doc_id", "size", "variant", "copy", "block")
    b = b.withColumn("rank", F.row_number().over(inside) - 1).withColumn("upto", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.join(offsets, place).withColumn("rank", F.col("rank") + F.col("cnt0")).withColumn("drawn", (F.col("block_size") > 0) & (F.col("sum0") + F.col("upto") - amount / 2 <= F.col("target")))
    b = materialize(b.drop("sum0", "cnt0", "upto", "bucket"))
    # ranks of a source's drawn blocks have gaps only where blocks are empty; quotas count up to the last one
    quotas = b.where("drawn").groupBy("skey").agg((F.max("rank") + 1).alias("quota"))
    cuts = materialize(split_quotas(quotas, shards, seed))
    b = b.join(F.broadcast(cuts) if n <= MAX_SOURCES else cuts, "skey", "left")
    shard = F.when(F.col("drawn"), F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))
    return b.withColumn("shard", shard).withColumn("order_key", F.xxhash64(F.lit(seed + 1), "h", "shard")).drop("cuts", "drawn", "h", "rank")


def sized(df: DataFrame) -> DataFrame:
    out = columns_of(df, doc_id="long", source="string", text="string")
    return out.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("variant"))


def op5(df: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, the words that the mix takes, and the shards that take them."""
    b = draw_blocks(sized(df))
    per = b.groupBy("doc_id", "source", "size", "variant", "copy", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("block_size"))), F.lit(0)).cast("long").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards")
    )
    return per.select("doc_id", "size", "source_size", "target", "taken", "shards")


def mix_documents(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """docs drawn whole: each row zero to ``max_epochs`` times, laid out by shard and shuffled inside each. Rows equal in id, source and text
    are drawn singly and come out with the smallest of their other columns."""
    same, rest = ["doc_id", "source", "_size", "_variant"], [c for c in columns if c not in ("doc_id", "source", "text")]
    keyed = docs.select(*[docs[c] for c in columns]).withColumns({"_size": F.size(words(F.col("text"))).cast("long"), "_variant": F.xxhash64("text")})
    blocks = draw_blocks(keyed.select("doc_id", "source", F.col("_size").alias("size"), F.col("_variant").alias("variant")), block_words=None, **how)
    drawn = blocks.where("shard IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_n"), F.col("variant").alias("_v"), "shard", "order_key", "copies")
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_n")) & (F.col("_variant") == F.col("_v"))
    out = keyed.join(drawn.where("copies = 1"), key).select(*columns, "shard", "order_key")
    if not (repeated := drawn.where("copies > 1")).isEmpty():
        one = keyed.join(repeated.select("_id", "_src", "_n", "_v").distinct(), key, "left_semi").groupBy(*same).agg(F.first("text").alias("text"), F.min(F.struct(*rest) if rest else F.lit(0)).alias("_x"))
        out = out.unionByName(one.select(*same, "text", *[F.col(f"_x.{c}") for c in rest]).join(repeated, key).select(*columns, "shard", "order_key"))
    return out.repartition(F.col("shard"), F.pmod("order_key", F.lit(64))).sortWithinPartitions("shard", "order_key").select(*columns)
