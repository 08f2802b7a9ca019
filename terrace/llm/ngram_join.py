"""N-gram Jaccard join by a grouped prefix join: documents of equal prefix and size form a group, groups
are joined on prefix tokens and filtered, and only then expanded and verified on whole shingle sets.

1. Equal sets collapse to one class (pre-aggregated by a 128-bit fingerprint). Every text is hashed once for that.
2. A part of all shingles (by hash, somewhat more than a prefix) is counted over the whole corpus by a shuffle. A class whose shingles are so often
   its own that the rest can't reach the similarity has no partner and is done, which holds for most documents of a web corpus.
3. Only the other classes' texts are read again. Their shingles are ordered, those that a bounded sample finds common last (any total
   order is right, so the sample changes the cost and never the result). Classes of equal (size, prefix) form a group; a group carries
   bounds of its members' 512-bit parity sketches, whose distance is never more than the sets' symmetric difference.
4. Groups that share a prefix token are compared in rounds: each token's groups are held against a few centres (not all pairs), filtered by size, place
   of the token and sketch; the nearest candidate of each class is verified on whole sets and joined into components. A token whose groups
   are all in one component needs nothing more. What is left after the rounds is compared pair by pair across components, with the same
   filters, and verified. A pair inside one component is never needed, since components are the result, so no link between components is lost and a
   large group of near copies costs a few times its size.
5. Components come from label passing with pointer jumping over written tables.

Defined results: a text without words (or null) has an empty set, is linked with nothing and is its own component; fewer than
``k`` words give one shingle, the whole sequence; repeated rows and exact copies fall into one class; of rows of one id with several
texts each has its own text's component; rows without a doc_id keep their n_shingles and get a null component; ties (equal hashes, equal distances) are
broken by id and change no result; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, materialize

#: Words of a shingle, and the similarity as a percentage.
K = 4
PERCENT = 85
#: Documents of the sample that finds common shingles, about; shingles seen in fewer of them than ``MIN_SEEN`` count as rare; entries of the list at most.
SAMPLE_DOCS = 10_000
MIN_SEEN = 3
MAX_COMMON = 1 << 17
#: Shingles that are counted, as a multiple of a prefix's share of a set.
PROBE = 1.6
#: Centres of a token in a round; the first round takes one of so many tokens; rounds at most before the last step; pairs per row that may be
#: left for the last step to come earlier.
CENTRES = 6
THIN = 8
ROUNDS = 3
LEFT_PER_ROW = 2
#: Bits of a filter that only saves traffic: 8 MB.
MAX_BITS = 1 << 26
#: Longs of a sketch.
SKETCH = 8

_ODD = np.uint64(0x9E3779B185EBCA87)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words longer than this are hashed on their own.
LONG = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_SIGN = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The step's powers and their inverses, n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        back = np.uint64(pow(int(_STEP), -1, 1 << 64))
        for k, x in enumerate((_STEP, back)):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial over its bytes' random signs, all words of a text at once from running sums."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_SIGN[b] * up[: len(b)], out=run[1:])
    size = end - start
    out = _mix((run[end] - run[start]) * down[start] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(k, len(h))
    out, n = np.full(len(h) - k + 1, k, np.uint64), len(h) - k + 1
    for i in range(k):
        out = out * _ODD + h[i : i + n]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _need(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with a partner, at least: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def common_shingles(docs: DataFrame, k: int, n_docs: int) -> np.ndarray:
    """Shingles seen in MIN_SEEN or more sampled documents, rarest first: at most MAX_COMMON."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"t": shingle_set(t, k).view(np.int64)})

    counted = part.select("text").mapInPandas(explode, "t long").groupBy("t").count().where(F.col("count") >= MIN_SEEN)
    top = counted.orderBy(F.col("count").desc(), "t").limit(MAX_COMMON).toArrow()  # at most MAX_COMMON rows
    return top["t"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


class _Order:
    """A total order of shingles: by hash, then the common ones, rarest first."""

    def __init__(self, common: np.ndarray):
        self.rank = np.argsort(common)
        self.common = common[self.rank]
        bits = np.zeros(1 << 16, np.uint64)
        p = _bit_places(self.common, 1 << 22)
        np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        self.maybe = bits

    def sort(self, s: np.ndarray) -> np.ndarray:
        if len(self.common) and len(some := np.flatnonzero(_passes(s, self.maybe))):
            at = np.minimum(np.searchsorted(self.common, s[some]), len(self.common) - 1)
            hit = self.common[at] == s[some]
            return np.concatenate([np.delete(s, some[hit]), s[some[hit]][np.argsort(self.rank[at[hit]])]])
        return s


def _digest(s: np.ndarray) -> tuple[bytes | None, int]:
    """16 bytes that stand for a set (None for the empty one), and eight of them as a long."""
    fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
    return fp, int.from_bytes(fp[:8], "little", signed=True) if fp else 0


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, fp (16 bytes of the set; null if empty), f (eight of them), probed: the shingles that are counted."""
    probe = np.uint64(int(min(1.0, PROBE * (100 - percent) / 100) * 0xFFFF))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, key, t in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                s = shingle_set(t, k)
                rows.append((doc_id, key, len(s), *_digest(s), s[(s & np.uint64(0xFFFF)) <= probe].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n", "fp", "f", "probed"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(each, "doc_id long, text_key long, n long, fp binary, f long, probed array<long>")


def _bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    return _mix(keys.astype(np.uint64)) & np.uint64(bits - 1)


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """Bits (by 64) of a filter over the one long column of keys, 16 or more for each, MAX_BITS at most: a fuller filter lets more through, never less."""
    bits = min(MAX_BITS, 1 << max(10, (16 * n - 1).bit_length()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = _bit_places(batch.iloc[:, 0].to_numpy(np.int64), bits)
            yield pd.DataFrame({"at": (p >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (p & np.uint64(63))).view(np.int64)})

    got = keys.mapInPandas(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most MAX_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[got["at"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return out


def _passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    p = _bit_places(keys, len(words) * 64)
    return (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _with_candidates(known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """doc_id (the smallest), id of the classes whose counted shingles don't rule out a partner: of n shingles a partner shares n * percent / 100 at least,
    none of which is the class's own."""
    owned = known.select("f", F.explode("probed").alias("t")).groupBy("t").agg(F.min("f").alias("f"), F.max("f").alias("other")).where("f = other").groupBy("f").agg(F.count("*").alias("own"))
    left = classes.join(owned, "f", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * 100 >= F.col("n") * percent)
    return materialize(left.select(F.col("label").alias("doc_id"), F.col("f").alias("id")))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """For the wanted classes (doc_id, id): n, s (the whole set), g (of size and prefix), prefix and b0.. (the parity sketch). Texts stay where they are; a
    filter of bounded size keeps most other texts from being hashed."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bloom(wanted.select("doc_id"), wanted.count()), _Order(common)))  # at most 16 bytes * MAX_COMMON and MAX_BITS
    names = ["doc_id", "id", "n", "s", "g", "prefix", *[f"b{j}" for j in range(SKETCH)]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe, order = shared.value
        for batch in batches:
            batch, rows = batch[_passes(batch["doc_id"].to_numpy(np.int64), maybe)], []
            for i, t in zip(batch["doc_id"], batch["text"]):
                if n := len(s := shingle_set(t, k)):
                    p = order.sort(s)[: n - _need(n, percent) + 1]
                    parity = np.bincount((s >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                    sketch = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
                    rows.append((i, _digest(s)[1], n, s.view(np.int64), xxhash.xxh3_64_intdigest(p.tobytes(), seed=n) - (1 << 63), p.view(np.int64), *sketch))
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, id long, n long, s array<long>, g long, prefix array<long>, " + ", ".join(f"b{j} long" for j in range(SKETCH))
    made = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(each, schema)
    return materialize(made.join(wanted, ["doc_id", "id"], "left_semi").dropDuplicates(["doc_id", "id"]))


def _pairs_ok(na: Column, nb: Column, percent: int) -> Column:
    return F.greatest(na, nb) * percent <= F.least(na, nb) * 100


def _place_ok(na, ia, nb, ib, percent: int) -> Column:
    """Whether sets whose first common token stands at these places of the order (from 0) may share enough. Every similar pair passes at its first one."""
    return F.least(na - ia, nb - ib) * (100 + percent) >= (na + nb) * percent


def _sketch_ok(differ: Column, na: Column, nb: Column, percent: int) -> Column:
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b. Those whose sets (id, s) are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Each node's (id's) smallest id within its component, as label. A round takes the least label among a node and its
    neighbours, then that label's own label."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(at.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        near = at.join(seen, at["id"] == seen["a"]).select("id", F.least("label", "least").alias("next"), "label")
        jump = at.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = materialize(near.join(jump, "next").select("id", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")))
        discard(at)
        at, done = new.select("id", "label"), new.where("moved").isEmpty()
        at.terrace_path = new.terrace_path
        if done:
            discard(both)
            return at


def jaccard_components(df: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of df (doc_id, text); text_key (a hash of the text) and component, which tells components apart
    even where texts of one id lie in several (null for empty sets and rows without an id)."""
    docs = columns_of(df, doc_id="long", text="string")
    prints = materialize(fingerprints(docs, k, percent))
    known = prints.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("fp").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.min("doc_id").alias("label")))
    wanted = _with_candidates(known, classes, percent)
    links = None
    if not wanted.isEmpty():
        sets = _sets_of(docs, wanted, k, percent, common_shingles(docs, k, prints.count()))
        links = _linked(sets, percent)
        discard(sets)
    discard(wanted)
    own = classes.select("fp", "label", F.col("f").alias("component"))
    if links is not None:  # classes without any link keep their own label
        joined = classes.join(links.select(F.col("id").alias("f"), F.col("label").alias("root")), "f", "left").select("fp", "label", F.coalesce("root", "f").alias("component"))
        least = joined.groupBy("component").agg(F.min("label").alias("label"))
        own = joined.drop("label").join(least, "component")
    out = prints.select("doc_id", "n", "fp", "text_key").join(own, "fp", "left")
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"), "text_key", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")))
    discard(prints, classes, links)
    return out


def _linked(sets: DataFrame, percent: int) -> DataFrame | None:
    """id, label for the classes that have a link; None if none has. A class goes by eight bytes of its fingerprint."""
    tokens = sets.select("g", F.posexplode("prefix").alias("i", "t")).groupBy("t", "g").agg(F.first("i").alias("i"))
    met = tokens.groupBy("t").agg(F.count("*").alias("m")).where("m > 1").select("t")
    post = materialize(tokens.join(met, "t", "left_semi"))
    edges = at = None
    for number in range(ROUNDS + 1):
        state = sets.select("g", "id", "n", *[f"b{j}" for j in range(SKETCH)])
        if at is None:
            state = state.withColumn("c", F.col("id"))
        else:
            state = state.join(at.select("id", F.col("label").alias("_c")), "id", "left").withColumn("c", F.coalesce("_c", "id")).drop("_c")
        state = materialize(state)
        bounds = [f(f"b{j}").alias(f"{name}{j}") for name, f in (("lo", F.bit_and), ("hi", F.bit_or)) for j in range(SKETCH)]
        span = materialize(state.groupBy("g").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), *bounds))
        placed = (post.where(F.pmod(F.shiftright("t", 32), F.lit(THIN)) == 0) if number == 0 and ROUNDS else post).join(span, "g")
        if number:
            mixed = placed.groupBy("t").agg(F.min("c0").alias("x"), F.max("c1").alias("y")).where("x < y").select("t")
            placed = placed.join(mixed, "t", "left_semi")
        placed = materialize(placed)
        inner = span.where("c0 < c1").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
        rows = placed.count()
        if number and not rows and inner.isEmpty():
            discard(placed, span, state)
            break
        last = number == ROUNDS or number > 0 and _left_over(placed) <= LEFT_PER_ROW * rows
        pairs = materialize(_all_pairs(_met_pairs(placed, percent).union(inner), state, percent) if last else _nearest(_star_pairs(placed, percent, number).union(inner), state, percent))
        good = materialize(verify(pairs, sets, percent))
        discard(pairs, placed, span, state)
        if not good.isEmpty():
            edges = good if edges is None else edges.union(good)
            old, at = at, components(edges)
            discard(old)
        if last:
            break
    discard(post)
    return at


def _left_over(placed: DataFrame) -> int:
    """Pairs of groups across components, summed over tokens (groups of more than one component count with all)."""
    per = placed.groupBy("t", F.when(F.col("c0") == F.col("c1"), F.col("c0")).otherwise(-1 - F.col("c0")).alias("c")).agg(F.sum(F.col("size").cast("double")).alias("m"))
    per = per.groupBy("t").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("c") >= 0, F.col("m") * F.col("m")).otherwise(0.0)).alias("same"))
    return int(per.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first()[0] or 0)


_OF_GROUP = ("g", "n", "i", "c0", "c1", *[f"{name}{j}" for name in ("lo", "hi") for j in range(SKETCH)])


def _differ(a: dict, b: dict) -> Column:
    """Sketch bits in which all members of one group differ from all of the other: no more than their sets' symmetric difference."""
    apart = lambda j: a[f"lo{j}"].bitwiseAND(F.bitwise_not(b[f"hi{j}"])).bitwiseOR(b[f"lo{j}"].bitwiseAND(F.bitwise_not(a[f"hi{j}"])))
    return sum(F.bit_count(apart(j)) for j in range(SKETCH))


def _near(a: dict, b: dict, percent: int) -> Column:
    """Whether two groups that meet at a token may hold a similar pair that isn't in one component yet."""
    apart = ~((a["c0"] == a["c1"]) & (b["c0"] == b["c1"]) & (a["c0"] == b["c0"]))
    return apart & _pairs_ok(a["n"], b["n"], percent) & _place_ok(a["n"], a["i"], b["n"], b["i"], percent) & _sketch_ok(_differ(a, b), a["n"], b["n"], percent)


def _star_pairs(placed: DataFrame, percent: int, number: int) -> DataFrame:
    """ga, gb: each token's groups (gb) with the nearest of a few of them: two by hash, two by hash of their component, so that small components have their turn,
    and two that have few tokens before this one, as the original of a group of edited copies has. Another choice in every round."""
    first = lambda k: (F.lit(0), F.xxhash64("c0", F.lit(number * CENTRES + k)), F.col("i"))[k % 3]
    best = [F.min(F.struct(first(k).alias("first"), F.xxhash64("g", F.lit(number * CENTRES + k)).alias("o"), *_OF_GROUP)) for k in range(CENTRES)]
    centre = materialize(placed.groupBy("t").agg(F.array_distinct(F.transform(F.array(*best), lambda x: F.struct(*[x[c].alias(c) for c in _OF_GROUP]))).alias("xs")))
    j = placed.join(centre, "t")
    mine = {c: F.col(c) for c in _OF_GROUP}
    near = F.filter("xs", lambda x: (x["g"] != F.col("g")) & _near(mine, {c: x[c] for c in _OF_GROUP}, percent))
    nearest = F.array_min(F.transform(near, lambda x: F.struct(_differ(mine, {c: x[c] for c in _OF_GROUP}).alias("differ"), x["g"].alias("g"))))
    return j.select(nearest["g"].alias("ga"), F.col("g").alias("gb")).where("ga IS NOT NULL").distinct()


def _met_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """ga, gb: all groups that meet at a token and may hold a similar pair."""
    x = placed.select("t", *[F.col(c).alias(f"{c}x") for c in _OF_GROUP])
    j = placed.join(x, (placed["t"] == x["t"]) & (F.col("g") < F.col("gx")) & _near({c: F.col(c) for c in _OF_GROUP}, {c: F.col(f"{c}x") for c in _OF_GROUP}, percent))
    return j.select(F.col("g").alias("ga"), F.col("gx").alias("gb")).distinct()


def _class_pairs(pairs: DataFrame, a: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """a, b, differ: classes of the groups' pairs (ga, gb) whose sketches allow it and that aren't in one component."""
    own = lambda df, s: df.select(F.col("g").alias(f"g{s}"), F.col("id").alias(s), F.col("c").alias(f"c{s}"), F.col("n").alias(f"n{s}"), *[F.col(f"b{j}").alias(f"{s}{j}") for j in range(SKETCH)])
    differ = sum(F.bit_count(F.col(f"a{j}").bitwiseXOR(F.col(f"b{j}"))) for j in range(SKETCH))
    out = pairs.join(own(a, "a"), "ga").join(own(state, "b"), "gb").withColumn("differ", differ)
    return out.where((F.col("ca") != F.col("cb")) & _sketch_ok(F.col("differ"), F.col("na"), F.col("nb"), percent)).select("a", "b", "differ")


def _nearest(pairs: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """a, b: each class of a group's second side with the nearest of the first sides' leaders. What isn't joined so is left to later rounds."""
    leader = state.groupBy("g").agg(F.min(F.struct("id", "c", "n", *[f"b{j}" for j in range(SKETCH)])).alias("x")).select("g", "x.*")
    return _class_pairs(pairs, leader, state, percent).groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")


def _all_pairs(pairs: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    return _class_pairs(pairs, state, state, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(df: DataFrame, columns: list[str], k: int = K, percent: int = PERCENT) -> DataFrame:
    """df's rows but for near copies: of each component the row with the smallest (doc_id, text hash), once; rows without an id or without words all stay.
    Of rows equal in id and text the one whose other columns are smallest stays, so reruns agree."""
    keyed = df.select(*[df[c] for c in columns]).withColumn("_key", F.xxhash64("text"))
    found = jaccard_components(df, k, percent)
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.doc_id", F.col("x.text_key").alias("_key"))
    free = found.where("component IS NULL AND doc_id IS NOT NULL").select("doc_id", F.col("text_key").alias("_key")).distinct()
    rest = [c for c in columns if c not in ("doc_id", "text")]
    one = keyed.join(least, ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(F.first("text").alias("text"), F.min(F.struct(*rest) if rest else F.lit(0)).alias("_x"))
    one = one.select("doc_id", "text", *[F.col(f"_x.{c}") for c in rest])
    stay = keyed.where("doc_id IS NULL").unionByName(keyed.join(free, ["doc_id", "_key"], "left_semi"))
    return one.select(*columns).unionByName(stay.select(*columns))


def op1(df: DataFrame) -> DataFrame:
    return jaccard_components(df, K, PERCENT).drop("text_key", "component")
