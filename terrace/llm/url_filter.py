"""URL filters by a Bloom filter cascade: exact membership of the corpus's keys without a join.

Level 1 encodes the listed keys; level 2 the corpus keys that level 1 passes wrongly; level 3 the listed
keys that level 2 passes; and so on until a level passes nothing wrongly. A key is listed if the first
level that misses it is an even one. Since the levels are built over every key of the corpus, the answer is exact
for each of them.

Building takes one distinct over the corpus's keys (pre-aggregated, so a hot host costs one row per task)
and a left-anti join of them with the list; judging a url takes no join and no shuffle. The bits of a level are a literal of the plan and are bounded by ``max_bits``: a
longer list is dealt by hash to several cascades, and a key asks its own one only.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; repeated urls
get equal rows; of rules of equal length that fit (there are none in one list of distinct keys) the larger key wins; very long urls are rows like
others; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, let, materialize

#: The contract's rules: host and path, verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that the method blocks where no rule fits (an example list; pass your own).
BLOCKED_HOSTS = ("ads-track.example.com", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net")
#: Bits of one level at most: 1 MB in the plan.
MAX_BITS = 1 << 23


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_key(key: str) -> tuple[str, str]:
    host, slash, rest = key.partition("/")
    return host, slash + rest


def candidate_keys(host: Column, path: Column, listed: list[str]) -> Column:
    """The keys of a url that a list could hold: its last labels and the start of its path, for each pair of
    label count and path length that occurs in the list."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in map(split_key, listed)})

    def build(labels: Column) -> Column:
        each = [F.when((F.size(labels) >= n) & (F.length(path) >= k), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, k))) for n, k in shapes]
        return F.array_compact(F.array(*each))

    return let(F.split(host, r"\."), build)


class Cascade:
    """Levels of Bloom filters that answer for one list."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels  # hashes, bits, the bits themselves

    def contains(self, key: Column) -> Column:
        answer = F.lit(False)
        for depth in range(len(self.levels) - 1, -1, -1):
            passed = self._passes(depth, key)
            answer = passed & ~answer if depth < len(self.levels) - 1 else passed
        return answer

    def _passes(self, depth: int, key: Column) -> Column:
        hashes, bits, data = self.levels[depth]
        out = F.lit(True)
        for i in range(hashes):
            out = out & let(place(key, depth, i, bits), lambda p: _bit(data, p))
        return out


def _bit(data: bytes, p: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.lit(data), F.floor(p / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), p % 8)).cast("int") % 2 == 1


def place(key: Column, depth: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(depth * 64 + i)), F.lit(bits)).cast("int")


class Cascades:
    """Cascades that share a list by hash of the key."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    def contains(self, key: Column) -> Column:
        if len(self.parts) == 1:
            return self.parts[0].contains(key)
        out = F.lit(False)
        for j, part in enumerate(self.parts):
            out = F.when(_part(key, len(self.parts)) == j, part.contains(key)).otherwise(out)
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def _level(keys: DataFrame, n: int, depth: int, rate: float) -> tuple[int, int, bytes]:
    bits = max(64, 8 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 8))
    hashes = max(1, round(bits / n * math.log(2)))
    spots = keys.select(F.explode(F.array(*[place(F.col("key"), depth, i, bits) for i in range(hashes)])).alias("p"))
    got = spots.groupBy(F.floor(F.col("p") / 8).cast("int").alias("at")).agg(F.bit_or(F.pow(F.lit(2), F.col("p") % 8).cast("int")).alias("byte")).toArrow()  # at most bits / 8 rows
    data = bytearray(bits // 8)
    for at, byte in zip(got["at"].to_pylist(), got["byte"].to_pylist()):
        data[at] = byte
    return hashes, bits, bytes(data)


def _cascade(listed: DataFrame, theirs: DataFrame, rate: float) -> Cascade:
    """Levels until one passes nothing wrongly: each has a part of the keys of the level two before, so they soon run out."""
    ours, n, depth, levels = listed, listed.count(), 0, []
    while n:
        levels.append(_level(ours, n, depth, rate if depth == 0 else 0.3))
        passed = materialize(theirs.where(Cascade(levels)._passes(depth, F.col("key"))))
        ours, theirs, n, depth = passed, ours, passed.count(), depth + 1
    return Cascade(levels)


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.02, max_bits: int = MAX_BITS) -> Cascades:
    """listed, universe: a column ``key`` each. The first level's rate is such that it passes wrongly fewer keys than are listed (``rate`` at most), so
    that no later level is larger."""
    listed = materialize(listed.select("key").where("key IS NOT NULL").distinct())
    theirs = materialize(universe.select("key").where("key IS NOT NULL").distinct().join(listed, "key", "left_anti"))
    n = listed.count()
    rate = min(rate, max(1e-9, 0.7 * n / max(1, theirs.count())))
    parts = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / max_bits))
    key = F.col("key")
    if parts == 1:
        return Cascades([_cascade(listed, theirs, rate)])
    return Cascades([_cascade(listed.where(_part(key, parts) == j), theirs.where(_part(key, parts) == j), rate) for j in range(parts)])


def _table(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, blocked_hosts=BLOCKED_HOSTS, max_bits: int = MAX_BITS) -> DataFrame:
    """df with host, path, rule and verdict: the longest rule's, else block for a host (or subdomain) of the
    blocked list, else allow. Columns of df with these names are replaced."""
    spark = df.sparkSession
    lists = {"allow": [k for k, v in rules if v == "allow"], "block": [k for k, v in rules if v == "block"], "hosts": list(blocked_hosts)}
    out = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    keys = {k: candidate_keys(F.col("host"), F.col("path"), v) for k, v in lists.items() if v}
    if keys:
        universe = materialize(out.select(F.explode(F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*keys.values())))).alias("key")).distinct())
    cascades = {k: build_cascade(_table(spark, v), universe, max_bits=max_bits) if v else None for k, v in lists.items()}
    none = F.array().cast("array<string>")
    out = out.withColumns({f"_{k}": F.filter(keys[k], cascades[k].contains) if lists[k] else none for k in lists})
    longest = lambda keys: F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))
    out = out.withColumn("rule", longest(F.concat("_allow", "_block"))["key"])
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.array_contains("_block", F.col("rule")), "block").otherwise("allow")).otherwise(F.when(F.size("_hosts") > 0, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_allow", "_block", "_hosts")


def op4(df: DataFrame) -> DataFrame:
    """The digest of ``judge_urls`` for each page."""
    return judge_urls(columns_of(df, page_id="long", url="string")).select("page_id", "host", "path", "rule", "verdict")
