"""Media columns: copies of pictures, cropped or edited, by local descriptors.

1. Each picture gets corners at several scales (the strongest of each scale, a fixed number), each with the orientation of its patch and 128
   binary tests turned by it.
2. Pictures of equal pixels collapse to one class first, so a picture that a third of the rows share is described and joined once.
3. Pictures are dealt to blocks, and each two blocks meet in a task. Descriptors are cut in four parts of 32 bits, which make tables of the blocks: pictures that
   share a cell are held against each other.
4. A pair is checked so: its descriptors are matched by Hamming distance, every match votes for a shift, turn and scale,
   and enough agreeing votes make a link. Linked pictures form groups.
5. Equal parts are certain only for descriptors with three or fewer changed bits, while a match may have MAX_BITS_OFF. So pairs of the two blocks that share
   no cell are held, too: groups and n_links are those of all pairs. That costs the square of their number in time. Disk doesn't: block pairs are dealt in
   rounds, each of which copies half of the pictures at most, and only sums of links (a row for each picture) stay of a round.

Defined results: a null, empty or flat picture has no keypoint and is its own group; equal rows share a group; rows without an id keep a null
group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, discard, materialize
from .ngram_join import components

SCALES = (1, 2)
PER_SCALE = 16
RADIUS = 8
TURNS = 12
TESTS = 128
#: Most bits that may differ in a match; agreeing votes that a link needs, at least, and their share of the poorer picture's keypoints.
MAX_BITS_OFF = 14
MIN_VOTES = 5
MIN_SHARE = 0.3
#: Pictures of a block, about, where all pairs are held; no fewer, about, where blocks are cut so that every core has a task.
BLOCK = 1024
LEAST_BLOCK = 64
#: Pictures that a round may copy in any case; rounds whose sums are made one; shares in which equal pictures collapse, and pictures of one at least.
ROUND = 2**15
FOLD = 8
SHARES = 8
LEAST_SHARE = 2**13
#: So that disk holds the pictures' keypoints once or twice, and never the copies of every round.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def _pattern() -> np.ndarray:
    """Turns x tests x (ya, xa, yb, xb): random pairs of places inside the patch, turned."""
    r = np.random.default_rng(20)
    pairs = np.clip(r.normal(0, RADIUS / 2.5, (TESTS, 4)), -5.6, 5.6)
    out = []
    for turn in range(TURNS):
        a = 2 * np.pi * turn / TURNS
        c, s = np.cos(a), np.sin(a)
        y, x = pairs[:, ::2], pairs[:, 1::2]
        out.append(np.stack([s * x[:, 0] + c * y[:, 0], c * x[:, 0] - s * y[:, 0], s * x[:, 1] + c * y[:, 1], c * x[:, 1] - s * y[:, 1]], axis=1))
    return np.rint(np.array(out)).astype(np.int64)


_PATTERN = _pattern()
_NEAR = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 36])


def _blur(a: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        a = (np.roll(a, 1, axis) + 2 * a + np.roll(a, -1, axis)) / 4
    return a


def describe(pictures: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """pictures: n x height x width. For each: keypoints (y, x in the picture's own pixels, scale, turn) and descriptors (two 64-bit words)."""
    found: list[list] = [[] for _ in pictures]
    for scale in SCALES:
        h, w = pictures.shape[1] // scale, pictures.shape[2] // scale
        if min(h, w) < 2 * RADIUS + 3:
            continue
        p = _blur(pictures[:, : h * scale, : w * scale].reshape(-1, h, scale, w, scale).mean((2, 4)).astype(np.float32))
        gy, gx = np.gradient(p, axis=(1, 2))
        a, b, c = _blur(_blur(gy * gy)), _blur(_blur(gx * gx)), _blur(_blur(gy * gx))
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        peak = np.ones_like(corner, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= corner >= np.roll(corner, (dy, dx), (1, 2))
        inside = np.zeros((h, w), bool)
        inside[RADIUS : h - RADIUS, RADIUS : w - RADIUS] = True
        score = np.where(peak & inside & (corner > 1e-3), corner, 0).reshape(len(p), -1)
        top = np.argsort(-score, axis=1, kind="stable")[:, :PER_SCALE]
        n, k = np.nonzero(np.take_along_axis(score, top, 1) > 0)
        y, x = np.divmod(top[n, k], w)
        patch = p[n[:, None], y[:, None] + _NEAR[:, 0], x[:, None] + _NEAR[:, 1]]
        angle = np.arctan2(patch @ _NEAR[:, 0], patch @ _NEAR[:, 1])
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        t = _PATTERN[turn]
        bits = p[n[:, None], y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]] < p[n[:, None], y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i, j in enumerate(n):
            found[j].append((y[i] * scale, x[i] * scale, scale, turn[i], words[i]))
    empty = (np.zeros((0, 4), np.int64), np.zeros((0, 2), np.uint64))
    return [(np.array([f[:4] for f in x], np.int64), np.array([f[4] for f in x], np.uint64)) if x else empty for x in found]


def votes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Matches that agree on one shift, turn and scale."""
    (ka, da), (kb, db) = a, b
    if not len(ka) or not len(kb):
        return 0
    off = np.bitwise_count(da[:, None, :] ^ db[None, :, :]).sum(2)
    best = off.argmin(1)
    i = np.flatnonzero(off[np.arange(len(ka)), best] <= MAX_BITS_OFF)
    if len(i) < MIN_VOTES:
        return 0
    pa, pb = ka[i], kb[best[i]]
    turn, size = (pb[:, 3] - pa[:, 3]) % TURNS, np.log2(pb[:, 2] / pa[:, 2])
    angle, ratio = turn * 2 * np.pi / TURNS, pb[:, 2] / pa[:, 2]
    ty = pb[:, 0] - ratio * (np.sin(angle) * pa[:, 1] + np.cos(angle) * pa[:, 0])
    tx = pb[:, 1] - ratio * (np.cos(angle) * pa[:, 1] - np.sin(angle) * pa[:, 0])
    same = (np.abs(ty[:, None] - ty) <= 6) & (np.abs(tx[:, None] - tx) <= 6) & (np.minimum((turn[:, None] - turn) % TURNS, (turn - turn[:, None]) % TURNS) <= 1) & (size[:, None] == size)
    return int(same.sum(1).max())


def same_picture(a, b) -> bool:
    return votes(a, b) >= max(MIN_VOTES, MIN_SHARE * min(len(a[0]), len(b[0])))


def same_as(a: tuple[np.ndarray, np.ndarray], keys: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """same_picture(a, b) for many b at once, whose n keypoints each (one or more) lie one after the other in keys and words."""
    ka, da = a
    if len(ka) < MIN_VOTES:
        return np.zeros(len(n), bool)
    start = np.cumsum(n) - n
    # half a descriptor is no further off than the whole: most pictures have too few halves that are near
    need = np.maximum(MIN_VOTES, MIN_SHARE * np.minimum(len(ka), n))
    half, near = np.ascontiguousarray(words[:, 0]), np.zeros(len(n), np.int64)
    for u in da[:, 0]:
        near += np.minimum.reduceat(np.bitwise_count(half ^ u), start) <= MAX_BITS_OFF
    some = near >= need
    if not some.all():
        out = np.zeros(len(n), bool)
        if some.any():
            rows = np.repeat(some, n)
            out[some] = same_as(a, keys[rows], words[rows], n[some])
        return out
    local = (np.arange(len(words)) - np.repeat(start, n)).astype(np.uint16)
    best = np.empty((len(ka), len(n)), np.uint16)
    for i, (u, v) in enumerate(da):
        off = np.bitwise_count(words[:, 0] ^ u) + np.bitwise_count(words[:, 1] ^ v)
        best[i] = np.minimum.reduceat((off.astype(np.uint16) << 6) | local, start)  # PER_SCALE * len(SCALES) places fit in six bits
    hit = (best >> 6) <= MAX_BITS_OFF
    left = np.flatnonzero(hit.sum(0) >= need)
    hit, kb = hit[:, left], keys[start[left] + (best[:, left] & 63)]
    turn, size = (kb[:, :, 3] - ka[:, None, 3]) % TURNS, np.log2(kb[:, :, 2] / ka[:, None, 2])
    # no more votes can agree than have one size and neighbouring turns
    sizes = np.unique(size)
    code = (np.arange(len(left)) * len(sizes) + np.searchsorted(sizes, size)) * TURNS + turn
    c = np.bincount(code[hit], minlength=len(left) * len(sizes) * TURNS).reshape(len(left), len(sizes), TURNS)
    some = (c + np.roll(c, 1, 2) + np.roll(c, -1, 2)).max((1, 2), initial=0) >= need[left]
    left, hit, kb, turn, size = left[some], hit[:, some], kb[:, some], turn[:, some], size[:, some]
    angle, ratio = turn * 2 * np.pi / TURNS, kb[:, :, 2] / ka[:, None, 2]
    ty = kb[:, :, 0] - ratio * (np.sin(angle) * ka[:, None, 1] + np.cos(angle) * ka[:, None, 0])
    tx = kb[:, :, 1] - ratio * (np.cos(angle) * ka[:, None, 1] - np.sin(angle) * ka[:, None, 0])
    most = np.zeros(len(left), np.int64)
    for i in range(len(ka)):
        off = (turn - turn[i]) % TURNS
        same = hit & hit[i] & (np.abs(ty - ty[i]) <= 6) & (np.abs(tx - tx[i]) <= 6) & (np.minimum(off, TURNS - off) <= 1) & (size == size[i])
        most = np.maximum(most, same.sum(0))
    out = np.zeros(len(n), bool)
    out[left[most >= need[left]]] = True
    return out


FEATURES = "id long, pix binary, n int, keys binary, words binary"


def features(media: DataFrame, decode: Callable[[object], np.ndarray | None]) -> DataFrame:
    """media: id, media. id, pix (hash of the pixels), n, keypoints and descriptors as bytes. decode gives a picture (height x width, 0 to 255) or None."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list = [None] * len(batch)
            shapes: dict[tuple, list] = {}
            for i, m in enumerate(batch["media"]):
                p = decode(m) if m is not None else None
                if p is None or p.ndim != 2 or not p.size:
                    rows[i] = (None, 0, b"", b"")
                else:
                    shapes.setdefault(p.shape, []).append((i, p))
            for group in shapes.values():
                for (i, p), (k, d) in zip(group, describe(np.stack([p for _, p in group]))):
                    rows[i] = (xxhash.xxh3_128_digest(np.ascontiguousarray(p, np.uint8).tobytes() + str(p.shape).encode()), len(k), k.astype(np.int32).tobytes(), d.tobytes())
            out = pd.DataFrame(rows, columns=["pix", "n", "keys", "words"])
            out.insert(0, "id", batch["id"].astype("Int64").to_numpy())
            yield out.astype({"id": "Int64"})

    return media.select("id", "media").mapInPandas(each, FEATURES)


def _read(keys, words) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bytes(keys), np.int32).reshape(-1, 4).astype(np.int64), np.frombuffer(bytes(words), np.uint64).reshape(-1, 2)


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Steps that are written here leave no shuffle files behind, and what they write is packed well."""
    before = {k: spark.conf.get(k) for k in LEAN}
    try:
        for k, v in LEAN.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _all(written: list[DataFrame]) -> DataFrame:
    """The rows of several materialized tables of one schema."""
    return written[0].sparkSession.read.schema(written[0].schema).parquet(*[w.terrace_path for w in written])


def _tables(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray) -> Iterator[np.ndarray]:
    """For each picture of one (words, n each): which pictures of two have an equal 32-bit part in the same place of a descriptor."""
    parts = lambda w: (np.ascontiguousarray(w).view(np.uint32).reshape(-1, 4).astype(np.int64) * 4 + np.arange(4)).ravel()
    cells = np.unique(np.stack([parts(two), np.repeat(np.arange(len(n_two)), 4 * n_two)], axis=1), axis=0)
    mine, ends = parts(one), np.cumsum(4 * n_one)
    for end, n in zip(ends, n_one):
        asked = np.unique(mine[end - 4 * n : end])
        met = np.zeros(len(n_two), bool)
        for low, high in zip(np.searchsorted(cells[:, 0], asked), np.searchsorted(cells[:, 0], asked, "right")):
            met[cells[low:high, 1]] = True
        yield met


def _grouped(links: list[tuple[int, int]]) -> pd.DataFrame:
    """c, links, label: each linked picture with its number of links and the smallest that they reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    c, n = np.unique(np.array(links, np.int64).reshape(-1), return_counts=True)
    return pd.DataFrame({"c": c, "links": n.astype(np.int64), "label": np.array([find(x) for x in c.tolist()], np.int64)})


def _rounds(blocks: int, most: int) -> Iterator[list[tuple[int, int]]]:
    """Every two blocks once (each with itself too), in rounds that copy ``most`` blocks at most, or one pair; a round asks all blocks alike."""
    pairs, copied = [], 0
    for off in range(blocks // 2 + 1):
        for x in range(blocks // 2 if off * 2 == blocks else blocks):
            if pairs and copied + min(off, 1) + 1 > most:
                yield pairs
                pairs, copied = [], 0
            pairs.append(tuple(sorted((x, (x + off) % blocks))))
            copied += min(off, 1) + 1
    yield pairs


def _blocks(pictures: DataFrame, n: int, blocks: int) -> DataFrame:
    """c, links, label of the copies among all pairs of the n pictures (c, keys, words; MIN_VOTES keypoints or more). Each two blocks meet in a task: pictures
    that share a table cell are held, then those that share none. A round copies half of the pictures or ROUND at most, and leaves its sums only."""

    def side(b: pd.DataFrame):
        k, w = [np.concatenate(x) for x in zip(*[_read(k, w) for k, w in zip(b["keys"], b["words"])])]
        return b["c"].to_numpy(), k, w, b["words"].map(len).to_numpy() // 16

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("c")
        sides = [side(x) for _, x in b.groupby("block")]
        found = []
        for one, two in ([(sides[0], sides[0])] if b["x"].iloc[0] == b["y"].iloc[0] else [sides, sides[::-1]] if len(sides) == 2 else []):
            at = np.cumsum(one[3]) - one[3]
            for i, met in enumerate(_tables(one[2], one[3], two[2], two[3])):
                mine, later = slice(at[i], at[i] + one[3][i]), two[0] > one[0][i]
                for held in (later & met, later & ~met):
                    if held.any():
                        rows = np.repeat(held, two[3])
                        found += [(one[0][i], d) for d in two[0][held][same_as((one[1][mine], one[2][mine]), two[1][rows], two[2][rows], two[3][held])]]
        return _grouped(found)

    spark, sums = pictures.sparkSession, []
    placed = pictures.withColumn("block", F.pmod(F.xxhash64("c", F.lit(5)), F.lit(blocks)).cast("int"))
    for pairs in _rounds(blocks, int(max(ROUND, n / 2) * blocks / max(n, 1))):
        mine = spark.createDataFrame([(b, x, y) for x, y in pairs for b in {x, y}], "block int, x int, y int")
        dealt = placed.join(F.broadcast(mine), "block").select("block", "x", "y", "c", "keys", "words")
        sums.append(materialize(dealt.repartition(len(pairs), "x", "y").groupBy("x", "y").applyInPandas(meet, "c long, links long, label long")))
        if len(sums) > FOLD:
            sums = [_folded(sums)]
    return _folded(sums)


def _folded(sums: list[DataFrame]) -> DataFrame:
    """Tables of c, links, label as one: a row for each picture."""
    every = _all(sums)
    group = components(every.where("label <> c").select(F.col("label").alias("a"), F.col("c").alias("b")))
    degree = every.groupBy("c").agg(F.sum("links").alias("links"))
    out = materialize(degree.join(group.select(F.col("id").alias("c"), "label"), "c", "left").select("c", "links", F.coalesce("label", "c").alias("label")))
    discard(group, *sums)
    return out


def copies(media: DataFrame, decode: Callable[[object], np.ndarray | None]) -> DataFrame:
    """id, n_keypoints, n_links (of its class), copy_group (smallest id of the pictures that links reach) for every row of media (id, media)."""
    described = features(media, decode)
    with _lean(described.sparkSession):
        f = materialize(described)
        seen = materialize(f.select("id", "pix", "n"))
        able = f.where((F.col("n") >= MIN_VOTES) & F.col("id").isNotNull() & F.col("pix").isNotNull())
        shares = max(1, min(SHARES, seen.count() // LEAST_SHARE))
        one = [F.min("id").alias("c"), F.first("keys").alias("keys"), F.first("words").alias("words")]
        classes = [materialize(able.where(F.pmod(F.xxhash64("pix"), F.lit(shares)) == i).groupBy("pix").agg(*one).drop("pix")) for i in range(shares)]
        discard(f)
        pictures = _all(classes)
        n = pictures.count()
        blocks = max(1, -(-n // BLOCK), min(n // LEAST_BLOCK, int(np.sqrt(2 * seen.sparkSession.sparkContext.defaultParallelism))))
        links = _blocks(pictures, n, blocks)
        discard(*classes)
    class_of = seen.where("id IS NOT NULL AND pix IS NOT NULL").groupBy("pix").agg(F.min("id").alias("c"))
    own = class_of.join(links, "c", "left").select("pix", F.coalesce("label", "c").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    out = seen.join(own, "pix", "left")
    return out.select("id", F.col("n").alias("n_keypoints"), F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("copy_group"))


def picture_of(embedding) -> np.ndarray | None:
    """A vector's picture: its values as a square grid of grey, eight pixels a value, softened. The test tables hold no pictures; this makes one of each vector."""
    v = np.asarray(embedding, np.float32)
    side = int(np.sqrt(len(v)))
    if side * side != len(v) or not len(v) or not np.isfinite(v).all():
        return None
    span = float(v.max() - v.min())
    grid = (v.reshape(side, side) - v.min()) * (255 / span) if span > 0 else np.zeros((side, side), np.float32)
    return np.rint(_blur(_blur(np.kron(grid, np.ones((8, 8), np.float32))[None]))[0]).clip(0, 255).astype(np.uint8)


def op3(df: DataFrame) -> DataFrame:
    """Every vector's picture, its keypoints, and the group of pictures that are copies of each other."""
    media = columns_of(df, vec_id="long", embedding="array<float>").select(F.col("vec_id").alias("id"), F.col("embedding").alias("media"))
    return copies(media, picture_of).withColumnRenamed("id", "vec_id")
