import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import media, queries


def art(seed, size=160):
    r = np.random.default_rng(seed)
    p = np.full((size, size), 120.0)
    for _ in range(40):
        y, x = r.integers(0, size - 10, 2)
        h, w = r.integers(6, 40, 2)
        p[y : y + h, x : x + w] = r.integers(0, 256)
    return p


def edited(p):
    out = np.clip(p * 0.9 + 10 + np.random.default_rng(0).normal(0, 3, p.shape), 0, 255)
    out[100:130, 100:130] = 0
    return out


def one(p):
    return media.describe(p[None])[0]


@pytest.mark.parametrize("seed", range(8))
def test_crops_edits_and_turns_are_copies_and_others_are_not(seed):
    p = art(seed)
    assert media.same_picture(one(p), one(p[20:140, 30:150]))
    assert media.same_picture(one(p), one(edited(p)))
    assert media.same_picture(one(p), one(np.ascontiguousarray(np.rot90(p))))
    assert not media.same_picture(one(p), one(art(seed + 100)))


def test_groups_equal_all_pairs(spark):
    pictures = [art(i) for i in range(12)] + [art(i)[10:150, 15:155] for i in range(6)] + [edited(art(7)), art(3), np.zeros((160, 160)), np.zeros((4, 4))]
    rows = [(i, bytes([p.shape[0] // 4]) + np.clip(p, 0, 255).astype(np.uint8).tobytes()) for i, p in enumerate(pictures)] + [(50, None), (None, b"\x28" + b"\x00" * 25600), (51, b"")]
    read = lambda m: np.frombuffer(bytes(m), np.uint8)[1:].reshape(m[0] * 4, -1) if len(m) else None
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("label", F.lit(1))
    got = {r.id: r for r in media.copies(df, read).collect()}
    assert len(got) == len(rows)
    want = {i: i for i in range(len(pictures))} | {12 + i: i for i in range(6)} | {18: 7, 19: 3} | {50: 50, 51: 51, None: None}
    assert {i: r.copy_group for i, r in got.items()} == want
    assert got[20].n_keypoints == 0 and got[50].n_keypoints == 0 and got[0].n_links >= 1
    assert media.copies(df.limit(0), read).collect() == []


def test_recall_against_all_pairs(spark, sf_dir):
    """The table's vectors with slightly changed copies of some of them: nine tenths or more of the pairs that all pairs give are grouped."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(250).collect()
    r = np.random.default_rng(4)
    rows = [(x.vec_id, [float(v) for v in x.embedding]) for x in table]
    rows += [(100_000 + i, [float(v) for v in np.array(e) + r.normal(0, 0.01 * np.std(e), len(e))]) for i, e in rows[:120]]
    got = media.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    group = {x.vec_id: x.copy_group for x in got}
    shown = {i: one(media.picture_of(e)) for i, e in rows}
    ids = sorted(shown)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if media.same_picture(shown[a], shown[b])]
    assert len(linked) >= 100 and sum(group[a] == group[b] for a, b in linked) >= 0.9 * len(linked)


def test_query_returns_every_vector(spark, sf_dir):
    rows = queries.QUERIES["op3_media_copies"](spark, sf_dir).collect()
    assert sorted(x.vec_id for x in rows) == sorted(x.vec_id for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())


def test_many_at_once_are_checked_as_one_by_one():
    shown = [one(p) for i in range(6) for p in (art(i), edited(art(i)), art(i)[10:150, 15:155], art(i)[::2, ::2])]
    shown = [x for x in shown if len(x[0])]
    keys, words, n = np.concatenate([x[0] for x in shown]), np.concatenate([x[1] for x in shown]), np.array([len(x[0]) for x in shown])
    for a in shown:
        assert media.same_as(a, keys, words, n).tolist() == [media.same_picture(a, b) for b in shown]


@pytest.mark.parametrize("crowd", [0, 60])
def test_crowded_cells_lose_no_copies(spark, monkeypatch, crowd):
    """Copies that share one crowded cell, of which no centre, and copies that share one cell at all; in small and in crowded cells."""
    r = np.random.default_rng(1)
    rows = []

    def add(i, words, logo):
        words = words.copy()
        words.view(np.uint32).reshape(-1, 4)[0, : 2 if crowd else 1] = logo
        keys = np.array([(20 + 9 * k, 30 + 5 * (k % 3), 1, 0) for k in range(len(words))], np.int32)
        rows.append((i, i.to_bytes(16, "little"), len(words), keys.tobytes(), words.tobytes()))

    def near(words):
        """Every part of every descriptor has one bit changed."""
        return (words.view(np.uint32) ^ np.uint32(1 << 7)).view(np.uint64)

    base = [r.integers(0, 2**63, (12, 2)).astype(np.uint64) for _ in range(20 + crowd)]
    for i, w in enumerate(base):
        add(i, w, 77)
        if i < 20:
            add(1000 + i, near(w), 77)
    spark_rows = spark.createDataFrame(rows, media.FEATURES)
    monkeypatch.setattr(media, "features", lambda *_: spark_rows)
    monkeypatch.setattr(media, "BLOCK", 16, raising=False)
    got = {x.id: x.copy_group for x in media.copies(None, None).collect()}
    assert got == {i: i % 1000 for i in got} and len(got) == 40 + crowd


def test_copies_that_share_no_cell_are_linked(spark, monkeypatch):
    """Every part of every descriptor has three bits changed, so that no table cell is shared; all links are counted, also those inside a group."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(5):
        words = r.integers(0, 2**63, (12, 2)).astype(np.uint64)
        keys = np.array([(20 + 9 * k, 30 + 5 * (k % 3), 1, 0) for k in range(12)], np.int32)
        for copy, bits in enumerate((0, 7, 56, 448)):
            mine = (words.view(np.uint32) ^ np.uint32(bits)).view(np.uint64)
            rows.append((10 * i + copy, bytes([i, copy]), 12, keys.tobytes(), mine.tobytes()))
    shown = [(np.frombuffer(k, np.int32).reshape(-1, 4).astype(np.int64), np.frombuffer(w, np.uint64).reshape(-1, 2)) for *_, k, w in rows]
    links = [(a[0], b[0]) for x, a in enumerate(rows) for y, b in enumerate(rows) if a[0] < b[0] and media.same_picture(shown[x], shown[y])]
    table = spark.createDataFrame(rows, media.FEATURES)
    monkeypatch.setattr(media, "features", lambda *_: table)
    monkeypatch.setattr(media, "BLOCK", 6)
    got = {x.id: x for x in media.copies(None, None).collect()}
    assert {i: x.copy_group for i, x in got.items()} == {i: i // 10 * 10 for i in got} and len(links) >= 15
    assert {i: x.n_links for i, x in got.items()} == {i: sum(i in link for link in links) for i in got}


def test_few_pictures_are_several_tasks_and_all_pairs(spark, monkeypatch):
    """Pictures of one block, and of few bytes: blocks are dealt to tasks by their number, and links are those of every pair held by itself."""
    r = np.random.default_rng(8)
    vectors = r.random((150, 64)).astype(np.float32)
    vectors[140:] = vectors[:10]
    vectors[140:, 63] += 0.02
    written, keep = [], media.materialize
    monkeypatch.setattr(media, "materialize", lambda d: written.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {x.vec_id: x.n_links for x in media.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    seen = media.describe(np.stack([media.picture_of(v) for v in vectors]))
    links = [(a, b) for a in range(150) for b in range(a + 1, 150) if media.same_picture(seen[a], seen[b])]
    assert len(links) >= 10 and got == {i: sum(i in x for x in links) for i in range(150)}
    assert any("FlatMapGroupsInPandas" in p and "x#" in p and ", 3), REPARTITION_BY_NUM" in p for p in written)


def test_rounds_copy_few_pictures_and_lose_no_pair(spark, monkeypatch):
    """Block pairs are dealt in rounds, none of which copies more than half of the pictures (or ROUND); sums of rounds are folded, and links are those of all pairs."""
    r = np.random.default_rng(8)
    vectors = r.random((60, 64)).astype(np.float32)
    vectors[40:] = vectors[np.arange(20) % 7]
    vectors[40:, 63] += 0.02 + 0.001 * np.arange(20)
    for name, value in (("BLOCK", 10), ("ROUND", 12), ("FOLD", 5), ("LEAST_SHARE", 20)):
        monkeypatch.setattr(media, name, value, raising=False)
    written, keep, key = [], media.materialize, "spark.sql.parquet.compression.codec"
    monkeypatch.setattr(media, "materialize", lambda d: written.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d))
    before = spark.conf.get(key)
    rows = [(i, v.tolist()) for i, v in enumerate([*vectors, *vectors[:9]])]  # and pictures of equal pixels
    got = {x.vec_id: (x.n_links, x.copy_group) for x in media.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    seen = media.describe(np.stack([media.picture_of(v) for v in vectors]))
    links = [(a, b) for a in range(60) for b in range(a + 1, 60) if media.same_picture(seen[a], seen[b])]
    group = list(range(60))
    for _ in range(60):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    want = {i: (sum(i in x for x in links), group[i]) for i in range(60)}
    assert got == want | {60 + i: want[i] for i in range(9)} and max(n for n, _ in want.values()) >= 2
    rounds = [p for p in written if "FlatMapGroupsInPandas" in p]
    assert len(rounds) >= 10 and spark.conf.get(key) == before
    for blocks in range(1, 9):
        for most in (1, 3, 7, 100):
            dealt = list(media._rounds(blocks, most))
            assert sorted(x for pairs in dealt for x in pairs) == [(x, y) for x in range(blocks) for y in range(x, blocks)]
            assert max(len({*pair}) for pair in dealt[0]) <= 2 and all(sum(len({*x}) for x in pairs) <= max(most, 2) for pairs in dealt)
