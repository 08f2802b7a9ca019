"""Merging captures as they come: order, batches, buckets."""

import itertools
from pathlib import Path

import pytest
from oracle import assert_same, connect

from terrace import catalog
from terrace.operators import captures
from terrace.streaming import ingest

RULES = {"price": captures.STATED, "name": captures.FILL, "seen": captures.ALWAYS, "origin": captures.NEVER}
BEFORE = {"price": "price_previous"}
CAPTURES = [(1, 5.0, "", 10, "a"), (2, None, "old", 20, "b"), (4, 7.0, None, None, None), (5, 7.0, "new", 50, "d"), (8, None, "newest", 80, "e"), (9, 5.0, None, 90, None)]
SCHEMA = "key string, time int, price double, name string, seen int, origin string"


def plain(rows):
    """The rules one after the other in order of time."""
    price = before = name = None
    for _, p, n, _, _ in sorted(rows, key=lambda r: r[0]):
        if p is not None and p != price:
            price, before = p, price
        name = name or n or None
    first, last = min(rows, key=lambda r: r[0]), max(rows, key=lambda r: r[0])
    return price, name, last[3], first[4], before


def test_every_order_and_every_cut_into_batches_gives_one_table(spark):
    """All 720 orders of six captures and all 32 cuts of each, as 23,040 keys side by side."""
    rows, trial = [], 0
    for order in itertools.permutations(CAPTURES):
        for cuts in range(32):
            number = 0
            for place, capture in enumerate(order):
                rows.append((str(trial), number, *capture))
                number += cuts >> place & 1
            trial += 1
    all_ = spark.createDataFrame(rows, "key string, batch int, time int, price double, name string, seen int, origin string").cache()
    state = None
    for number in range(6):
        batch = captures.registers(all_.where(f"batch = {number}").drop("batch"), "key", RULES, BEFORE, ["time"])
        state = captures.settle(batch if state is None else state.unionByName(batch), "key", RULES, BEFORE).cache()
    got = captures.settled_values(state, "key", RULES, BEFORE)
    assert got.count() == trial == 23_040
    assert [tuple(r) for r in got.drop("key").distinct().collect()] == [plain(CAPTURES)]


def test_subsets_follow_the_rules_in_order_of_time(spark):
    chosen = [[c for i, c in enumerate(CAPTURES) if mask >> i & 1] for mask in range(1, 64)]
    df = spark.createDataFrame([(str(k), *c) for k, part in enumerate(chosen) for c in part], SCHEMA)
    got = captures.settled_values(captures.settle(captures.registers(df, "key", RULES, BEFORE, ["time"]), "key", RULES, BEFORE), "key", RULES, BEFORE)
    assert {r.key: tuple(r)[1:] for r in got.collect()} == {str(k): plain(part) for k, part in enumerate(chosen)}


def test_only_stated_columns_keep_the_value_before(spark):
    with pytest.raises(ValueError):
        captures.registers(spark.createDataFrame([], SCHEMA), "key", RULES, {"name": "price_previous"}, ["time"])


def batch(spark, *rows):
    return spark.createDataFrame([(k, t, p, None, None, None) for k, t, p in rows], SCHEMA)


def merge(df, number, table):
    ingest.merge_batch(df, number, table, "key", RULES, BEFORE, ["time"], buckets=8)


def prices(spark, table):
    return {r.key: (r.price, r.price_previous) for r in ingest.current(spark, table, "key", RULES, BEFORE).collect()}


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    table = f"{tmp_path}/t"
    merge(batch(spark, *[(f"k{i}", 1, float(i)) for i in range(200)]), 0, table)
    assert set(ingest.manifest(spark, table).values()) == {0} and len(ingest.manifest(spark, table)) == 8
    merge(batch(spark, ("k7", 3, 70.0)), 1, table)
    assert sorted(ingest.manifest(spark, table).values()) == [0] * 7 + [1]
    assert [p.name for p in Path(table, "v=1").glob("bucket=*")] == [f"bucket={b}" for b, v in ingest.manifest(spark, table).items() if v == 1]
    assert prices(spark, table) == {f"k{i}": (float(i), None) for i in range(200)} | {"k7": (70.0, 7.0)}
    merge(batch(spark, ("k7", 2, 60.0), (None, 1, 1.0)), 2, table)  # comes late: the value before, not the value
    assert prices(spark, table)["k7"] == (70.0, 60.0) and prices(spark, table)[None] == (1.0, None)


def test_a_batch_run_again_leaves_the_same_rows(spark, tmp_path):
    table = f"{tmp_path}/t"
    merge(batch(spark, *[(f"k{i}", 1, float(i)) for i in range(50)]), 0, table)
    again = batch(spark, ("k1", 5, 9.0), ("k2", 5, None), ("x", 1, 1.0))
    merge(again, 1, table)
    one, versions = prices(spark, table), ingest.manifest(spark, table)
    merge(again, 1, table)
    assert prices(spark, table) == one and ingest.manifest(spark, table) == versions


def test_files_that_no_manifest_names_go(spark, tmp_path):
    table = f"{tmp_path}/t"
    for n in range(4):
        merge(batch(spark, ("k1", n, float(n))), n, table)
    (b,) = ingest.manifest(spark, table)
    assert [v for v in range(4) if Path(table, f"v={v}", f"bucket={b}").exists()] == [2, 3]
    assert prices(spark, table) == {"k1": (3.0, 2.0)}


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    table = f"{tmp_path}/t"
    merge(batch(spark, ("k1", 1, 1.0)), 0, table)
    merge(batch(spark, ("k1", 2, 2.0)), 1, table)
    Path(table, "manifest", "v=1", "_SUCCESS").unlink()
    assert prices(spark, table) == {"k1": (1.0, None)}


def test_stream_equals_sql(spark, sf_dir):
    for name in ("stream_upsert", "stream_registers"):
        assert_same(spark, connect(sf_dir), sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
