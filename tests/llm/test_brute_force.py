"""Operators against plain versions, invariants and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from terrace.llm import context_mixing, license_scan, line_rules, mixing, ngram_join, packing, quality_pu, queries, toxicity, url_filter
from terrace.llm.common import materialize


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- n-gram join ---
def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def edited_copies(seed):
    """A base with many edited copies, of which pairs are similar, hardly similar or not; exact copies; a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 4)))
    base, passage, rows = [word() for _ in range(80)], [word() for _ in range(15)], []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60, 110):
        w = [word() for _ in range(r.randint(1, 60))]
        at = r.randrange(len(w))
        rows.append((i, " ".join(w[:at] + passage + w[at:])))
    for i in range(110, 130):
        rows.append((i, rows[r.randrange(110)][1].upper()))
    chain = [word() for _ in range(60)]
    for i in range(130, 150):
        chain = chain[1:] + [word()]
        rows.append((i, " ".join(chain)))
    return rows


@pytest.mark.parametrize("seed,k,percent,rounds", [(1, 4, 85, 2), (2, 5, 80, 0), (3, 4, 85, 1)])
def test_components_equal_brute_force(docs, monkeypatch, seed, k, percent, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "CENTRES", 2)
    monkeypatch.setattr(ngram_join, "LEFT_PER_ROW", 0)
    rows = edited_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(*rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_of_the_test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_join"](spark, sf_dir).collect()}
    assert got == brute_components(rows, 4, 85)


# --- classifiers ---
def accuracy(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in y]
    return sum(r.predicted == y[r.doc_id] for r in held) / len(held), held


def test_quality_held_out(spark, sf01):
    rows = queries.QUERIES["op2_quality_pu"](spark, sf01).collect()
    got, held = accuracy(rows, spark.read.parquet(f"{sf01}/labels.parquet"), "quality")
    assert got > 0.85 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_held_out(spark, sf01):
    got, _ = accuracy(queries.QUERIES["op8_toxicity"](spark, sf01).collect(), spark.read.parquet(f"{sf01}/labels.parquet"), "toxic")
    assert got > 0.93


def test_prior_is_near_the_share_of_positives():
    r = np.random.default_rng(0)
    good, bad = r.normal(2, 1, 4000), r.normal(-3, 1, 1000)
    cuts, rest = quality_pu.cuts_of(good[:2000]), np.r_[good[2000:], bad[:600]]
    assert abs(quality_pu.estimate_prior(good[:2000], np.array([(rest >= c).mean() for c in cuts]), cuts) - 2000 / 2600) < 0.05


def test_label_model_finds_the_accurate_voter():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    say = lambda right: np.where(r.random(4000) < right, y, ~y)
    a, b, c = say(0.95), say(0.7), say(0.8)
    votes = np.where(np.c_[a, b, b, c], toxicity.TOXIC, toxicity.CLEAN)  # the second and third say the same
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts)
    assert {(1, 2), (2, 1)} & {(v, int(p)) for v, p in enumerate(model.parent)}  # the tie is a parameter of the model
    assert ((model.posterior(patterns)[at.ravel()] > 0.5) == y).mean() > 0.9


def exact_posterior(model, votes):
    """P(toxic | votes) by the definition of the tree model."""
    p = []
    for c in (0, 1):
        x = model.prior[c]
        for v, parent in enumerate(model.parent):
            x *= model.tables[c, v, votes[parent] if parent >= 0 else 0, votes[v]]
        p.append(x)
    return p[1] / sum(p)


def test_posteriors_against_their_definition():
    r = np.random.default_rng(4)
    votes = r.integers(0, 3, (200, 5))
    votes[:, 3] = votes[:, 1]
    model = toxicity.fit_label_model(votes, np.ones(200), rounds=25)
    assert np.allclose(model.posterior(votes), [exact_posterior(model, v) for v in votes])


@pytest.mark.parametrize("name,column", [("op2_quality_pu", "quality"), ("op8_toxicity", "toxic")])
def test_labels_of_held_out_rows_change_nothing(spark, sf01, name, column):
    docs, labels = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    flipped = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col(column)).otherwise(F.col(column)))
    op = {"op2_quality_pu": quality_pu.op2, "op8_toxicity": toxicity.op8}[name]
    key = lambda d: sorted((r.doc_id, round(r.score, 9)) for r in d.collect())
    assert key(op(docs, labels)) == key(op(docs, flipped))


# --- url filter ---
def test_cascade_is_exact(spark):
    r = random.Random(5)
    listed = [f"h{i}.example/" for i in range(300)]
    universe = listed + [f"k{r.random()}/" for _ in range(5000)]
    u = spark.createDataFrame([(k,) for k in universe], "key string")
    cascade = url_filter.build_cascade(u.limit(0).union(spark.createDataFrame([(k,) for k in listed], "key string")), u, rate=0.2)
    assert len(cascade.parts[0].levels) >= 3
    assert {r.key for r in u.where(cascade.contains(F.col("key"))).collect()} == set(listed)


def test_long_lists_are_dealt_to_several_cascades_with_the_same_result(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = lambda d: sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in d.collect())
    assert key(url_filter.judge_urls(pages, max_bits=24)) == key(url_filter.judge_urls(pages))


# --- mixing ---
@pytest.mark.parametrize("total,marked,drawn", [(100, 30, 50), (7, 3, 2), (5, 5, 2), (5, 0, 3), (1, 1, 1), (40, 1, 20)])
def test_hypergeometric_law(spark, total, marked, drawn):
    n = 20_000
    rows = spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), (F.col("id") + 0.5) / n).alias("k")).groupBy("k").count().collect()
    for r in rows:
        assert abs(r["count"] / n - math.comb(marked, r.k) * math.comb(total - marked, drawn - r.k) / math.comb(total, drawn)) < 3 / n + 1e-4


def test_tree_keeps_quotas_and_balances_shards(spark):
    q = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 333), ("d", 0)], "skey string, quota long")
    cuts = {r.skey: r.cuts for r in mixing.split_quotas(q, 8).collect()}
    per = {k: np.diff([0, *v]) for k, v in cuts.items()}
    assert {k: v.sum() for k, v in per.items()} == {"a": 1000, "b": 10, "c": 333, "d": 0} and all((v >= 0).all() for v in per.values())
    assert np.ptp(sum(per.values())) <= 3


def water(sizes, weights, total):
    """Targets by plain rounds."""
    target, open_ = {}, dict(zip(sizes, weights))
    left = total
    while open_:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        full = [k for k in open_ if share[k] >= 2 * sizes[k]]
        if not full:
            return target | share
        for k in full:
            target[k] = 2 * sizes[k]
            left -= target[k]
            del open_[k]
    return target


def test_mix_of_the_test_table(spark, sf_dir):
    rows = queries.QUERIES["op5_mixing"](spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = water({s: size[s] for s in order}, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS
    again = queries.QUERIES["op5_mixing"](spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_blocks_are_disjoint(docs):
    d = mixing.sized(docs(*[(i, "w " * (i * 37 % 900), f"s{i % 3}") for i in range(60)]))
    b = mixing.draw_blocks(d, shards=4).where("shard IS NOT NULL")
    assert b.count() == b.select("doc_id", "epoch", "block").distinct().count()
    assert 0 <= b.agg(F.min("shard")).first()[0] and b.agg(F.max("shard")).first()[0] <= 3


def test_equal_rows_are_drawn_singly(docs):
    rows = [(1, "w " * 100, "a")] * 300 + [(i, "w " * 100, "a") for i in range(2, 102)] + [(500 + i, "w " * 100, "b") for i in range(20)]
    got = mixing.op5(docs(*rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        s = "b" if r.doc_id >= 500 else "a"
        taken[s] += r.taken
        target[s] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 256 for s in "ab")


# --- licence scan ---
def test_license_base_against_brute_force(docs):
    r = random.Random(3)
    bits = ["the", "MIT", "License", "mit-license", "Apache License,", "GNU General Public License", "général", "license", "\n", "general  public"]
    rows = [(i, " ".join(r.choices(bits, k=r.randint(0, 40)))) for i in range(60)]
    got = {x.doc_id: x for x in license_scan.op6(docs(*rows)).collect()}
    for i, t in rows:
        w = [x for x in re.split(license_scan.SEPARATORS, t.translate({c: c + 32 for c in range(65, 91)})) if x]
        at = sorted((j, l) for p, l in license_scan.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({l for _, l in at})))
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_spans_bear_an_edit(docs):
    t = "x y permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and"
    got = {x.doc_id: x for x in license_scan.op6(docs((1, t), (2, "permission is granted"), (3, "Licensed under CC BY-NC 4.0."))).collect()}
    assert (got[1].labels, got[1].base_labels, got[2].labels, got[3].labels) == ("mit", "", "", "cc-by-nc")


def plain_spans(words):
    """By definition: a template's best cover by the diagonals of one place and the next SHIFT, of groups of words compared one by one."""
    best = {}
    for text, label, base in [(*b, True) for b in license_scan.BASE] + [(*t, False) for t in license_scan.TEMPLATES]:
        t, k = re.split(license_scan.SEPARATORS, text), license_scan.BASE_K if base else license_scan.K
        groups = {i: t[i : i + k] for i in range(len(t) - k + 1) if base or set(t[i : i + k]) - license_scan.COMMON}
        met = {}
        for j in range(len(words) - k + 1):
            for i, g in groups.items():
                if words[j : j + k] == g:
                    met.setdefault(j - i, set()).add(i)
        reach = 0 if base else license_scan.SHIFT
        share = max((len(set().union(*[met.get(d + n, set()) for n in range(reach + 1)])) / len(groups) for d in met), default=0)
        alone = max((len(m) / len(groups) for m in met.values()), default=0)
        cover = 1 if base else license_scan.COVER_LONG if len(groups) >= license_scan.LONG else license_scan.COVER
        if share >= cover:
            best.setdefault(label, []).append(alone if alone >= cover else share)
    return best


def test_license_labels_against_plain_code(docs):
    r = random.Random(8)
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(1, 3)):
            t = r.choice(license_scan.TEMPLATES)[0].split()
            for _ in range(r.choice((0, 1, 2, len(t) // 8, len(t) // 4))):  # words changed, left out or put in
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = r.choice(([], ["zebra"], ["the"]))
                t = t or ["zebra"]
            w += ["and", *t, *r.choices(["the", "license", "mit", "of"], k=r.randint(0, 4))]
        rows.append((i, " ".join(w)))
    seen = set()
    for x in license_scan.op6(docs(*rows)).collect():
        want = plain_spans(rows[x.doc_id][1].split())
        assert set(filter(None, x.labels.split(","))) == set(want), rows[x.doc_id]
        assert bool(want) == (x.score > 0) and (not want or x.score >= min(license_scan.COVER_LONG, *[max(v) for v in want.values()]) - 1e-9)
        seen |= set(want)
    assert len(seen) > 10


def test_wording_of_whole_licences(docs):
    rows = (
        (1, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'), (2, "Boost Software License - Version 1.0"),
        (3, "This is free and unencumbered software released into the public domain."), (4, "Redistribution and use in source and binary forms, with or without changes, are permitted provided that all of the following conditions are met:"),
        (5, "Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), (6, "The software is provided to all who want it, and it is free of charge to any person."),
    )
    assert {x.doc_id: x.labels for x in license_scan.op6(docs(*rows)).collect()} == {1: "as-is", 2: "boost", 3: "unlicense", 4: "bsd", 5: "bsd", 6: ""}


def test_repeated_short_wording_keeps_its_label(docs):
    rows = ((1, "x " + "mozilla public license " * 4), (2, "Licensed under CC BY-NC " + "4.0 " * 12), (3, "mozilla public license"))
    assert {x.doc_id: x.labels for x in license_scan.op6(docs(*rows)).collect()} == {1: "mpl", 2: "cc-by-nc", 3: "mpl"}


# --- packing ---
def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(1, "Hello, World! don't"), (2, None), (3, "café CAFÉ naïve ΣΑΣ <|endoftext|> x\tb\u00a0c"), (4, "word " * 9000), (5, "a.b,c..d !? 12345 x."), (6, "İstanbul e\u0301")]
    got = {}
    for r in sorted(packing.pack(docs(*rows), with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and r.start == len(got.get(r.doc_id, []))
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    ids = [r.sequence_id for r in packing.op7(docs(*rows, *rows)).collect()]
    assert len(ids) == len(set(ids))


def test_binary_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        got = packing.binary_lengths(n, 4096)
        assert sum(got) == n and all(k & (k - 1) == 0 for k in got) and len(set(got[n // 4096 :])) == len(got) - n // 4096


# --- language model ---
def test_base_scores_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(context_mixing, "HOT", 500)  # most words take the shuffle join
    rows = queries.QUERIES["op9_context_mixing"](spark, sf_dir).collect()
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(context_mixing.tokens(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = context_mixing.tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_bits_are_a_distribution_over_words():
    """All words of up to two letters, and what comes after, have probability one in all."""
    code = context_mixing.Code(np.bincount([97, 98, 32, 10], minlength=256))
    m = context_mixing.Mixer(np.zeros((context_mixing.ORDERS, context_mixing.SLOTS, 2)), code)
    m.learn([b"ab", b"ba", b"a"], np.array([2.0, 1.0, 2.0]))
    one = [bytes([x]) for x in range(256) if x not in (32,)]
    p = 10 ** m.log10(one)
    assert 0 < p.sum() <= 1 + 1e-6
    kraft = sum(2.0 ** -int(k) for k in code.length)
    assert math.isclose(kraft, 1.0)


def test_spelling_is_learned_from_every_occurrence(spark):
    """A slot's counts are the bits of all occurrences of all training words."""
    words = [(b"ab", 1000), (b"abc", 9), (b"ba", 1), (b"cab", 0)]
    code = context_mixing.Code(np.bincount([97, 98, 99, 32, 10], minlength=256))
    got = context_mixing.slot_counts(spark.createDataFrame(words, "w binary, c long").repartition(3), code)
    want = np.zeros_like(got)
    for w, c in words:
        b = context_mixing.Bits([w], code)
        for j in range(context_mixing.ORDERS):
            for slot, bit in zip(b.slots[j], b.bit):
                want[j, slot, int(bit)] += c
    assert (got == want).all() and got.max() >= 1000


def test_many_texts_are_read_as_one_by_one():
    r = random.Random(5)
    texts = [[r.randrange(k) for _ in range(n)] for k, n in [(1, 1), (1, 30), (2, 50), (3, 2), (9, 200), (40, 1), (5, 90)]]

    def plain(words):
        hits, misses, given, after, run = [0] * 8, [0] * 8, [], {}, 0
        for i in range(1, len(words)):
            if (bet := after.get(words[i - 1])) is not None:
                (hits if bet == words[i] else misses)[run] += 1
                given += [i] if bet == words[i] else []
                run = min(7, run + 1) if bet == words[i] else 0
            after[words[i - 1]] = words[i]
        return hits, misses, given

    sizes = np.array([len(t) for t in texts])
    hits, misses, given = context_mixing.read_all(np.concatenate(texts), sizes)
    want = [plain(t) for t in texts]
    assert hits.tolist() == [w[0] for w in want] and misses.tolist() == [w[1] for w in want]
    assert given.tolist() == [x + at for at, w in zip(np.cumsum(sizes) - sizes, want) for x in w[2]]


def test_match_predictor_pays_off_on_repetition():
    hits, misses, given = context_mixing.read([b"a", b"b"] * 500)
    assert len(given) == sum(hits) and context_mixing.match_log10(hits, misses) > -10


def test_matches_sum_to_one():
    """The adaptive odds of all sequences of three bets add up to one."""
    total = 0.0
    for outcome in range(8):
        bits = [(outcome >> k) & 1 for k in range(3)]
        total += 10 ** context_mixing.match_log10([sum(bits)] + [0] * 7, [3 - sum(bits)] + [0] * 7)
    assert math.isclose(total, 1.0)


def test_chunk_bits_sum_to_one():
    facts = [(1, 1), (3, 0), (2, 1), (1, 0)]
    total = sum(10 ** context_mixing.chunk_log10([(*f, o >> i & 1) for i, f in enumerate(facts)]) for o in range(16))
    assert math.isclose(total, 1.0)


def test_scores_of_another_partitioning_and_of_repeated_texts(spark, docs, sf_dir):
    """Partitions change nothing; a text that training texts hold elsewhere costs far fewer bits than one that they don't; the whole score of a tiny
    corpus is what plain code gives."""
    base = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    long = next(t for i, t in base if t and len(t.split()) > 300 and sum(t == u for _, u in base) == 1 and zlib.crc32(str(i).encode()) % 5 != 1)
    free = next(i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = base + [(free, long)]
    one = {r.doc_id: r for r in context_mixing.score_documents(docs(*rows)).collect()}
    two = {r.doc_id: r for r in context_mixing.score_documents(docs(*rows).repartition(5)).collect()}
    assert all(math.isclose(one[i].score, two[i].score, rel_tol=1e-6) for i in one)
    assert one[free].bits < 0.5 * -one[free].base_score * math.log2(10)
    assert one[free].n_bytes == len(long.encode()) and math.isclose(one[free].bits, -one[free].score * math.log2(10))


def test_sequels_against_brute_force(spark):
    """The bet and its facts are those of the other training documents alone: each is counted without the document that is asked."""
    r = random.Random(2)
    rows = [(i, r.random() < 0.3, 1, r.randrange(40), r.choice((0, 0, 0, 1, 2)), -1.0) for i in range(300)]
    got = {x.row: (x.seen, x.same, x.hit) for x in context_mixing.sequels(spark.createDataFrame(rows, "row long, out boolean, idx int, context long, sequel long, own double")).collect()}
    want = {}
    for i, _, _, c, s, _ in rows:
        others = Counter(z for k, o, _, d, z, _ in rows if d == c and not o and k != i)
        n = sum(others.values())
        if n and max(others.values()) * 2 > n:
            bet = max(others, key=others.get)
            want[i] = (min(9, n), int(len(others) == 1), int(bet == s))
    assert got == want and {h for _, _, h in want.values()} == {0, 1}


def test_a_training_document_is_not_its_own_evidence(spark, docs):
    """A text that stands once costs as much in training as held out, but for what its words count; its own repeats are no evidence from elsewhere."""
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = [f"w{k}" for k in range(400)]
    r = random.Random(4)
    texts = [" ".join(r.choices(words, k=300)) for _ in range(12)]
    once = context_mixing.score_documents(docs(*[(train[i], t) for i, t in enumerate(texts)])).collect()
    many = context_mixing.score_documents(docs(*[(train[i], t) for i, t in enumerate([*texts, texts[0]])])).collect()
    before, after = ({x.doc_id: x.bits for x in rows} for rows in (once, many))
    assert after[train[0]] < 0.5 * before[train[0]]
    assert all(after[train[i]] > 0.9 * before[train[i]] for i in range(1, 12))
    one = " ".join(r.choices(words, k=100))
    chunk = lambda *ts: [(i, False, k, int(c), int(s), 0.0) for i, t in enumerate(ts) for k, (c, s) in enumerate(zip(*context_mixing.chunks(np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64))[1:]))]
    alone = spark.createDataFrame(chunk(one), "row long, out boolean, idx int, context long, sequel long, own double")
    assert alone.count() > 0 and context_mixing.sequels(alone).count() == 0


# --- quality rules ---
def test_repeat_words_against_brute_force(docs):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(0, 30)))) for i in range(80)] + [(99, "x y z " * 400)]
    got = {x.doc_id: x.n_repeat_words for x in line_rules.op10(docs(*rows)).collect()}
    for i, t in rows:
        w = t.split()
        n = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        assert got[i] == len({p for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)})


def test_repeat_words_with_forced_hash_clashes(docs, monkeypatch):
    monkeypatch.setattr(line_rules, "PLACE_BITS", 61)
    test_repeat_words_against_brute_force(docs)


def test_lines_that_fail_go(docs):
    good = [f"This is plain sentence {i} with {i} good {i} many {i} words {i} in it, and it ends well." for i in ("one", "two", "three", "four", "five")]
    text = "\n".join(good + ["Home | About | Contact | Terms | More", "We use cookies to improve the site.", "BUY NOW CHEAP STUFF HERE TODAY", "#### $$$$ %%%%"])
    r = line_rules.clean_lines(docs((1, text))).first()
    assert r.clean_text == "\n".join(good) and r.kept
    assert not line_rules.clean_lines(docs((1, "BUY!! NOW!! CHEAP!! STUFF!! " * 40))).first().kept


def test_materialized_tables_are_read_back(spark):
    assert materialize(spark.range(5)).count() == 5
