"""Spelling variants, periodic runs and token counts against plain versions."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrace.llm import periodic_runs, queries, spelling, token_counts


# --- spelling variants ---
def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    by_length, out, form = {}, {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        around = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(around)
    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def variants(df):
    return {r.word: tuple(r)[1:] for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def crowded_words(seed):
    """Words of few letters, so that segments are crowded, runs of one letter, accents, chains of forms, ties of counts."""
    r = random.Random(seed)
    words = {"".join(r.choices("abé", k=r.randint(5, 7))) for _ in range(250)} | {"a" * k for k in range(5, 12)} | {"stem" + "".join(r.choices("abcdefghij", k=2)) for _ in range(60)} | {"é" * 300, "é" * 301, "é" * 150 + "a" + "é" * 150}
    return {w: r.choice([3, 3, 4, 6, 8, 12, 16, 40, 100]) for w in sorted(words)}


@pytest.mark.parametrize("seed,crowd", [(1, 1), (2, 4), (3, 24)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    n = crowded_words(seed)
    assert variants(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_variants_of_texts(docs, monkeypatch):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeÀé", k=r.randint(3, 9))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(vocabulary).title() + r.choice(["", ",", "×"]) for _ in range(60))) for i in range(200)] + [(None, vocabulary[0] + " " + vocabulary[1])] * 40
    n = plain_counts(rows)
    assert any(w not in map(str.lower, vocabulary) for w in n)
    assert variants(spelling.op11(docs(*rows))) == plain_variants(n)


def test_a_pair_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", 1)
    n = crowded_words(7)
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long")).collect())
    assert got == sorted(tuple(sorted((a, b))) for a in n for b in n if a < b and near(a, b))


# --- periodic runs ---
def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_digest(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = plain_runs(w)
    out = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in out))


def repeated_words(seed, n):
    """Texts of few words with planted periods, long and short, and an odd word here and there."""
    r, rows = random.Random(seed), []
    for i in range(n):
        w = [r.choice("abcdefghijk"[: r.choice([1, 2, 3, 11])]) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            at, period = r.randrange(len(w) + 1), [r.choice("abcd") for _ in range(r.randint(1, 12))]
            w[at:at] = (period * 9)[: r.randint(1, 9 * len(period))]
        if w and r.random() < 0.5:
            w[r.randrange(len(w))] = "odd"
        rows.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return rows


def test_runs_equal_brute_force(docs):
    rows = repeated_words(1, 400) + [(None, "x " * 50), (7, None), (8, ""), (9, "word word\x1cword  b")]
    got = sorted((tuple(r) for r in periodic_runs.op12(docs(*rows)).collect()), key=str)
    assert got == sorted((plain_digest(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 400 and sum(r[1] > 1 for r in got) > 50


def test_run_lists(docs):
    rows = repeated_words(2, 60)
    want = [(i, *run) for i, t in rows for run in plain_runs(t.split())]
    assert sorted(tuple(r) for r in periodic_runs.list_runs(docs(*rows)).collect()) == sorted(want)


def test_mask_leaves_nothing_of_a_text_without_repeats():
    assert periodic_runs.OVERLAP == 5
    assert periodic_runs.segments(list(range(1000))) == []
    assert periodic_runs.segments([1, 2, 3, 4, 5, 90, 91, 1, 2, 3, 4, 5]) == []  # five words, too short for a run
    assert periodic_runs.segments([8, *[1] * 6, 9]) == [(1, 7)]


def test_runs_of_the_test_table(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert all(got[r.doc_id] == plain_digest(r.doc_id, r.text) for r in rows)


def test_a_long_run_is_found_in_n_log_n():
    assert periodic_runs.runs_of([1] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.runs_of([*range(3000)] * 10) == [(0, 30_000, 3000)]


# --- token counts ---
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def plain_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


ODD_TEXTS = [
    None, "", " ", "\n\n  \t x", "it's we'll they'VE", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "  <|endoftext|>  ", "<|endoftext|", "  x　 y \x85z", "🙂🙂 👩‍👩 é ½ ² Ⅷ १२", "日本語 テキスト", "x" * 3000, "\x00\x1c\x7f", "a  b   c", "a\u05581 \U00010940x\u058b",
]


@pytest.mark.parametrize("table", ["frequent", "empty"])
def test_tokens_equal_the_library(docs, library, monkeypatch, table):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 200)
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, "".join(r.choices("ab c'sé1²\n\t!?<|>🙂 ", k=r.randint(0, 400)))) for i in range(300)]
    got = {x.doc_id: x for x in token_counts.count_tokens(docs(*rows), **({"frequent": lambda d, path: {}} if table == "empty" else {})).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), plain_tokens(library, t)), repr(t)


def test_every_sign_is_cut_as_the_library_cuts_it(library):
    """Each sign that Python knows between letters, digits, spaces and other signs: classes of signs are the library's."""
    own = token_counts._tokenizer(token_counts.default_vocabulary())
    signs = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    for at in range(0, len(signs), 4096):
        text = "".join(f"a{c}1 {c} {c}{c}a!{c}\n" for c in signs[at : at + 4096])
        theirs = [text[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert own.pattern.findall(text) == theirs


def test_tokens_of_the_test_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.over_limit) == ((n := plain_tokens(library, texts[r.doc_id])), n > 1024) for r in got)


def test_frequent_parts_are_those_of_all_documents(docs):
    common = [(i, "the cat sat on the mat") for i in range(300)]
    found = token_counts.frequent_lengths(docs(*common, (300, "rare " + " ".join(f"w{i}" for i in range(9000)))).repartition(3), token_counts.default_vocabulary())
    assert {" the", " cat", "the"} <= set(found) and " w8999" not in found and all(n >= 1 for n in found.values())


def test_a_full_summary_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(token_counts, "SUMMARY", 100)
    own = token_counts._tokenizer(token_counts.default_vocabulary())
    assert set(token_counts.summary(own, (f" the q{i}" for i in range(5000)))) >= {" the", " q"}


# --- odd rows ---
@pytest.mark.parametrize("op", [spelling.op11, periodic_runs.op12, token_counts.op13])
def test_odd_rows_and_empty_tables(op, odd):
    clash = odd.select("*", F.lit("clash").alias("TEXT"), *[F.lit(3).alias(c) for c in ("word", "n", "run", "key", "n_bytes", "N_Bytes")])
    rows = op(clash).collect()
    if op is spelling.op11:
        assert {r.word: (r.n, r.form) for r in rows} == {w: (c, None) for w, c in plain_counts([(r.doc_id, r.text) for r in odd.collect()]).items()}
    else:
        assert len(rows) == odd.count() and len({tuple(r) for r in rows if r.doc_id == 5}) == 1
    assert op(clash.limit(0)).collect() == []
    assert op(odd.drop("text")).count() == (0 if op is spelling.op11 else odd.count())
