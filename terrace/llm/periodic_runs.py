"""Periodic runs: stretches of words that repeat with a period, found behind a mask of repeated k-grams.

A run of smallest period q and length L >= max(6, 4q) overlaps its own shift by q in L - q words, never fewer than ``OVERLAP`` = 5 (six equal words,
q = 1). So each of its words lies in a 5-gram that the document holds twice or more, and words outside such 5-grams can't join a run. What the mask
leaves falls into segments, mostly none; the repetitions of a segment are found by the divide and conquer of Main and Lorentz: those that cross
the middle, for all periods at once by four tables of common extensions, then those of either half.

Each document is searched for itself and nothing is shuffled, so the work of a document is n log n of its surviving words and no source or group of
copies can be hot; equal texts differ in what their ids plant.

Defined results: a null or empty text has no words, no run and the digests of the empty text; a null doc_id has no decimal form and nothing is
planted in its text; repeated rows get equal results; ties of the greatest length go to the smallest start, then period; very long texts are
one row like any other; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of

#: A run's least length, and how many periods it holds at least (fixed by the contract).
LEAST, PERIODS = 6, 4
#: Words in which a run overlaps its shift by one period, at least: the k of the mask.
OVERLAP = min(max(LEAST, PERIODS * q) - q for q in range(1, LEAST))

Run = tuple[int, int, int]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with what the contract repeats in every tenth document."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def segments(words: Sequence, k: int = OVERLAP) -> list[tuple[int, int]]:
    """Stretches of words that lie in repeated k-grams and are long enough for a run."""
    grams = list(zip(*(words[i:] for i in range(k))))
    if len(grams) < 2 or len(first := dict(zip(reversed(grams), range(len(grams) - 1, -1, -1)))) == len(grams):
        return []
    again, out = {g for i, g in enumerate(grams) if first[g] != i}, []
    for i, g in enumerate(grams):
        if g in again:
            if out and i <= out[-1][1]:
                out[-1][1] = i + k
            else:
                out.append([i, i + k])
    return [(s, e) for s, e in out if e - s >= LEAST]


def _extensions(w: Sequence, most: int) -> list[int]:
    """For each place below ``most``, how far the sequence agrees with its own beginning from there (the Z function)."""
    n = len(w)
    z, left, right = [n], 0, 0
    for i in range(1, min(most, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z.append(k)
    return z


def _crossing(w: Sequence, lo: int, mid: int, hi: int) -> Iterator[Run]:
    """(start, end, period) of the stretches of w[lo:hi] that have a period, lie on both sides of mid and hold PERIODS periods."""
    most = (hi - lo) // PERIODS  # less than either half has
    right, back = w[mid:hi], w[lo:mid][::-1]
    ahead, behind = _extensions(right, most + 1), _extensions(back, most + 1)
    # the words before mid against those after it, forwards and backwards, as far as a period reaches
    over = _extensions(right[:most] + [None] + back[:most][::-1], 2 * most + 1)
    under = _extensions(back[:most] + [None] + right[:most][::-1], 2 * most + 1)
    for p in range(1, most + 1):
        f, b = over[2 * most + 1 - p], under[2 * most + 1 - p]
        f, b = f + (ahead[p] if f == p else 0), b + (behind[p] if b == p else 0)
        # from words mid and mid + p both ways, then from mid - p and mid
        for s, e in ((mid - b, mid + p + ahead[p]), (mid - p - behind[p], mid + f)):
            if s < mid < e and e - s >= max(LEAST, PERIODS * p):
                yield s, e, p


def runs_of(words: list) -> list[Run]:
    """All runs as (start, length, period), by start, then period."""
    found: dict[tuple[int, int], int] = {}
    n, open_ = len(words), segments(words)
    while open_:
        lo, hi = open_.pop()
        if hi - lo < LEAST:
            continue
        mid = (lo + hi) // 2
        for s, e, p in _crossing(words, lo, mid, hi):
            # a stretch cut off by the half that it was found in is met whole at the middle that it crosses first
            if (s == 0 or words[s - 1] != words[s - 1 + p]) and (e == n or words[e] != words[e - p]) and p < found.get((s, e), n):
                found[s, e] = p  # of equal stretches the smallest period
        open_ += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that are left when each run keeps its first period only, joined by spaces."""
    if not runs:
        return b" ".join(words)
    steps = [0] * (len(words) + 1)
    for s, length, q in runs:
        steps[s + q] += 1
        steps[s + length] -= 1
    return b" ".join([w for w, inside in zip(words, accumulate(steps)) if not inside])


def digest(text: str | None, doc_id: int | None) -> tuple:
    words = planted((text or "").encode().split(), doc_id)  # bytes are split at the contract's six separators
    numbers: dict[bytes, int] = {}
    runs = runs_of([numbers.setdefault(w, len(numbers)) for w in words])
    start, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()


FIGURES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
LISTS = "doc_id long, start long, length long, period long"


def list_runs(df: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period. Texts are taken as they are; nothing is planted."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *r) for i, t in zip(batch.column("doc_id"), batch.column("text")) for r in runs_of((t.as_py() or "").encode().split())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])

    return columns_of(df, doc_id="long", text="string").mapInArrow(search, LISTS)


def op12(df: DataFrame) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(t.as_py(), i.as_py()) for i, t in zip(batch.column("doc_id"), batch.column("text"))]
            figures = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(len(FIGURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *figures], ["doc_id", *FIGURES])

    return columns_of(df, doc_id="long", text="string").mapInArrow(search, SCHEMA)
