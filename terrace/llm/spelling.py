"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut into two segments, its first l // 2 letters and the rest. One edit leaves one of them whole, so a near word of equal length
has that segment at the same place, and one that is a letter longer has the first segment at the same place or the second shifted by one. Each
word is indexed under (length, segment, text) and probes with its own such substrings; what meets is verified as one edit.

A segment that many words have would pair them all. So keys are counted, and a crowded one is cut again: the part of the words in which the edit
must lie is halved, as long as the key is crowded, down to one place, where all words that meet are near. The keys of a level split the places
of an edit, so each pair is taken at one place only (for a letter put in, the first at which the words differ) and no pair has to be found twice and thrown away.

Words are counted with map-side combine, so a frequent word is one row a task. Forms are followed to their roots by pointer doubling: counts at least double
with each step, so a chain of k forms takes log2(k) rounds and can't be a circle.

Defined results: a null or empty text has no words; a null doc_id is the empty string before the colon; repeated rows count as often as they occur; ties of near
words go to the smallest in code-point order; very long texts and very long words are read whole; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, discard, materialize

#: Letters of a run once A-Z are lower-cased, how long words are and how often they occur, at least (fixed by the contract).
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"a-zÀ-ÿ", 5, 3
#: One occurrence in so many loses a letter (fixed by the contract).
DELETE_EVERY = 97
#: How many times as frequent as a word its form is, at least.
FORM_RATIO = 2
#: Words that may meet under one key; a key with more is cut again.
CROWD = 24
KEY = ["kind", "l", "lo", "hi", "key"]


def _part(word: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """word[start:end], places from 0."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.char_length(word) if end is None else F.lit(end) if isinstance(end, int) else end
    return F.substring(word, start + 1, F.greatest(end - start, F.lit(0)))


def word_counts(df: DataFrame) -> DataFrame:
    """word, n: the words of all texts, as the contract alters them, that are long and frequent enough."""
    docs = columns_of(df, doc_id="long", text="string")
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))  # shorter runs only get shorter
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DELETE_EVERY == 0, F.concat(_part(F.col("run"), 0, at), _part(F.col("run"), at + 1))).otherwise(F.col("run"))
    words = each.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _segments(words: DataFrame) -> DataFrame:
    """The first level's rows: each word indexed under its two segments (longer = false) and, as a word that may be one letter longer
    than another, probing for segments of a word shorter by one. lo and hi bound the place of the edit in the shorter word."""
    w, length = F.col("word"), F.char_length("word")

    def rows(l: Column, shift: int) -> list[Column]:
        h = F.floor(l / 2).cast("int")
        of = lambda lo, hi, key: F.struct(F.lit(bool(shift)).alias("longer"), l.alias("l"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), key.alias("key"))
        return [of(h, l, _part(w, 0, h)), of(F.lit(0), h - 1, _part(w, h + shift))]

    both = F.concat(F.array(*rows(length, 0)), F.when(length > LEAST_LENGTH, F.array(*rows(length - 1, 1))).otherwise(F.array()))
    return words.select("word", "n", F.lit(-1).alias("kind"), F.explode(both).alias("x")).select("word", "n", "kind", "x.*")


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of crowded keys under keys of the next level. From there on words of equal length (kind 0) and pairs of a word and a longer one (kind 1) have
    keys of their own: all that lies before the first and behind the last place of the edit."""
    kinds = F.filter(F.array(F.lit(0), F.lit(1)), lambda k: ((F.col("kind") == -1) | (F.col("kind") == k)) & ((k == 1) | ~F.col("longer")))
    rows = rows.select("word", "n", F.explode(kinds).alias("kind"), "longer", "l", "lo", F.col("hi").alias("top"))
    last = F.when(F.col("kind") == 0, F.least("top", F.col("l") - 1)).otherwise(F.col("top"))
    middle = F.floor((F.col("lo") + last + 1) / 2).cast("int")
    ranges = F.when(F.col("lo") < last, F.array(F.struct(F.col("lo"), (middle - 1).alias("hi")), F.struct(middle.alias("lo"), last.alias("hi")))).otherwise(F.array(F.struct(F.col("lo"), last.alias("hi"))))
    cut = rows.select("word", "n", "kind", "longer", "l", F.explode(ranges).alias("x")).select("word", "n", "kind", "longer", "l", "x.*")
    behind = F.col("hi") + F.when((F.col("kind") == 0) | F.col("longer"), F.lit(1)).otherwise(F.lit(0))
    return cut.withColumn("key", F.concat(_part(F.col("word"), 0, F.col("lo")), _part(F.col("word"), behind)))


def _meet(rows: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the near pairs among words that meet under a key; a is the shorter or the smaller word."""
    a = rows.where("NOT longer").select(*KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.where("longer OR kind <> 1").select(*KEY, "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = a.join(b, KEY).where(F.col("longer") | (F.col("a") < F.col("b")))
    # a letter put into a row of equal ones can be any of them: the pair counts where the words first differ
    first = ~F.col("longer") | (F.col("hi") >= F.col("l")) | (_part(F.col("a"), 0, F.col("hi") + 1) != _part(F.col("b"), 0, F.col("hi") + 1))
    return found.where(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words one edit apart, once. words: word, n. What it returns is read from tables in the shared folder."""
    rows, found, old = _segments(words), [], []
    while True:
        rows = materialize(rows)
        met = rows.groupBy(KEY).agg(F.count("*").alias("size"))
        # a key is final once the edit can only be at one place; kind -1 is never
        crowded = met.where((F.col("size") > CROWD) & ((F.col("kind") == -1) | (F.col("lo") < F.col("hi")))).select(*KEY)
        crowded = materialize(crowded)
        found.append(materialize(_meet(rows.join(crowded, KEY, "left_anti"))))
        if crowded.isEmpty():
            break
        old += [rows, crowded]
        rows = _halves(rows.join(crowded, KEY, "left_semi"))
    discard(rows, crowded, *old)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form. forms: word, form."""
    up, old = materialize(forms.select("word", F.col("form").alias("root"))), []
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(up)
        up = moved
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")


def group_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """words: word, n. Adds form (its near word of largest n, if that is ``ratio`` times its own or more), root, n_near and form_n."""
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("m"), F.col(y).alias("near")).alias("best"))
    either = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")
    per = either.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    out = words.join(per, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")
    )
    out = materialize(out)
    return out.join(_roots(out.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(df: DataFrame) -> DataFrame:
    return group_variants(materialize(word_counts(df)))
