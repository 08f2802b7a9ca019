"""Quality rules, line first: failing lines go, then documents that lose too much.

Every rule is judged per line with SQL functions (no Python runs on executors), in one pass over the
text and without a shuffle, so the cost is linear in the input and no key can be hot.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated rows
each get their own, equal result; there are no ties to break; an empty table gives an empty result; very long texts are one row like any other; extra columns are
kept untouched by ``clean_lines``, but for those that have the names of its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, columns_of, let, words

#: Characters that count as symbols for the base figures (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture (fixed values) in English, French, Spanish and German; a short line with one of them is boilerplate.
FURNITURE = (
    r"(?i)(cookie|javascript|privacy policy|terms of use|all rights reserved|sign in|log in|subscribe now|click here|lorem ipsum"
    r"|politique de confidentialité|tous droits réservés|se connecter|cliquez ici|abonnez-vous"
    r"|política de privacidad|todos los derechos reservados|iniciar sesión|haga clic|suscríbete"
    r"|datenschutzerklärung|alle rechte vorbehalten|anmelden|hier klicken|newsletter abonnieren)"
)
#: Largest share of a document's characters that failing lines may hold.
MAX_LOST = 0.5
#: Bits of a window's place beside its hash in one long: more words than a text can have.
PLACE_BITS = 28


def _length_of(line: Column, pattern: str) -> Column:
    """Characters that remain when what matches pattern is taken out."""
    return F.length(F.regexp_replace(line, pattern, ""))


def line_fails(line: Column) -> Column:
    """True if any rule fails: punctuation (symbol-ridden, shouted), navigation (bars between words),
    repetition (few distinct words) or boilerplate (a short line of page furniture). Lines without a word pass."""
    return let(
        words(line),
        lambda w: (F.size(w) >= 1)
        & (
            ((F.length(line) - F.length(F.translate(line, "#*$%&|<>", ""))) * 10 >= F.size(w) * 3)
            | ((F.size(w) >= 4) & (_length_of(line, r"\P{Lu}+") * 10 >= _length_of(line, r"\P{L}+") * 6))
            | ((F.size(w) >= 10) & (F.size(F.array_distinct(w)) * 3 < F.size(w)))
            | ((F.size(w) <= 25) & line.rlike(FURNITURE))
        ),
    )


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    Windows are sorted as (hash, place) in one long each and neighbours of equal hash are compared word by word. Where such neighbours differ, a
    hash clash may stand between equal windows, so that text's windows are sorted by their words instead.
    """
    bits = PLACE_BITS
    at = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    three = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    same_words = lambda p, q: (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
    starts = F.sequence(F.lit(0), F.size(w) - 3)

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def neighbours(s: Column, same) -> Column:
        """Places of neighbours that are the same; a window that has an equal one is in at least one such pair."""
        return F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: same(F.get(s, j - 1), F.get(s, j)))

    def by_hash(s: Column) -> Column:
        hit = neighbours(s, lambda a, b: F.shiftright(a, bits) == F.shiftright(b, bits))

        def judged(hit: Column) -> Column:
            places = F.transform(hit, lambda j: F.struct(at(F.get(s, j - 1)).alias("p"), at(F.get(s, j)).alias("q")))
            return let(places, lambda z: F.when(F.forall(z, lambda x: same_words(x.p, x.q)), covered(F.flatten(F.transform(z, lambda x: F.array(x.p, x.q))))).otherwise(by_words()))

        return let(hit, judged)

    def by_words() -> Column:
        listed = F.array_sort(F.transform(starts, lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(three(i))], i.alias("i"))))
        return let(listed, lambda s: covered(F.flatten(F.transform(neighbours(s, lambda a, b: (a.w0 == b.w0) & (a.w1 == b.w1) & (a.w2 == b.w2)), lambda j: F.array(F.get(s, j - 1).i, F.get(s, j).i)))))

    key = lambda i: F.shiftleft(F.xxhash64(*three(i)), bits).bitwiseOR(i.cast("long"))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(F.transform(starts, key)), by_hash))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The base figures of a text, given its words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
    }


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """df with the base figures, ``clean_text`` (lines that pass), ``lost`` (share of characters in failing
    lines), ``base_failed`` and ``kept``. Columns of df with these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_w", words(F.col(text)))
    out = out.withColumns(measures(F.col(text), F.col("_w"))).drop("_w")
    out = out.withColumn("_ok", F.filter(F.split(t, "\n"), lambda x: ~line_fails(x)))
    out = out.withColumn("clean_text", F.array_join("_ok", "\n")).drop("_ok")
    solid = lambda c: F.length(F.regexp_replace(c, SPACE, ""))
    out = out.withColumn("lost", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - solid(F.col("clean_text")) / F.col("word_chars")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= max_lost))


def op10(df: DataFrame) -> DataFrame:
    """The digest of ``clean_lines`` for each document."""
    docs = columns_of(df, doc_id="long", text="string")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
