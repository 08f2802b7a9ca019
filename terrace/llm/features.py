"""Text measures and label handling that the two classifiers share. Scores never see ids, sources, languages or labels."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, remainder

LETTERS = re.compile(r"[^\W\d_]+")

#: The measures of ``dense``, in its order.
NAMES = ("log_words", "word_length", "upper", "symbols", "bangs", "bars", "digits", "distinct", "line_words", "ends", "stops", "runs", "longest_line", "odd")


def dense(text: str | None) -> list[float]:
    """Shape of a whole text; all zero for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    low, chars = text.lower(), max(1, len(text) - text.count(" "))
    if len(low) == len(text):
        upper = int((np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())
    else:
        upper = sum(map(str.isupper, text))
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    symbols = sum(map(count, "#*$%&<>~^=@{}\\"))
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), chars / n, upper / chars, symbols / n, count("!") / n, count("|") / n, sum(map(count, "0123456789")) / chars,
        len(set(words)) / n**0.8, np.log1p(n / max(1, len(lines))), sum(x.rstrip()[-1:] in ".!?:;\"'" for x in lines) / max(1, len(lines)), (count(".") + count(",") + count("?")) / n,
        runs / n, np.log1p(max(map(len, lines), default=0)), sum(map(count, "_/[]()+")) / n,
    ]


def _part(docs: DataFrame, share: float, seed: int) -> DataFrame:
    """docs with ``o``, a hash of id and text, of which about ``share`` stay: rows of one id don't come all or none."""
    return docs.withColumn("o", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30))).where(F.col("o") < int(min(1.0, share) * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, most: int) -> DataFrame:
    """text, y and o (a hash) of training rows: those whose crc32 remainder isn't 1, a hash-chosen part of about ``most`` of them. What is gathered of them is
    cut to ``most`` by ``bounded``, so that repeated rows can't exceed it. A document with several labels counts once for each; null labels and texts
    count as absent."""
    own = columns_of(labels, doc_id="long", **{label: "int"}).where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), mod) != 1))
    share = most / max(1, own.count())
    return _part(docs.where("text IS NOT NULL"), share, 23).join(own.select("doc_id", F.col(label).alias("y")), "doc_id").select("text", "y", "o")


def sample(docs: DataFrame, mod: int, most: int, n: int) -> DataFrame:
    """text and o of about ``most`` training rows, by hash, without their labels."""
    return _part(docs.where(remainder(F.col("doc_id"), mod) != 1), most / max(1, n), 29).select("text", "o")


def bounded(measured: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of small measures, the first by hash."""
    return measured.orderBy("o").limit(most).drop("o")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
