"""Token counts by a two-tier lookup on the map side: the lengths (in tokens) of frequent pre-tokens are broadcast as one compact table, and every
other pre-token is encoded once per worker and kept in a cache, so no pre-token is shuffled to be counted.

Whether a pre-token is frequent is judged over all documents: each task counts the pre-tokens of all its texts in a summary of bounded size and hands on
those that make up a share of ``SHARE`` of them or more, at most 1 / SHARE rows a task. A pre-token with that share of the whole corpus has it in some
task, so none is missed. The table holds at most ``TABLE`` entries. It decides what is looked up where, never a count: with an empty table the
result is the same. Texts stay where they are, so one source or a very long document costs its own tokens only.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special token's string inside a text is that token, as is the library's default;
repeated rows get equal results; there are no ties but for the table's last entry, which changes nothing; very long texts are read pre-token by pre-token
without a list of them; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: A pre-token with this share of a task's pre-tokens is handed on as frequent.
SHARE = 1 / 4096
#: Entries of the broadcast table.
TABLE = 16_384
#: Pre-tokens that a task's summary counts at a time; half of them, the rarer ones, go when it is full.
SUMMARY = 131_072
#: Pre-tokens that a worker's cache holds before it starts afresh, and how long they may be.
CACHE, CACHED_LENGTH = 400_000, 48
#: Texts with more characters than this are not cut into a list of pre-tokens.
LONG_TEXT = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Tokenizer:
    """The library's tokenizer with its pre-tokens: parts of a text that are encoded each for itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def length(self, part: str) -> int:
        return len(self.library.encode(part, add_special_tokens=False).ids)

    def stretches(self, text: str) -> tuple[list[str], int]:
        """What lies between the special tokens of a text, and how many of these there are."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        found = self.special.split(text)
        return found, len(found) - 1

    @staticmethod
    def known(text: str) -> bool:
        """Whether Python knows every sign of the text. Which of the others are letters may be told differently by the library, so it gets such a text whole."""
        return text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(text))

    def parts(self, text: str) -> Iterable[str]:
        return self.pattern.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.pattern.finditer(text))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


class _Lengths(dict):
    """Second tier: lengths of the pre-tokens that this worker has met, over the frequent ones as first tier."""

    def __init__(self, tokenizer: _Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, part: str) -> int:
        n = self.tokenizer.length(part)
        if len(part) <= CACHED_LENGTH:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n

    def of(self, text: str) -> int:
        if not self.tokenizer.known(text):
            return self.tokenizer.length(text)
        stretches, n = self.tokenizer.stretches(text)
        return n + sum(sum(map(self.__getitem__, self.tokenizer.parts(s))) for s in stretches)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from (t.as_py() for t in batch.column("text") if t.is_valid)


def summary(tokenizer: _Tokenizer, texts: Iterable[str]) -> dict[str, int]:
    """Counts of the pre-tokens with a share of SHARE or more. When the counts are too many, the rarer half goes: that loses no pre-token
    that is frequent all along, and what comes later starts anew."""
    counts, total = Counter(), 0
    for text in texts:
        for stretch in tokenizer.stretches(text)[0]:
            counts.update(tokenizer.parts(stretch))
        if len(counts) > SUMMARY:
            total += sum(counts.values())
            counts = Counter(dict(heapq.nlargest(SUMMARY // 2, counts.items(), key=lambda x: x[1])))
            total -= sum(counts.values())
    total += sum(counts.values())
    return {part: n for part, n in counts.items() if n >= total * SHARE and len(part) <= CACHED_LENGTH}


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The broadcast table: lengths of the most frequent pre-tokens of all documents, TABLE of them at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = summary(_tokenizer(path), _texts(batches))
        yield pa.RecordBatch.from_pydict({"part": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    tops = docs.select("text").mapInArrow(summed, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    found = [r.part for r in tops.orderBy(F.desc("n"), "part").limit(TABLE).collect()]  # a bounded table of short strings
    tokenizer = _tokenizer(path)
    return {part: tokenizer.length(part) for part in found}


def count_tokens(df: DataFrame, vocabulary: str | None = None, frequent: Callable[[DataFrame, str], dict[str, int]] = frequent_lengths) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens."""
    path = vocabulary or default_vocabulary()
    docs = columns_of(df, doc_id="long", text="string")
    table = df.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(_tokenizer(path), table.value)
        for batch in batches:
            n = [lengths.of(t.as_py()) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op13(df: DataFrame) -> DataFrame:
    return count_tokens(df).withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)
