"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths, the
pieces of one length form a bucket, and every piece is a sequence of its own, so no sequence crosses documents
and none is padded.

Tokens come from an Arrow-batched function that holds one document at a time; nothing is shuffled, so one
source or a very long document costs its own tokens only. ``bucket_report`` counts what each bucket holds.

Defined results: a null or empty text is the end token alone, one piece of length 1; repeated rows are
packed each for itself, in sequences of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of

MAX_TOKENS = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps; beyond that it starts afresh.
CACHE_WORDS = 900_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Words(dict):
    """ids of a word as little-endian bytes. The tokenizer drops white space before anything else, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(word) > 1 and word[-1] in ".,!" and word[:-1].isalpha():  # letters and other signs are separate tokens
            self[word] = out = self[word[:-1]] + self[word[-1]]
            return out
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = b"".join(i.to_bytes(4, "little") for i in ids)
        return out


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_bytes(text: str | None, vocabulary: str, end_id: int = END_ID) -> bytes:
    """The document's ids and the end id, each as four little-endian bytes."""
    known, text = _words(vocabulary), text or ""
    # the tokenizer composes, then lower-cases character by character; done ahead where that is the same, more words are known
    if "<|" not in text and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
        text = text.lower()
    split = text.replace("\n", " ").replace("\t", " ").split(" ")
    return b"".join([known[w] for w in split if w]) + end_id.to_bytes(4, "little")


def binary_lengths(n: int, most: int) -> list[int]:
    """Full pieces of ``most`` (a power of two), then the rest's powers of two, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs: ``doc_id``, ``text``. One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket
    (log2 of the length) and, if asked for, the ids."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data, start = token_bytes(text, path, end_id), 0
                n = len(data) // 4
                for k in binary_lengths(n, max_tokens):
                    piece = data[4 * start : 4 * (start + k)]
                    row = (doc_id, start, k, zlib.crc32(piece), n)
                    rows.append((*row, memoryview(piece).cast("I").tolist()) if with_ids else row)
                    start += k
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": "Int64"})

    pieces = columns_of(docs, doc_id="long", text="string").mapInPandas(cut, schema)
    bucket = F.log2("length").cast("int")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", bucket)


def bucket_report(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each bucket."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"))


def op7(df: DataFrame) -> DataFrame:
    return pack(df).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
