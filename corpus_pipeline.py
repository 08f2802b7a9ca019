"""The corpus pipeline: toxic documents go, then documents of low quality, then near duplicates but one of each group; the rest is
mixed to target weights and packed. Each stage takes the documents that the one before it kept, as written.

Defined results: null and empty texts are scored like others and, if kept, are never near copies, are never drawn by the mix; rows without a doc_id
stay until the mix; repeated rows count as exact copies, one of them stays; two texts of one id are two documents; ties are broken by id and hash; an
empty table passes through as one; columns other than those of ``documents`` are left out, whatever their names, and one that is missing counts as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import mixing, ngram_join, packing, quality_pu, toxicity
from terrace.llm.common import columns_of, materialize

TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = list(TYPES)
#: Five-word shingles at 0.8: what the stages that work on near duplicates take.
SHINGLE_WORDS, PERCENT = 5, 80
#: Documents that score below are rejected: well under even odds, since a clean document lost costs more than a poor one kept.
LEAST_QUALITY = 0.3

ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, by exact name first; null where there is none."""
    return columns_of(docs, **TYPES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(_documents(docs), _labels(spark, sf_dir), COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep_good(_documents(docs), _labels(spark, sf_dir), COLUMNS, LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest doc_id. Texts that share an id are told apart."""
    return ngram_join.one_of_each(_documents(docs), COLUMNS, SHINGLE_WORDS, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(docs), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op7(_documents(docs))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("n-gram Jaccard join", drop_copies), ("mixing sources to target weights", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
