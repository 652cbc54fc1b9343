"""From raw documents to packed sequences: each stage reads what its predecessor kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, language_id, mixing, near_copies, packing, simhash
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.worker import small_batches
from palimpsest.runtime import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; null texts and texts without letters go."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs whose five-word Jaccard similarity is 0.8 or more, the smallest doc_id; by SimHash, and beyond its radius by MinHash."""
    small_batches(spark)
    return simhash.drop_by_component(docs, "doc_id", "text", lambda rows, id: near_copies.near_copies(rows, id, k=5, least=0.8))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids, sequence and offset."""
    small_batches(spark)
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: Models, SimHash and a tokenizer are beyond SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
