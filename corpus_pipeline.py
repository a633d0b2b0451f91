"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's docs; a stage's own tables then go.

Language identification drops documents without a recognisable language, SimHash
keeps one document of each group of near-duplicates, suffix-array dedup cuts strings
that repeat, temperature mixing places each document as often as its source's weight
asks, and best-fit packing puts them into sequences.

Null and empty texts have no language and go first; rows that repeat an id count each
for itself; further columns of the documents come along unchanged, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, packing, scratch, simhash, suffix


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from every row that has one."""
    return langid.identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar texts (five-word shingles, similarity of about 0.8 or more)."""
    return simhash.first_of_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that an earlier document has; texts left empty go."""
    return suffix.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, once at least."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no XXH64, trained classifier or tokenizer; tests/llm/test_pipeline.py checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.alone(partial(stage, spark, docs, sf_dir), name)
        if last is not None:
            scratch.remove(last)
        last = docs
        scratch.release(spark)
    return docs
