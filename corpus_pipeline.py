"""Corpus pipeline: documents to token ids in five stages.

Each stage works on all that the one before kept, and its result is written and read again. All but the
last return the columns of their input, whatever those are called. Null texts count as empty; texts of any length are read
whole; rows with a null doc_id are kept or dropped like others; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracesift.llm import decontaminate, exact_dedup, language_id, queries, sentencepiece_codec, simhash
from tracesift.llm.support import store, table
from tracesift.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null, or no letter) go.

    Repeated rows share their verdict; with no labelled row to learn from, every document goes.
    """
    ship_package(spark)
    model = language_id.fit_language_id(docs.filter(~language_id.held_out()))
    return language_id.drop_unidentified(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    All empty and null texts are equal; a null id is smaller than any other; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays.

    Texts without a word share the fingerprint zero; a null id gives way to any other; of repeated rows one stays.
    """
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2, seed=42)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and wordless items match nothing; repeated rows share their verdict; an empty benchmark keeps all.
    """
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text back.

    Null and empty texts have no token; repeated rows and null ids stay.
    """
    ship_package(spark)
    return sentencepiece_codec.encode_and_decode(docs, queries.tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("simhash_neardup", drop_near),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", tokenize),
]

#: No stage but the second can be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
