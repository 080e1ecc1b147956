"""A training corpus from raw documents, in five stages that each call one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import exact_dedup, mixing, packing, quality_model, simhash
from ripplegraph.llm.common import read, written

#: Workers that ran the other stages have less memory to spare for words than packing alone.
TOKENIZER, REMEMBERED = "word_bpe_49k.json", 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality_model.accepted(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, keeps the row with the smallest doc_id of each group."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents, in part or more than once, up to its target."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into windows of one mixture."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("source mixing", mix), ("packing", pack)]

#: The classifier, the fingerprints and the tokenizer have no SQL form: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
