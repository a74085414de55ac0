"""From raw documents to token ids, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it back.

Defined results: each stage states its own; a null or empty text fails the quality rules and goes; of copies and near copies one
stays; a null id or source counts as the empty one; a very long text is one row of each stage; columns besides those of ``documents``
are carried to the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, hostrules, mixing, parity, pii
from tallyspark.llm.common import checkpoint_dir, read
from tallyspark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return hostrules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return parity.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources meet their target weights."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and decoded text, one row for each copy."""
    return bpe.encoded_with_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Components and token ids have no SQL form; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
