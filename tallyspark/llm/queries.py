"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, filteraudit, hostrules, langid, mixing, pagediff, parity, piecetable, pii, puquality, quotes, syncmers, tokencounts
from tallyspark.llm.common import read

TOKENIZER, COUNTED_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(quotes.quoted_threads(read(spark, sf_dir, "conversations")))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(read(spark, sf_dir, "documents"))


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_rules(read(spark, sf_dir, "documents"))


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_components(read(spark, sf_dir, "documents"))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract_pages(read(spark, sf_dir, "pages"))


def op11_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_totals(read(spark, sf_dir, "documents"), tokenizer_path(COUNTED_TOKENIZER))


def op12_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecetable.fim_digests(read(spark, sf_dir, "documents"))


def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking, op2_bpe_transducer, op3_pii_skip_chain_crf, op4_poisson_mixing, op5_pu_quality,
        op6_closed_syncmers, op7_compression_language, op8_host_rules, op9_parity_sketch_join, op10_page_differencing,
        op11_prefix_token_counts, op12_piece_table_fim, op13_filter_diagrams,
    )
}

ORACLES: dict[str, str] = {"op1_quotation_linking": quotes.ORACLE, "op4_poisson_mixing": mixing.ORACLE, "op8_host_rules": hostrules.ORACLE, "op12_piece_table_fim": piecetable.ORACLE, "op13_filter_diagrams": filteraudit.ORACLE}
