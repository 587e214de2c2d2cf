"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelsmith.llm.alignment import align_documents
from panelsmith.llm.common import table
from panelsmith.llm.fingerprints import fingerprint_documents
from panelsmith.llm.html import extract_pages
from panelsmith.llm.language import identify_documents
from panelsmith.llm.licenses import license_labels
from panelsmith.llm.mixing import mix_documents
from panelsmith.llm.packing import pack_documents
from panelsmith.llm.periods import run_digests
from panelsmith.llm.sharding import shard_documents
from panelsmith.llm.simhash import simhash_components
from panelsmith.llm.tokens import public_tokenizer, token_documents
from panelsmith.llm.toxicity import score_documents
from panelsmith.llm.vectors import near_vectors


def op1_html_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_stable_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)


def op4_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_language_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), bits=2, words_per_shingle=3)


def op9_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=1)


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def op12_suffix_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


def op13_grid_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_block_labeller,
        op2_rendezvous_sharding,
        op3_token_files,
        op4_toxicity_boosted_trees,
        op5_minhash_fingerprints,
        op6_language_output_codes,
        op7_stable_hash_vectors,
        op8_simhash_pigeonring,
        op9_differencing_packing,
        op10_pivotal_mixing,
        op11_license_templates,
        op12_suffix_alignment,
        op13_grid_periods,
    )
}
# no SQL has these operators' hashes, models, tokenizers or random rounding: tests hold them against brute force
ORACLE_SQL: dict[str, str] = {}
