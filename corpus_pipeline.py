"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelsmith.llm.common import table, written
from panelsmith.llm.language import UNDETERMINED, identify, in_fold, learn
from panelsmith.llm.mixing import take_copies
from panelsmith.llm.packing import pack_documents
from panelsmith.llm.simhash import keep_one
from panelsmith.llm.tokens import public_tokenizer
from panelsmith.llm.toxicity import labelled, toxicity
from panelsmith.llm.toxicity import learn as learn_toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text (null or empty) or without a letter go.

    Repeated rows and null doc_ids stay as they are; an empty table, or one without any lang, gives no rows.
    """
    model = learn(docs.select("doc_id", "text", "lang").where(~in_fold("doc_id", 4, 2)))
    return identify(docs, model).where(f"lang_pred <> '{UNDETERMINED}'").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, from their whole texts (null: empty).

    Repeated rows are judged alike and all stay or go; without labels none goes; an empty table gives no rows.
    """
    model = learn_toxicity(labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id.

    Links: 3-word fingerprints at most 2 bits apart, or a five-word similarity of 0.8 or more at any distance. Null texts
    count as empty; rows of one doc_id and unlike texts are documents of their own; an empty table gives no rows.
    """
    return keep_one(docs, sure_bits=2, set_words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words (or text) are not taken.

    A null source is a source; equal rows share their copies; an empty table gives no rows.
    """
    return take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences: null texts are empty, every row is a document of its own, an empty table gives no rows."""
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
ORACLE_SQL = None  # SQL has no tokenizer and no classifier: tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
