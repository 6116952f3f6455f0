"""Documents through language ID, near-duplicate removal, PII masking, mixing and BPE, each stage a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, langid, mixing, ngram_join, pii
from tidemark.llm.tables import discard, stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language likelier than all others together, go."""
    return langid.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id."""
    return ngram_join.keep_one_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked, and n_chars counted anew."""
    return pii.mask_and_count(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_join_stage),
    ("pii", pii_stage),
    ("source_mix", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Language models, transducers and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table is written in the shared folder; it goes once the next one's is whole."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
