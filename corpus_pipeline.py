"""From raw documents to token ids: quality, near duplicates, repeated passages, source mix, tokens.

Every stage takes the rows that its predecessor kept and returns the columns of
``documents`` (the last one: token ids). ``run`` writes each stage's rows to the
shared folder and reads them back, so a lost executor costs one stage at most.

Nulls: a null text is judged as the empty one; rows with a null doc_id pass the
near-duplicate stage unchanged. Of rows with one doc_id, one leaves that stage; of
equal documents the least id stays. Documents without a word take nothing of the mix,
so they leave there. Texts are taken whole, in memory linear in the longest. Extra
columns are carried to the last stage, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import byte_bpe, mixing, near_sets, quality_qda, suffix_dedup
from threadloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_qda.keep(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: five-word shingles, similarity 0.8, every link verified."""
    return near_sets.keep_first(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere too; documents left without a word go."""
    return suffix_dedup.strip(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.take(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.round_trip(docs, path), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier's fit and a tokenizer's merges are not SQL.
ORACLE_SQL = None
