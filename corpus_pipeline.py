"""A corpus pipeline of five operators, each stage written and reread as the next one's documents.

Rows are judged one by one, whatever their ids: a repeated or null id is no error,
and rows of one id with different texts are different documents. Null texts count
as empty ones and stay null. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracetide.llm import decontaminate, packing, queries, simhash, suffixes, toxicity
from tracetide.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learnt from the labelled rows scores under 0.3. Without labels nothing is learnt; all stay or go as one."""
    return toxicity.reject(docs, queries.toxicity_lexicon(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row with the smallest id, null last; ties go by a hash of id and text. Texts without words are one group."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte windows that occur earlier in the corpus. Every row stays, with an empty text where all of it occurs earlier."""
    return suffixes.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lies in benchmark windows; documents without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; every row, the empty ones too, has its end token in one."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("simhash", one_of_each_group), ("suffixes", without_repeats), ("decontamination", without_benchmark), ("packing", packed)]

#: Stages that SQL cannot express (a learnt lexicon, hashing, tokens); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
