"""The corpus pipeline: five stages from raw documents to token ids.

1. ``language``: documents without an identified language go (operator 9).
2. ``exact_dedup``: of documents that are equal but for blanks one stays (operator 7).
3. ``near_dedup``: of each group of near-duplicates one document stays (operator 3;
   five-word shingles, similarity 0.8).
4. ``mixture``: documents are chosen by target weights of domain, language and source
   (operator 8; a document is taken once at most, so no copy comes back).
5. ``tokens``: the text is encoded, and the ids are decoded again (operator 1).

Each stage takes the documents that its predecessor kept and returns rows with all
their columns; the last returns a row of ids per document. Nulls, blank texts, repeated
rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopweave.llm import bpe, budget, exact_dedup, langid, minhash
from shopweave.llm.common import Shared, documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Share of the words that reach the mixture that it passes on.
MIX_BUDGET = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return budget.mix_documents(docs, budget=MIX_BUDGET, max_epochs=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, TOKENIZER)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("tokens", tokens)]

#: Two stages are learned or iterative, so no SQL says what run() returns; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again."""
    docs = documents(spark, sf_dir)
    shared = Shared(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
