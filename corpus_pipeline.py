"""A corpus from raw documents to token ids: each stage calls one operator of ``kestrel.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import bpe, dedup, mixing, quality, simhash
from kestrel.llm.catalog import token_digests
from kestrel.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on this stage's own input, scores 0.3 or more."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest doc_id."""
    return dedup.drop_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints (3-word shingles) that link at 2 bits, the document with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, width=3, seed=42, limit=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 150 % of all words, sources weighing 3, 1, 2 in turn."""
    return mixing.mixed_documents(docs, [3, 1, 2], share=1.5, most=2.0)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: the number and digest of its token ids, and the digest of their text."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_digests(bpe.encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing", mix_sources),
    ("BPE", bpe_round_trip),
]

#: SQL has no classifier, no XXH64 and no BPE; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
