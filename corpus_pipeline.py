"""From raw documents to packed sequences, in five stages.

1. Quality rules: documents that the rules reject go.
2. N-gram Jaccard join: of each group of near copies the document with the
   least doc_id stays.
3. Suffix-array dedup: passages of 50 bytes or more that an earlier document
   has are cut; a document of which nothing is left goes.
4. Secret scans: secrets are replaced by a mark.
5. Best-fit packing: the documents as token sequences of at most 4096.

Stages 3 and 4 rewrite `text`, and n_chars with it; all but the last return the
columns of documents. Each stage works on all that the one before has kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from ledgermill.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.without_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as text has them now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs


#: A trained network, LSH and suffix arrays have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
