"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. language ID: documents whose language cannot be told, or only with a low score, go.
2. exact dedup: of texts that are equal without white space one row stays.
3. n-gram Jaccard join: of each group of near-duplicates the document of the smallest id stays.
4. mixing: every document is taken as often as its source's target weight asks for (0 to 2 times).
5. SentencePiece: every row that is left is encoded; the last stage returns doc_id, source, lang and the tokens.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_codec
from quern.llm.common import documents, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select(F.struct("doc_id", "source", "lang").alias("doc"), "text")
    return sentencepiece_codec.encode(packed, id_col="doc").select("doc_id.*", "ids", "n_tokens", "n_byte_tokens", "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", tokenize),
]

#: Language identification is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what is between them lies in the shared checkpoint folder."""
    docs = documents(spark, sf_dir)
    where = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return docs
