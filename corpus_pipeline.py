"""A training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

Documents that the quality classifier rejects go; one document of each group of near duplicates stays; documents that
hold a benchmark item go; personal data is replaced by surrogates; what is left is encoded, and decoded again as a proof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import decontamination, pii, quality, sentencepiece, simhash
from studylake.llm.common import Scratch, table
from studylake.llm.queries import PII_KEY, quality_model

#: Not expressible in SQL: a trained model, SimHash groups and keyed surrogates.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. Rows with a null text are scored as empty."""
    model = quality_model(spark, sf_dir)
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of five-word similarity 0.8 or more to a benchmark item."""
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8)
    return decontamination.drop_contaminated(docs, found)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text."""
    return pii.replace_pii(docs, key=PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    encoded = sentencepiece.encode(docs.withColumn("digest", digest), carry=("lang", "source", "digest"), decoded=True)
    n = F.size("piece_ids").cast("long").alias("n_pieces")
    return encoded.select(F.col("id").alias("doc_id"), "text", "lang", "source", "piece_ids", n, (F.sha2("text", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_pii),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
