"""A training corpus in five stages: quality rules, exact dedup, near dedup, mixing, encoding.

Every stage works on all that its predecessor kept, and its decisions take effect. All but the last return the columns
of documents; the last returns doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bagminhash import drop_near_copies
from tidemark.llm.common import table, written
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.piece_codec import encode_documents
from tidemark.llm.quality import quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null, empty and blank texts among them. Labels give the trusted target; counts
    are over all of docs. Repeated rows go or stay together; an empty table stays empty; other columns pass through.

    The verdicts are written before they filter: pushed into the scan, the filter would repeat what they are made of.
    """
    verdict = "verdict"
    while verdict in map(str.lower, docs.columns):
        verdict += "_"
    decided = written(quality(docs, table(spark, sf_dir, "labels"), out=verdict), "decided")
    return decided.filter(f"{verdict}.kept").drop(verdict)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null text counting as empty and a null id losing; of rows equal in
    both one stays. An empty table stays empty; other columns pass through."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays, null ids last. Null counts as empty; texts without
    words are near only their equals. An empty table stays empty; other columns pass through."""
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: rows repeat up to three times or go; rows without a word go. A null source is a
    source. An empty table stays empty; other columns pass through."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row of the mix, as digests: doc_id, source, n_tokens, ids_sha256, decoded_sha256. A null text has the
    begin and end ids only; repeated rows get equal results; an empty table gives none."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source"], with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Hashed scores, signatures and piece ids are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
