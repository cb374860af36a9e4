"""The corpus pipeline: stages that each work on what the one before has kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
one's docs. All stages but the last return the columns of documents, and carry others along as they
are, whatever their names. Texts of any length are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coursemill.llm import cotraining, jaccard, line_dedup, mixing, pieces
from coursemill.session import own_writes, release, release_paths, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. Null columns are values like others, repeated rows and rows of equal score go or stay together; without usable labels all stay. An empty table gives no rows."""
    return cotraining.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more stay in the one with the largest doc_id. A null text becomes an empty one, rows of one doc_id count as one document, so that its repeated rows lose or keep a line together, rows without an id as one more. An empty table gives no rows."""
    return line_dedup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: all rows of its smallest doc_id, which decides ties. Rows without an id or words stay. An empty table gives no rows."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is a source, repeated rows are separate documents, of which one or another is taken more often; sources without words are left out. An empty table gives no rows."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of each, as digests. A null text is an empty one, repeated rows are encoded each for itself; an empty table gives no rows."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources", mixture), ("piece codec", encoding)]
#: The classifier and the codec have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written on its way goes when its result is written, and that once the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with own_writes() as paths:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = stash(docs, f"stage{k + 1}")
        if k + 1 < len(STAGES):
            release_paths(spark, paths, docs)
            if before is not None:
                release(before)
            before = docs
    return docs
