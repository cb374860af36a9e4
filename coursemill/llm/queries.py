"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coursemill.llm import collocations, cotraining, fill_middle, gif, jaccard, line_dedup, mixing, neardup, pieces, pseudonyms, rabitq, records, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key; without one, with that of the published test data, so that reruns agree."""
    key = pseudonyms.key_from(spark.conf.get(pseudonyms.KEY_SETTING, "key of the test data, which are invented"))
    return pseudonyms.pseudonymize_documents(table(spark, sf_dir, "documents"), key)


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(table(spark, sf_dir, "embeddings"))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(table(spark, sf_dir, "documents"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_feistel_pseudonyms, op2_one_bit_codes, op3_systematic_mix, op4_piece_codec, op5_binary_records,
            op6_gif_media, op7_line_runs, op8_jaccard_join, op9_cotrained_quality, op10_ring_shards,
            op11_fill_middle, op12_near_vectors, op13_collocations,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_one_bit_codes": rabitq.ORACLE, "op3_systematic_mix": mixing.ORACLE, "op7_line_runs": line_dedup.ORACLE, "op8_jaccard_join": jaccard.ORACLE,
        "op11_fill_middle": fill_middle.ORACLE, "op12_near_vectors": neardup.ORACLE, "op13_collocations": collocations.ORACLE,
    }
