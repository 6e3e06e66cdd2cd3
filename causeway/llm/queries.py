"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, line_dedup, nearest, packing, quality, sentencepiece_bpe, substring_dedup, token_output, toxicity
from .common import scratch, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit_quality(docs, labels))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-shards")
    token_output.write_token_shards(table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return token_output.read_token_shards(spark, path)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.sentencepiece_encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), words=line_dedup.PASSAGE_WORDS).drop("kept_text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_token_output": op3_token_output,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_array": op5_suffix_array,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_jaccard_join": jaccard.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op9_packing": packing.ORACLE_SQL,
    "op10_nearest": nearest.ORACLE_SQL,
}
