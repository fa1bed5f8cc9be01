"""The dealt operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_neighbour_vote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_prefix_filter_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), least=1)


def op4_bayesian_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import join_classes

    return join_classes(_table(spark, sf_dir, "documents"))


def op5_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_perplexity_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def op8_log_bilinear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_table(spark, sf_dir, "documents"))


def op7_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), 40)


QUERIES = {
    "op1_grouping_genetic_packing": op1_grouping_genetic_packing,
    "op2_neighbour_vote_quality": op2_neighbour_vote_quality,
    "op3_prefix_filter_line_dedup": op3_prefix_filter_line_dedup,
    "op4_bayesian_ngram_join": op4_bayesian_ngram_join,
    "op5_randomness_secret_scan": op5_randomness_secret_scan,
    "op6_perplexity_quality_rules": op6_perplexity_quality_rules,
    "op8_log_bilinear_scoring": op8_log_bilinear_scoring,
    "op7_suffix_array_decontamination": op7_suffix_array_decontamination,
    "op9_seekable_warc": op9_seekable_warc,
    "op10_prefix_sum_shards": op10_prefix_sum_shards,
}

ORACLE_SQL: dict[str, str] = {}
