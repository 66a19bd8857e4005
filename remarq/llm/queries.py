"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..storage import spread
from . import decontaminate, flac, hard_negatives, license_scan, main_text, mixing, packed_ids, quality_rules, simhash, token_counts, toxicity, turn_repair, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For operators that read a table in one pass without a shuffle: a table of fewer files than cores is dealt out to all of them."""
    return spread(_table(spark, sf_dir, name))


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_spread(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_spread(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(_spread(spark, sf_dir, "documents"), _vocabulary(), 512)


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(_table(spark, sf_dir, "documents"), _vocabulary(), end_id=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(_spread(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_spread(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(_table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_main_text": op2_main_text,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_packed_ids": op6_packed_ids,
    "op7_toxicity": op7_toxicity,
    "op8_flac": op8_flac,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_turn_repair": op13_turn_repair,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op4_mixing": mixing.report_sql(),
    "op9_decontaminate": decontaminate.report_sql(),
    "op12_hard_negatives": hard_negatives.report_sql(),
    "op13_turn_repair": turn_repair.report_sql(),
}
