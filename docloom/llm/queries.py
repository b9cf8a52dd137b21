"""The registered queries of the operators: thin calls over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, dialogue, divergence, html_text, lang, media, mixing, sharding, simhash, substrings, token_counts, tokens, toxicity
from docloom.llm.common import session_settings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session_settings(spark)  # the queries are applications over whole texts, so they set this for their session
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang.predict_documents(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_documents(_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(tokens.tokenize_documents(_table(spark, sf_dir, "documents")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe_digest(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digest(_table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_token_ids": op5_token_ids,
    "op6_substrings": op6_substrings,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_html": op10_html,
    "op11_dialogue": op11_dialogue,
    "op12_divergence": op12_divergence,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {"op7_mixing": mixing.MIX_SQL, "op11_dialogue": dialogue.REPAIR_SQL, "op12_divergence": divergence.DIVERGENCE_SQL}
