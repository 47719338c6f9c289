"""Registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_duckdb,
    conversation_blocks,
    conversation_sql,
    corpus_sql,
    decontaminate,
    feistel_pii,
    html_blocks,
    lang_embed,
    quality_mcd,
    simhash_trie,
    substring_cover,
    suffix_groups,
    token_alignment,
    toxicity_weak,
    unigram_trie,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_trie")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_groups(table(spark, sf_dir, "documents"))


@query("op2_feistel_pii")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymise(table(spark, sf_dir, "documents"), feistel_pii.KEY)


@query("op3_bpe_duckdb")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.round_trip(table(spark, sf_dir, "documents"))


@query("op4_quality_mcd")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.quality(table(spark, sf_dir, "documents"))


@query("op6_decontaminate", corpus_sql.DECONTAMINATION)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_substring_cover", corpus_sql.REPEATED_PASSAGES)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_cover.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op7_toxicity_weak")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_weak.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_html_blocks")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query("op9_unigram_trie")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_trie.token_counts(table(spark, sf_dir, "documents"))


@query("op5_suffix_groups")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_conversation_blocks", conversation_sql.AUDIT)
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversation_blocks.audit(conversation_blocks.damaged(given), given)


@query("op12_token_alignment")
def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


@query("op13_lang_embed")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_embed.languages(table(spark, sf_dir, "documents"))
