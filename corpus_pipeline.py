"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, token ids.

Every stage takes the documents its predecessor kept and returns the columns of documents; the last
returns the encoding of what is left. Each stage's result is written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import bpe_duckdb, decontaminate, feistel_pii, quality_mcd, simhash_trie
from surveyspark.llm.common import free_name, numbered, only, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their group's robust distance go.

    Rows are named by a digest of all that a verdict depends on, and of their id, so no copy of the
    texts is numbered: rows that share a name share the verdict. Null columns count as nulls of their
    own; repeated rows stay or go together; an empty table stays empty.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "lang", "source", "text")]
    name = free_name(docs, "_name")
    named = docs.withColumn(name, F.sha2(F.to_json(F.array(*parts)), 256))
    return only(named, name, quality_mcd.quality(named, id_col=name).where("kept").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: the least by id (null first), then by digest of the text.

    Among rows that are equal in both, any one stays. A null text counts as empty; an empty table stays empty.
    """
    rows, number = numbered(docs)
    groups = simhash_trie.near_copies(rows, id_col=number, numbered=True)
    groups = groups.select(F.col("doc_id").alias(number), "component_id")
    order = F.struct(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.col(number).alias("row"))
    first = rows.select(number, order.alias("order")).join(groups, number).groupBy("component_id").agg(F.min("order").alias("order"))
    return only(rows, number, first.select("order.row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go; a null text holds none, so the row stays."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes format-preserving pseudonyms; `n_chars` follows the text, a null text stays null."""
    changed = feistel_pii.with_pseudonyms(docs, feistel_pii.KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with digests of the ids and of the bytes they decode to.

    A null text has no ids; repeated rows are encoded each on their own."""
    return bpe_duckdb.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages hash, permute and encode beyond what SQL can state; tests hold them against brute force.
ORACLE_SQL = None
