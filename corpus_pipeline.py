"""The corpus pipeline over ``documents``: each stage's rows are written and read again by the next.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables (no rows
come out) and further columns, whose values stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontaminate, lang_id, mix, near_dup, shard, sql
from sitelens.llm.common import materialise, table
from sitelens.llm.queries import WEIGHTS, levels


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose text is in one of the labelled languages; what is too far from all of them goes,
    and so does text without letters, or null. A null language becomes the predicted one."""
    profiles, least = lang_id.fit_known(docs.where(~lang_id.held_out()))
    found = lang_id.identify(docs, profiles, into="__language").where(lang_id.known(F.col("__language"), least))
    return found.withColumn("lang", F.coalesce("lang", "__language.lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, with all rows that repeat it.
    Rows without words or without an id stay."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which benchmark windows cover a word in twenty or more. Text without words stays."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to the target weights, each document once at most. A null language or source is one of its own;
    text without words costs nothing, and rows that repeat an id are taken or left together."""
    return mix.mix(docs, levels(), WEIGHTS, share=0.8, epochs=1, into="__mixed").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes; the documents' columns, with size, shard and slot. No row is left out;
    null text counts one byte, and columns named size, shard or slot are replaced."""
    placed = shard.shard(docs, shards=16, into="__placed")
    added = ("size", "shard", "slot")
    return placed.select(*(c for c in docs.columns if c not in added), *(f"__placed.{c}" for c in added))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]
#: SQL cannot state the profiles: it holds where each text with a letter is in a labelled language, as in the given tables.
ORACLE_SQL = sql.PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
