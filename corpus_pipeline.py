"""Corpus pipeline: named stages, each written as Parquet and read again by the next.

The texts that reach the end passed the quality rules, are the first of their group of
near copies, hold no benchmark passage worth mention, and fill the target mixture; the
last stage deals them to shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from weftlink.llm.text import small_side
from weftlink.session import ready, removed, scratch_path

#: Places of removed copies up to this number are broadcast, 16 bytes each.
BROADCAST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go (see ``quality_rules.kept_documents``).

    Null, empty and very short texts break one; very long texts are measured whole; repeated
    rows are judged alike. All columns stay, whatever their names.
    """
    ready(spark)
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, ids before null ones.

    Five-word n-grams, Jaccard similarity of 0.8 or more. Rows are told apart by their
    place in the written table that ``docs`` is, so repeated and null ids do not matter.
    Of equal ids the first row stays. Texts without words are copies of nothing.
    """
    ready(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.monotonically_increasing_id().alias("place"))
    at = {c: i for i, c in enumerate(docs.columns)}
    own = F.col("row")[f"c{at['doc_id']}"]
    keyed = rows.select(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("place")).alias("key"), F.col("row")[f"c{at['text']}"].alias("text"))
    found = ngram_join.linked_documents(keyed, key="key")
    copies = small_side(found.where("doc_id.place <> component_id.place").select("doc_id.place"), BROADCAST_IDS)
    left = rows.join(copies, "place", "left_anti")
    return left.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in 5 % of their words or more go (see ``decontaminate.scan``).

    Null and empty texts stay, as do all where the benchmark is empty; repeated rows are
    judged alike. All columns stay, whatever their names.
    """
    return decontaminate.clean_documents(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by target weights; no document twice (see ``mixing.mix``).

    Half is what the mixture asks for: with all tokens there would be nothing to choose. Null
    languages and sources are branches of their own; texts without words are taken with the
    prefix that they fall in. All columns stay, whatever their names.
    """
    ready(spark)
    return mixing.mix(docs, mixing.LEVELS, mixing.HALF, added=("_epoch",)).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in one of eight shards (see ``sharding.shard``).

    The slot map is kept for the tables at ``sf_dir`` and edited when their bytes shift.
    """
    ready(spark)
    return sharding.shard(docs, store=sharding.map_store(spark, f"pipeline of {sf_dir}"))[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("target_mixture", mixed),
    ("sharding", shards),
]
#: The mixture's seeded order and the CRC are not SQL that DuckDB knows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the result of each is written to the shared folder and read again.

    A stage's folder goes as soon as the next one is written; the last goes with the application.
    """
    docs, before = ready(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if before:
            removed(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
