"""A training-data pipeline: toxic documents go, near-duplicates and contaminated documents go, the rest is mixed and sharded.

All stages read whole texts of any length, pass columns of any other name through unchanged, and turn an empty table into
an empty one. What each does with nulls, empty texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, sharding, simhash, toxicity
from quire.llm.base import new_path, quoted, table

def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it is trained on the labelled ones among them.

    Null and empty texts get the score of a text without features, and a tie at 0.5 goes; repeated rows score alike. With labels
    of one kind only, every text scores that kind's smoothed share; without labels all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out, name = toxicity.score(docs, model)
    return out.where(F.col(name) < 0.5).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one whose id is the group's; of rows that share that id one stays.

    Null, empty and blank texts have the fingerprint 0 and are one group; a group of null ids only keeps one row. Repeated
    rows and rows of one id are ties, of which the one with the least content hash stays.
    """
    return simhash.one_of_each(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    out, name = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~decontaminate.contaminated(F.col(name))).drop(name)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every whole pass over a document, and one for its words before the border, where that falls into it; n_chars is the row's own.

    Null, empty and blank texts have no words and no place in the mix; null sources are one source. Repeated rows give alike.
    """
    plan = mixing.plan_mix(mixing.measured(docs))
    out = mixing.mixed_texts(docs, plan)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; null texts count as empty, rows of equal text share a shard, repeated rows have slots of their own."""
    out = sharding.shard(docs)
    return out.select(*(quoted(c) for c in docs.columns), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", contamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No stage can be put in SQL that DuckDB runs: a trained model, a hash it lacks, links along chains. The tests compare each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again.

    Nulls, empty texts, ties and repeated rows are what each stage says; an empty table gives an empty result with the
    columns of documents, shard and slot; further columns pass through under their names; texts of any length stay whole.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
