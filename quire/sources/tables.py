"""Scans: Parquet tables, JSON document stores, binary files; columns are pruned and filters pushed down by the reader."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one, but only if all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (found or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder, so that a loop's next round does not run the earlier ones again."""
    path = f"{shared_dir(df.sparkSession)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream's rows with `ts` as an instant (the files carry no zone; they are UTC)."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def json_store(spark: SparkSession, path: str, schema: T.StructType | str, ids: list[str] | None = None) -> DataFrame:
    """Documents of a folder of JSON files, one each; only those ids, if given."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return found if ids is None else found.where(F.col("id").isin(ids))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(key, content, size) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("key"), "content", F.col("length").alias("size"))


def readable_blobs(files: DataFrame, assets: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """The blobs of assets that a user's workspaces own; the others are silently absent."""
    own = assets.join(members.where(F.col("user_id") == user), "workspace_id", "left_semi")
    return files.join(own.select("key"), "key", "left_semi")


def missing_only(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Backfill: rows whose key is not stored yet, each key once."""
    return incoming.join(stored.select(key), key, "left_anti").dropDuplicates([key])
