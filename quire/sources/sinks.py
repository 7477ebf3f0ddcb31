"""Sinks: documents as JSON, blobs, verified exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.edits import admitted, externalised


def as_json(documents: DataFrame, *, without: tuple[str, ...] = ("revision",)) -> DataFrame:
    """(id, json): each row as a JSON text, without the columns named."""
    return documents.select("id", F.to_json(F.struct(*(c for c in documents.columns if c not in without)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    as_json(documents).select("json").write.mode("overwrite").text(path)


def put_blobs(blobs: DataFrame, path: str, *, batch: int) -> None:
    """Writes blobs (key, content) as a batch of a store; a key written again is replaced, and a batch that is run again is written over."""
    blobs.select("key", "content").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def delete_blobs(keys: DataFrame, path: str, *, batch: int) -> None:
    """Deletes keys from a store, also such as are not there."""
    put_blobs(keys.select("key", F.lit(None).cast("binary").alias("content")), path, batch=batch)


def stored_blobs(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, content) of a store: the last batch of each key, without deleted ones; only the given keys, if any."""
    rows = spark.read.schema("key string, content binary, batch int").option("basePath", path).parquet(path)
    rows = rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")
    last = rows.groupBy("key").agg(F.max_by(F.struct("content"), "batch").alias("c"))
    return last.select("key", "c.content").where("content is not null")


def content_addressed(blobs: DataFrame, *, content: str = "content") -> DataFrame:
    """Each distinct content once, named by its SHA-256."""
    return blobs.withColumn("key", F.sha2(content, 256)).groupBy("key").agg(F.any_value(content).alias(content))


def verified(source: DataFrame, result: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, verified): whether the words of what was written and read again are those of the source, in order."""
    a = source.select(key, X.words(F.col(text)).alias("_a"))
    b = result.select(key, X.words(F.col(text)).alias("_b"))
    return a.join(b, key, "left").select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("verified"))


def export_batch(rendered: DataFrame, sources: DataFrame, path: str, *, batch: int, at: datetime) -> None:
    """Stores a batch of exports with what was verified about them, and meters them: blobs, reports and usage below a path.

    rendered: job, doc, workspace, format, content, text (read back; null if it could not be read); sources: doc, text. A batch
    that is run again is written over, in each of the three, so an export is stored, told and counted once.
    """
    put_blobs(rendered.select(F.concat(F.lit("jobs/"), F.col("job").cast("string"), F.lit("/output")).alias("key"), "content"), f"{path}/blobs", batch=batch)
    read = rendered.where("text is not null").select("job", "doc", F.col("text").alias("_r")).join(sources.select("doc", F.col("text").alias("_s")), "doc")
    checks = verified(read.select("job", F.col("_s").alias("text")), read.select("job", F.col("_r").alias("text")), key="job", text="text")
    report = rendered.select("job", "doc", "format", F.octet_length("content").alias("size")).join(checks, "job", "left")
    report.write.mode("overwrite").parquet(f"{path}/reports/batch={batch}")
    usage = rendered.groupBy("workspace").agg(F.count("*").alias("quantity")).withColumns({"metric": F.lit("exports"), "created_at": F.lit(at)})
    usage.write.mode("overwrite").parquet(f"{path}/usage/batch={batch}")


def created(documents: DataFrame, held: DataFrame, images: DataFrame, limit: Column, *, at: datetime) -> dict[str, DataFrame]:
    """What storing new documents does, as relations: rows, refusals, assets, pictures, first versions and usage.

    documents: doc, workspace, seq, json; held: workspace, n (documents already there); images: doc, place, src. A workspace's
    documents are admitted one after another by its limit; what is refused leaves nothing behind. Inline pictures of those
    admitted become assets, each content once; every one of them starts its history, and is counted.
    """
    asked = documents.withColumn("n", F.lit(1))
    told = admitted(asked, held, workspace="workspace", order=["seq", "doc"], limit=limit).drop("n")
    good = told.where("ok").drop("ok")
    pictures, assets = externalised(images.join(good.select("doc"), "doc", "left_semi"))
    versions = good.select("doc", F.lit(1).alias("number"), F.lit("created").alias("kind"), "json", F.lit(at).alias("created_at"))
    usage = good.groupBy("workspace").agg(F.count("*").alias("quantity")).withColumns({"metric": F.lit("documents_created"), "created_at": F.lit(at)})
    return {"rows": good, "refused": told.where("not ok").select("doc", "workspace"), "assets": assets, "pictures": pictures, "versions": versions, "usage": usage}
