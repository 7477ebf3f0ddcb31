"""The thirteen queries and the pipeline: each applies its operator to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, importance, learning, lines, mixing, phrases, quality, repeats, secrets, sharding, simhash, toxicity, urls
from .base import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    found, _ = secrets.scan(docs)
    base = tuple(r.kind for r in secrets.BASE)

    def count(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in base), F.sha2(secrets.joined(F.col("findings"), base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    a = F.col(name)
    return out.select("doc_id", a["n_words"].alias("n_words"), a["n_hit"].alias("n_hit"), F.size(a["item_ids"]).cast("long").alias("n_items"), F.sha2(F.array_join(a["item_ids"], ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated(a).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out, name = toxicity.score(docs, model)
    return out.select("doc_id", (learning.fold(F.col("doc_id")) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, texts=False)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out, name = quality.score(docs, model)
    q = F.col(name)
    return out.select("doc_id", (learning.fold(F.col("doc_id")) == 0).alias("held_out"), q["text_score"].alias("text_score"), q["meta_score"].alias("meta_score"), q["score"].alias("score"), (q["score"] >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(table(spark, sf_dir, "documents"))
    m = F.col("mix")
    return out.select(F.col("id").alias("doc_id"), "size", m["source_size"].alias("source_size"), m["target"].alias("target"), m["taken"].alias("taken"), mixing.shard_words(m).alias("shard_words"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_phrases(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = books.digest() if books else codes.EMPTY_DIGEST
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_decontaminate, op3_quality_rules, op4_toxicity, op5_suffix_dedup, op6_sharding, op7_url_filter, op8_quality_classifier, op9_mixing, op10_simhash, op11_phrase_dedup, op12_vector_codes, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in own}
