"""Usage totals by month, plan limits and fixed-window rate limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MB = 1024 * 1024
ENTITLED = ("active", "trialing", "past_due")
#: The plans' limits; null is unlimited.
PLANS = (
    ("free", 25, 100, 5, 250, 10, True, True, False),
    ("pro", 500, 2000, 100, 5120, 50, True, True, False),
    ("business", None, 10000, None, 51200, 100, True, True, True),
)
PLAN_SCHEMA = "plan string, max_documents int, max_ai_operations int, max_templates int, max_storage_mb int, max_document_size_mb int, can_export_docx boolean, can_export_pdf boolean, priority boolean"
#: Scopes and their rates.
RATES = {
    "global": "600/minute", "login": "20/minute", "login_account": "10/minute", "register": "10/hour", "password_reset": "10/hour",
    "password_reset_account": "3/hour", "account_link": "20/hour", "verify_email": "5/hour", "ai": "20/minute", "upload": "20/minute", "export": "30/minute",
}
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLANS), PLAN_SCHEMA)


def month_start(at: Column) -> Column:
    return F.date_trunc("month", at)


def month_end(at: Column) -> Column:
    return F.add_months(month_start(at), 1).cast("timestamp")


def usage_rows(events: DataFrame, *, ok: Column | None = None) -> DataFrame:
    """Events stamped with the UTC month they count in; calls that failed are left out."""
    kept = events if ok is None else events.where(ok)
    return kept.withColumns({"period_start": month_start(F.col("ts")), "period_end": month_end(F.col("ts"))})


def usage_summary(events: DataFrame, *, workspace: str, metric: str, quantity: str, at: Column, fields: Mapping[str, str]) -> DataFrame:
    """One row a workspace: the month's sum of each metric named in fields (metric to column), 0 where there is none."""
    month = events.where((F.col("ts") >= month_start(at)) & (F.col("ts") < month_end(at)))
    wide = month.groupBy(workspace).pivot(metric, list(fields)).agg(F.sum(quantity))
    return wide.select(workspace, *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("long").alias(c) for m, c in fields.items()))


def storage_bytes(documents: DataFrame, assets: DataFrame, *, workspace: str, text: str, size: str) -> DataFrame:
    """Characters of the documents plus bytes of the assets, by workspace."""
    a = documents.groupBy(workspace).agg(F.sum(F.length(text)).alias("chars"))
    b = assets.groupBy(workspace).agg(F.sum(size).alias("bytes"))
    return a.join(b, workspace, "full").select(workspace, (F.coalesce("chars", F.lit(0)) + F.coalesce("bytes", F.lit(0))).cast("long").alias("storage"))


def effective_plan(subscriptions: DataFrame, known: tuple[str, ...] = tuple(p[0] for p in PLANS)) -> DataFrame:
    """The subscription's plan while its status entitles to it and the plan is known, else free."""
    good = F.col("status").isin(*ENTITLED) & F.col("plan").isin(*known)
    return subscriptions.withColumn("plan", F.when(good, F.col("plan")).otherwise("free"))


def remaining(limit: Column, used: Column) -> Column:
    """What is left of a limit, never below 0; null where there is no limit."""
    return F.when(limit.isNotNull(), F.greatest(F.lit(0).cast("long"), limit.cast("long") - used.cast("long")))


def refused_count(limit: Column, used: Column) -> Column:
    """Whether one more would pass the limit."""
    return F.coalesce(used >= limit, F.lit(False))


def refused_storage(limit_mb: Column, used: Column, adding: Column) -> Column:
    return F.coalesce(used + adding > limit_mb.cast("long") * MB, F.lit(False))


def used_mb(used: Column) -> Column:
    return F.ceil(used / MB).cast("long")


def capped_upload_mb(plan_mb: Column, ceiling_mb: int) -> Column:
    return F.least(plan_mb, F.lit(ceiling_mb))


def rate_of(text: Column) -> Column:
    """struct(limit, seconds) of "20/minute"; null for no limit or a text that is none."""
    count, unit = F.trim(F.split_part(text, F.lit("/"), F.lit(1))), F.regexp_replace(F.trim(F.split_part(text, F.lit("/"), F.lit(2))), "s+$", "")
    seconds = F.element_at(F.create_map(*(F.lit(x) for kv in UNIT_SECONDS.items() for x in kv)), unit)
    n = F.when(count.rlike("^[0-9]+$"), count.cast("int"))
    return F.when((n > 0) & seconds.isNotNull(), F.struct(n.alias("limit"), seconds.alias("seconds")))


def fixed_window(ts: Column, seconds: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1_000_000 / seconds).cast("long")


def rate_limit(hits: DataFrame, *, key: list[str], order: list[str], limit: Column, seconds: Column) -> DataFrame:
    """hits with window, nth, refused and retry_after (seconds left in the window, 1 at least, where refused)."""
    out = hits.withColumns({"window": fixed_window(F.col("ts"), seconds)})
    out = out.withColumn("nth", F.row_number().over(W.partitionBy(*key, "window").orderBy("ts", *order)))
    left = F.greatest(F.lit(1), F.ceil((F.col("window") + 1) * seconds - F.unix_micros("ts") / 1_000_000)).cast("int")
    out = out.withColumn("refused", F.coalesce(F.col("nth") > limit, F.lit(False)))
    return out.withColumn("retry_after", F.when(F.col("refused"), left))


def scope_rates(spark: SparkSession, rates: Mapping[str, str] = RATES) -> DataFrame:
    named = spark.createDataFrame(sorted(rates.items()), "scope string, rate string")
    return named.withColumn("r", rate_of(F.col("rate"))).select("scope", "rate", F.col("r.limit").alias("limit"), F.col("r.seconds").alias("seconds"))


def within_budget(calls: DataFrame, *, job: str, order: list[str], most: int, seconds: float) -> DataFrame:
    """Calls that a job may make: the first `most` of it, started within `seconds` of its first."""
    w = W.partitionBy(job).orderBy(*order)
    ranked = calls.withColumns({"nth": F.row_number().over(w), "begun": F.min("ts").over(W.partitionBy(job))})
    late = (F.unix_micros("ts") - F.unix_micros("begun")) / 1_000_000
    return ranked.withColumn("allowed", (F.col("nth") <= most) & (late <= seconds)).drop("begun")


def current_subscriptions(events: DataFrame, *, workspace: str, subscription: str, status: str, order: list[str]) -> DataFrame:
    """(workspace, subscription, status): what holds after events in any order of arrival, repeated ones too.

    The latest news of each subscription counts; of a workspace's subscriptions the entitled one with the latest news
    holds, so news about one that was replaced and is not entitled changes nothing; where none is, the latest.
    """
    at = F.struct(*order)
    last = events.groupBy(workspace, subscription).agg(F.max(F.struct(at.alias("at"), F.col(status).alias("s"))).alias("e"))
    rank = F.struct(F.col("e.s").isin(*ENTITLED).alias("good"), "e.at", F.col(subscription))
    return last.groupBy(workspace).agg(F.max_by(F.struct(F.col(subscription), F.col("e.s").alias(status)), rank).alias("k")).select(workspace, f"k.{subscription}", f"k.{status}")


def document_counts(documents: DataFrame, *, workspace: str) -> DataFrame:
    """(workspace, documents)."""
    return documents.groupBy(workspace).agg(F.count("*").alias("documents"))
