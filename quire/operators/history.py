"""Bounded version history: anchored burst merge, undo and redo, trimming, assets no version needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .folds import ordered_fold

BURST_SECONDS = 60
DEPTH = 50
STEP = "step long, kind string, started timestamp, ended timestamp, saves long, last_save string"


class Bursts:
    """A content save joins the step at the tip if that is a content step begun less than `seconds` before."""

    def __init__(self, key: tuple, seconds: float):
        self.key, self.seconds, self.number, self.open = key, seconds, 0, None

    def step(self, row: dict) -> list[tuple]:
        kind, ts, payload = row["kind"], row["ts"], row["payload"]
        if self.open and kind == "content" == self.open[1] and (ts - self.open[2]).total_seconds() < self.seconds:
            self.open[3:] = [ts, self.open[4] + 1, payload]
            return []
        done = self.end()
        self.number += 1
        self.open = [self.number, kind, ts, ts, 1, payload]
        return done

    def end(self) -> list[tuple]:
        done = [(*self.key, *self.open)] if self.open else []
        self.open = None
        return done


def burst_steps(saves: DataFrame, *, doc: str, order: list[str], seconds: float = BURST_SECONDS) -> DataFrame:
    """Steps of every document's history from its saves (kind, ts, payload): (doc, step, kind, started, ended, saves, last_save)."""
    kind = saves.schema[doc].dataType.simpleString()
    return ordered_fold(saves, [doc], ["ts", *order], f"{doc} {kind}, {STEP}", lambda key: Bursts(key, seconds))


def trimmed(versions: DataFrame, *, doc: str, number: str, depth: int = DEPTH) -> DataFrame:
    """The last `depth` versions of a document and its first one."""
    last = F.max(number).over(W.partitionBy(doc))
    return versions.withColumn("_last", last).where((F.col("_last") - F.col(number) < depth) | (F.col(number) == 1)).drop("_last")


def neighbours(versions: DataFrame, *, doc: str, number: str) -> DataFrame:
    """versions with can_undo and can_redo: whether the numbers before and after exist."""
    w = W.partitionBy(doc).orderBy(number)
    return versions.withColumns({
        "can_undo": F.coalesce(F.lag(number).over(w) == F.col(number) - 1, F.lit(False)),
        "can_redo": F.coalesce(F.lead(number).over(w) == F.col(number) + 1, F.lit(False)),
    })


def at_version(versions: DataFrame, wanted: DataFrame, *, doc: str, number: str) -> DataFrame:
    """The state that each (document, number) of wanted asks for; numbers that do not exist give nothing."""
    return versions.join(wanted.select(doc, number), [doc, number])


def has_newer(versions: DataFrame, current: DataFrame, *, doc: str, number: str, pointer: str) -> DataFrame:
    """Documents whose pointer is below their last version."""
    last = versions.groupBy(doc).agg(F.max(number).alias("_last"))
    return current.join(last, doc).where(F.col("_last") > F.col(pointer)).drop("_last")


def without_redo_tail(versions: DataFrame, current: DataFrame, *, doc: str, number: str, pointer: str) -> DataFrame:
    """What a new change leaves: the versions up to the pointer."""
    return versions.join(current.select(doc, pointer), doc).where(F.col(number) <= F.col(pointer)).drop(pointer)


def listing(versions: DataFrame, users: DataFrame, *, author: str, user: str, name: str, email: str) -> DataFrame:
    """versions with the author's full name, else address; null for authors that are gone."""
    named = users.select(F.col(user).alias("_user"), F.coalesce(name, email).alias("author_name"))
    return versions.join(named, F.col(author) == F.col("_user"), "left").drop("_user")


def unused_assets(assets: DataFrame, texts: DataFrame, *, asset: str, created: str, text: str, pattern: str, as_of: Column, days: int = 1) -> DataFrame:
    """Assets older than the grace whose id no text names. Ids are found by pattern in the lower-cased texts."""
    named = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("_id")).distinct()
    old = assets.where(F.col(created) < as_of - F.make_dt_interval(F.lit(days)))
    return old.join(named, F.lower(F.col(asset).cast("string")) == F.col("_id"), "left_anti")


def expired(rows: DataFrame, *, finished: str, as_of: Column, hours: int) -> DataFrame:
    return rows.where(F.col(finished) < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def latest_state(changes: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key: one struct compared in order."""
    rest = [c for c in changes.columns if c not in key]
    best = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return best.select(*key, "s.*")


def merge_revision(stored: DataFrame, writes: DataFrame, *, key: str) -> DataFrame:
    """stored after one write each: applied, with revision + 1, where the expected revision is the stored one; others are refused."""
    w = writes.select(key, F.col("expected").alias("_expected"), F.col("payload").alias("_payload"))
    hit = F.col("_expected") == F.col("revision")
    out = stored.join(w, key, "left")
    return out.select(key, (F.col("revision") + F.when(hit, 1).otherwise(0)).alias("revision"), F.when(hit, F.col("_payload")).otherwise(F.col("payload")).alias("payload"), F.coalesce(~hit, F.lit(False)).alias("refused"))


def job_states(events: DataFrame, *, job: str, status: str, order: list[str], progress: str) -> DataFrame:
    """(job, state, attempts, progress) from a job's events in any order of arrival.

    A job is pending until it runs, runs until it first succeeds or fails, and then stays as it is; attempts are the runs
    until then, progress the furthest told until then.
    """
    at, s = F.struct(*order), F.col(status)
    over = events.groupBy(job).agg(F.min(F.when(s.isin("succeeded", "failed"), F.struct(at.alias("at"), s.alias("s")))).alias("_end"))
    seen = events.join(over, job).where(F.col("_end").isNull() | (at <= F.col("_end.at")))
    out = seen.groupBy(job).agg(F.first("_end.s", ignorenulls=True).alias("_e"), F.count_if(s == "running").alias("attempts"), F.max(progress).alias("progress"))
    state = F.coalesce("_e", F.when(F.col("attempts") > 0, "running").otherwise("pending"))
    return out.select(job, state.alias("state"), "attempts", "progress")


def of_documents(versions: DataFrame, documents: DataFrame, *, doc: str, keep: list[str]) -> DataFrame:
    """Versions with columns of the documents they belong to; those of documents that are gone are left out."""
    return versions.join(documents.select(F.col("id").alias(doc), *keep), doc)
