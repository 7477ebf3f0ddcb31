"""Structured Streaming forms of metering, rate limits and history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import BURST_SECONDS
from ..operators.metering import fixed_window, month_start


def event_stream(spark: SparkSession, folder: str, *, schema: T.StructType | None = None, per_trigger: int = 16) -> DataFrame:
    """The events of a folder's Parquet files as a stream, the oldest file first, `ts` as an instant; the schema is read from them if it is not given."""
    schema = schema or spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def monthly_usage(events: DataFrame, *, workspace: str, metric: str, late: str = "1 day") -> DataFrame:
    """Usage by month, workspace and metric; rows of a month come out when it has ended for the watermark (append) or as they change (update)."""
    return events.withWatermark("ts", late).groupBy(month_start(F.col("ts")).alias("month"), workspace, metric).agg(F.count("*").alias("quantity"))


def window_counts(events: DataFrame, *, key: list[str], seconds: int, late: str = "1 minute") -> DataFrame:
    """Hits in each fixed window of each key."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", f"{seconds} seconds"), *key).agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), *key, "hits")


#: Fixed value: keys share so many states, since a call of Python for each key costs more than its few rows.
BUCKETS = 1024


def shared_state(rows: DataFrame, key: str) -> DataFrame:
    """rows with their key as a text, `state_key`, and the bucket whose state holds it."""
    return rows.withColumns({"state_key": F.col(key).cast("string"), "state_bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")}).drop(key)


def refusals(events: DataFrame, *, key: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Hits beyond the limit of their fixed window, as they come.

    State is the open windows of a bucket's keys with their counts: hits of an earlier window may come in a later batch until
    the watermark has passed its end; then the window is dropped. Hits count in the order of their batches, within a batch by time.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, windows, counts = state.get if state.exists else ((), (), ())
        held = dict(zip(zip(keys, windows), counts))
        passed = state.getCurrentWatermarkMs()
        over: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
            for at, one in enumerate(zip(rows["state_key"].tolist(), rows["w"].tolist())):
                held[one] = n = held.get(one, 0) + 1
                if n > limit:
                    over.append((at, n))
        held = {(k, w): n for (k, w), n in held.items() if (w + 1) * seconds * 1000 > passed}
        if held:
            state.update(([k for k, _ in held], [w for _, w in held], list(held.values())))
            state.setTimeoutTimestamp(max((min(w for _, w in held) + 1) * seconds * 1000, passed) + 1)
        elif state.exists:
            state.remove()
        if over:
            yield rows.iloc[[at for at, _ in over]][["state_key", "event_id", "ts", "w"]].rename(columns={"w": "window"}).assign(nth=[n for _, n in over])

    hits = shared_state(events.withWatermark("ts", late).select(key, "event_id", "ts", fixed_window(F.col("ts"), F.lit(seconds)).alias("w")), key)
    out = hits.groupBy("state_bucket").applyInPandasWithState(
        step, "state_key string, event_id long, ts timestamp, window long, nth long", "keys array<string>, windows array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("state_key").cast(kind).alias(key), "event_id", "ts", "window", "nth")


class Admissions(StatefulProcessor):
    """What the admitted requests of a bucket's workspaces have used so far; state is one number each, which lives as long as the workspace."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "keys array<string>, n array<long>")

    def held(self) -> dict:
        return dict(zip(*self.used.get())) if self.used.exists() else {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        used = self.held()
        for k, n in zip(initialState["state_key"].tolist(), initialState["n"].fillna(0).tolist()):
            used[k] = used.get(k, 0) + int(n)
        self.used.update((list(used), list(used.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.held()
        asked, ok = pd.concat(list(rows)).sort_values(self.order), []
        for k, n, most in zip(asked["state_key"].tolist(), asked["n"].fillna(0).tolist(), asked["most"].tolist()):
            now = used.get(k, 0)
            ok.append(bool(pd.isna(most) or now + n <= most))
            used[k] = int(now + n) if ok[-1] else now
        self.used.update((list(used), list(used.values())))
        yield asked[["state_key", *self.order]].assign(ok=ok)

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, held: DataFrame, *, workspace: str, order: list[str]) -> DataFrame:
    """Whether each request still fits its workspace's limit, decided request by request as they come (append mode).

    requests: workspace, n, most (null: no limit) and the columns of `order`, by which the requests of a batch are taken;
    held: workspace, n, where the state begins, if the query has no checkpoint yet. A refused request takes nothing. Needs
    the RocksDB state store (see `keyed_state`).
    """
    schema = T.StructType([T.StructField("state_key", T.StringType()), *(requests.schema[c] for c in order), T.StructField("ok", T.BooleanType())])
    begin = shared_state(held.select(F.col(workspace).cast(requests.schema[workspace].dataType).alias(workspace), F.col("n").cast("long").alias("n")), workspace).groupBy("state_bucket")
    asked = shared_state(requests.select(workspace, *order, F.col("n").cast("long").alias("n"), F.col("most").cast("long").alias("most")), workspace)
    out = asked.groupBy("state_bucket").transformWithStateInPandas(Admissions(order), schema, "append", "none", begin)
    return out.select(F.col("state_key").cast(requests.schema[workspace].dataType).alias(workspace), *order, "ok")


def keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state of several kinds needs, for queries started from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sweeping(ticks: DataFrame, sweep: Callable[[datetime], None], *, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a sweep once for each batch of ticks (a stream with a column `at`), as of its latest tick, and starts the query.

    With `every` it goes on with that processing time, as an hourly or daily task does; without it takes what is there and
    ends. A batch without ticks sweeps nothing; one that is run again after a failure sweeps as of the same moment.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        at = batch.agg(F.max("at")).first()[0]
        if at is not None:
            sweep(at)

    writer = ticks.select("at").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def burst_history(saves: DataFrame, *, doc: str, seconds: float = BURST_SECONDS) -> DataFrame:
    """Steps of each document's history after every batch (update mode): (doc, step, kind, started, saves).

    A save counts when its batch comes: within a batch by time, and later batches go on at the tip. State is the tips of a
    bucket's documents, four numbers each, which the next save needs whenever that comes; it is never dropped.
    """
    kind = saves.schema[doc].dataType.simpleString()

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tips = {k: tuple(tip) for k, *tip in zip(*state.get)} if state.exists else {}
        out: dict[tuple, tuple] = {}
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for k, what, micros in zip(rows["state_key"].tolist(), rows["kind"].tolist(), rows["ts"].to_numpy("datetime64[us]").astype("int64").tolist()):
            number, tip, begun, n = tips.get(k, (0, "", 0, 0))
            if number and what == "content" == tip and micros - begun < seconds * 1_000_000:
                n += 1
            else:
                number, tip, begun, n = number + 1, what, micros, 1
            tips[k] = out[k, number] = (number, tip, begun, n)
        state.update((list(tips), *map(list, zip(*tips.values()))))
        told = pd.DataFrame([(k, *v) for (k, _), v in out.items()], columns=["state_key", "step", "kind", "started", "saves"])
        yield told.assign(started=pd.to_datetime(told["started"], unit="us"))

    made = shared_state(saves.select(doc, "event_id", "ts", "kind"), doc).groupBy("state_bucket").applyInPandasWithState(
        step, "state_key string, step long, kind string, started timestamp, saves long", "keys array<string>, number array<long>, tip array<string>, begun array<long>, n array<long>", "update", GroupStateTimeout.NoTimeout)
    return made.select(F.col("state_key").cast(kind).alias(doc), "step", "kind", "started", "saves")


def drained(stream: DataFrame, path: str, *, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there now, appending what it gives out to a Parquet folder (exactly once for each batch)."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(target: str, key: list[str], order: str, *, buckets: int = 64):
    """foreachBatch sink: the latest row of each key; out-of-order and repeated events change nothing.

    The state is kept in buckets of the key. A batch rewrites the buckets that its keys fall into, each as a new version, and
    `upserted` reads the last version of each; a version that a failed batch has begun is written over when it is retried.
    Of each bucket the last version and the one before it stay; older ones are removed, so disk grows with the state only.
    """

    def put(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        own = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # `buckets` numbers at most
        old = versions(spark, target, before=epoch)
        if old:
            stored = spark.read.schema(own.schema).option("basePath", target).parquet(*(f"{target}/bucket={b}/version={v}" for b, v in old.items() if b in touched)) if any(b in old for b in touched) else None
            own = own if stored is None else own.unionByName(stored.select(own.columns))
        rest = [c for c in df.columns if c not in key]
        latest = F.struct(order, *(c for c in rest if c != order))
        best = own.groupBy(*key, "bucket").agg(F.max_by(F.struct(*rest), latest).alias("s")).select(*key, "s.*", "bucket", F.lit(epoch).alias("version"))
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        dropped(spark, target, touched, before=epoch)

    return put


def dropped(spark: SparkSession, target: str, buckets: list[int], *, before: int) -> None:
    """Removes the versions of buckets that are older than the last one before `before`: that one a retried batch still reads."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = versions(spark, target, before=before)
    for bucket, version in every_version(spark, target):
        if bucket in buckets and version < kept.get(bucket, -1):
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={bucket}/version={version}"), True)


def every_version(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(bucket, version) of an upserted table; folders only are listed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/version=*")) or []
    return [tuple(int(p.partition("=")[2]) for p in f.getPath().toString().split("/")[-2:]) for f in found]


def versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The last version of each bucket of an upserted table, below `before` if that is given."""
    out: dict[int, int] = {}
    for bucket, version in every_version(spark, target):
        if before is None or version < before:
            out[bucket] = max(out.get(bucket, -1), version)
    return out


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of an upserted table."""
    paths = [f"{target}/bucket={b}/version={v}" for b, v in versions(spark, target).items()]
    return spark.read.option("basePath", target).parquet(*paths).drop("bucket", "version")
