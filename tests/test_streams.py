"""Streams: requests admitted over several batches, sweeps by triggers, versions of an upserted table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quire.operators import history
from quire.streaming import metering as SM

from .test_replays import plain_admissions


def test_admissions_over_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.choice([1, 2, 3, 8])) for i in range(120)]
    held = {0: 5, 2: 11}
    SM.keyed_state(spark)
    given = spark.createDataFrame(list(held.items()), "workspace int, n int")
    kind = "workspace int, id int, n int"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], kind).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in").withColumn("most", F.when(F.col("workspace") != 3, 12))
        SM.drained(SM.admissions(stream, given, workspace="workspace", order=["id"]), f"{tmp_path}/out", mode="append", checkpoint=f"{tmp_path}/state")
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    start = [(w, -1, n) for w, n in held.items()]
    want = [r for r in plain_admissions([*start, *(r for r in rows if r[0] != 3)], 12) if r[1] >= 0] + [(w, i, True) for w, i, _ in rows if w == 3]
    assert sorted((r.workspace, r.id, r.ok) for r in got) == sorted(want)


def test_sweeps_by_triggers(spark, tmp_path):
    """One query takes what is there and ends, one goes on by processing time; each sweeps files and unused assets as of the latest tick."""
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    files = spark.createDataFrame([(1, at(1, 0)), (2, at(2, 12)), (3, at(3, 0))], "file int, finished timestamp")
    assets = spark.createDataFrame([(7, at(1, 0)), (8, at(1, 0)), (9, at(3, 0))], "asset int, created timestamp")
    texts = spark.createDataFrame([("uses 8",)], "text string")
    log = {"files": [], "assets": []}

    def files_due(when):
        log["files"].append((when, sorted(r.file for r in history.expired(files, finished="finished", as_of=F.lit(when), hours=24).collect())))

    def assets_due(when):
        log["assets"].append((when, sorted(r.asset for r in history.unused_assets(assets, texts, asset="asset", created="created", text="text", pattern="[0-9]+", as_of=F.lit(when)).collect())))

    ticks = lambda: spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/ticks")
    write = lambda *whens: spark.createDataFrame([(w,) for w in whens], "at timestamp").write.mode("append").parquet(f"{tmp_path}/ticks")
    write(at(2, 1), at(2, 2))
    assert SM.sweeping(ticks(), assets_due, checkpoint=f"{tmp_path}/daily").awaitTermination(60)
    hourly = SM.sweeping(ticks(), files_due, checkpoint=f"{tmp_path}/hourly", every="1 second")
    hourly.processAllAvailable()
    write(at(4, 5))
    hourly.processAllAvailable()
    hourly.stop()
    assert SM.sweeping(ticks(), assets_due, checkpoint=f"{tmp_path}/daily").awaitTermination(60)
    assert SM.sweeping(ticks(), assets_due, checkpoint=f"{tmp_path}/daily").awaitTermination(60)
    assert log == {"files": [(at(2, 2), [1]), (at(4, 5), [1, 2, 3])], "assets": [(at(2, 2), [7]), (at(4, 5), [7, 9])]}


def test_old_versions_go(spark, tmp_path):
    put = SM.upsert(f"{tmp_path}/state", ["k"], "seq", buckets=1)
    for epoch in range(5):
        rows = spark.createDataFrame([(epoch % 2, epoch)], "k int, seq int")
        put(rows, epoch)
        put(rows, epoch)
    assert sorted(SM.every_version(spark, f"{tmp_path}/state")) == [(0, 3), (0, 4)]
    assert sorted(map(tuple, SM.upserted(spark, f"{tmp_path}/state").select("k", "seq").collect())) == [(0, 4), (1, 3)]
