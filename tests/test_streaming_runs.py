"""Runs on a stream equal the batch runs, across restarts and shuffled arrival."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from driftline.core.axis import Axis
from driftline.core.runs import find_runs
from driftline.streaming import live

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "animal string, ts timestamp, n long, v long"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def rows():
    r = random.Random(1)
    out = []
    for a in ("x", "y"):
        v, t = 0, 0
        for i in range(150):
            v = r.choice([0, 1, None]) if r.random() < 0.3 else v
            t += r.choice([0, 1, 1, 2])
            out.append((a, T0 + timedelta(seconds=t), i, v))
        out += [(a, T0 + timedelta(hours=5), 999, 7), (a, T0 + timedelta(hours=6), 999, 8)]  # the watermark passes the first; these two stay
    return out


def feed(spark, folder, k, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))


def run_once(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    q = (live.live_runs(stream, ["animal"], "ts", F.col("v"), "n", "60 seconds").writeStream.format("parquet").option("path", str(folder / "out"))
         .option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def test_runs_of_shuffled_rows_and_after_a_restart(rocks, tmp_path):
    all_ = rows()
    parts = []
    for lo in range(0, 400, 60):  # within a minute rows come in any order
        part = [x for x in all_ if lo <= (x[1] - T0).total_seconds() < lo + 60]
        random.Random(lo).shuffle(part)
        parts.append(part)
    parts = [p for p in parts if p] + [[x for x in all_ if x[2] == 999]]
    for k, part in enumerate(parts):
        feed(rocks, tmp_path, k, part)
        if k in (1, len(parts) - 1):  # stopped and started again from the checkpoint
            run_once(rocks, tmp_path)
    feed(rocks, tmp_path, 99, [("x", T0, 5_000, 1)])  # far too late
    run_once(rocks, tmp_path)
    got = [(r["animal"], r["value"], r["start_ts"], r["end_ts"], r["n"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect()]
    batch = find_runs(rocks.createDataFrame(all_, SCHEMA).withColumn("v", F.col("v").cast("string")), Axis(("animal",), ("ts", "n"), width=50_000_000), "v")
    want = [(r["animal"], r["value"], r["start_ts"], r["end_ts"], r["n"]) for r in batch.where("value IS NULL OR value NOT IN ('7', '8')").collect()]
    key = lambda x: (x[0], x[2], x[3], x[4], x[1] or "")
    assert len(got) > 40 and sorted(got, key=key) == sorted(want, key=key)
