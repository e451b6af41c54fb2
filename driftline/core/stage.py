"""Materialised steps in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MAX_LEAVES = 12


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Without that setting a local session, as in tests, gets a scratch folder that
    ends with the process; a cluster session is refused, since its executors share no local folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-driftline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_staged() -> None:
    """What this process staged goes when it ends; no plan can read it any more."""
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before
            return


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the checkpoint folder and read it back: computed once, prunable, and
    still there when executors are lost. The folder is removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, limit: int = MAX_LEAVES) -> DataFrame:
    """Stage ``df`` when its plan already reads its sources many times.

    An ordered scan reads its input twice (rows and chunk summary), so chained scans would double the
    work at each link. Counting the plan's leaves keeps that bounded whatever operators are combined.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().size()
    return stage(df) if leaves > limit else df
