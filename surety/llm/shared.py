"""Scratch space that the driver and all executors share, and names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared scratch folder: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (one machine, as in
    tests) a temporary folder is made; on a cluster the setting is asked for.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="surety-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder; one per call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage with files that every executor can reach, so the loss of an
    executor never repeats the work upstream.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the files behind materialised frames that nothing reads any more; others are left alone."""
    for frame in frames:
        if path := getattr(frame, "_scratch", None):
            spark = frame.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with a number behind it, whichever no column of ``df`` has (letters' case aside)."""
    taken, out, k = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


#: Rows of one Arrow batch: a batch of long texts must fit beside an executor's heap.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the session stands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
