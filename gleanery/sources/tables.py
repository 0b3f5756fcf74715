"""Parquet tables of a data folder, and helpers on how a scan is split."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; columns and filters are pushed into its scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Split a scan that has fewer partitions than the cluster has use for.

    A scan of many files is returned as it is, without a shuffle; only a table of a
    few files is dealt out over the cores before a costly per-row step.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() * 2 > want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys]) if keys else df.repartition(want)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach: spark.checkpoint.dir.

    Only where all executors run in one machine's process (a local master), a folder of our
    own stands in for it; on a cluster without the setting this raises, since a
    machine-local folder would be lost or unreadable there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file:///tmp/gleanery-checkpoints-{os.getuid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> tuple[str, int]:
    """Write rows to a table of their own in the shared folder and give its path and number of rows: lineage ends there, and several such tables are read as one. The rows are counted as they are written."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return path, seen.get["n"]


def together(*steps):
    """Run steps that each start jobs of their own side by side, so that one's last tasks don't leave the cluster idle; gives their results in order."""
    session = SparkSession.getActiveSession()
    own = inheritable_thread_target(session) if session else lambda f: f
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(own(s)) for s in steps]]
