"""Session settings, table access and durable cuts of the lineage."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "seamark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the plans of this package expect.

    Only defaults are given here; a cluster's own values (memory, shuffle partitions, checkpoint folder) win.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # tables that were cut from their lineage go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local temporary folder only where none is set (tests)."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    now = sc.getCheckpointDir()
    if now is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        now = Path(tempfile.mkdtemp(prefix="seamark-cp-")).as_uri()
        sc.setCheckpointDir(now)
    return now


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: survives lost executors and ends its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hinted(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted and is small; beyond that the join stays a shuffle. For cut frames of narrow rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
