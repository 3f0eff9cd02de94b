"""Session set-up and the two helpers that keep plans safe at cluster scale."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count proves it stays under these bounds.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 128 * 1024 * 1024


def build_session(app: str = "groundwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution. On a cluster, sizing comes from its own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str | None:
    """The cluster's checkpoint folder; a scratch folder only in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="groundwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    return None


def scratch_folder(spark: SparkSession) -> str:
    """A folder every executor can reach, for tables that outlive one plan."""
    folder = _shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and continue from there.

    Used where one intermediate result feeds several branches, which must then see the same rows. Survives
    the loss of executors because the files are in shared storage; later reads are pruned and have
    statistics. Fails where a cluster names no folder.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame,
    row_bytes: int = 64,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> bool:
    """Whether `df` provably stays under the broadcast bound. Stops counting at the bound."""
    bound = min(max_rows, max_bytes // max(1, row_bytes))
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast for a side proven small; leave the join strategy to Catalyst otherwise."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df
