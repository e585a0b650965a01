"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # event time is UTC throughout
    "spark.sql.session.timeZone": "UTC",
    # joins may reuse a partitioning on a subset of their keys: events are shuffled once by
    # (house, cycle) and then joined on (house, cycle, household, plug) without another exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # what is broadcast passes through the driver and its size is guessed from compressed files: only
    # tables that stay small unpacked, such as one row per house and configuration
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    # bounds of what a Python worker gets at once, whatever the length of texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # stateful streams: states larger than memory, and several kinds of state per key
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_bandwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bandwise-")) / "bandwise_package.zip"  # the driver's own; Spark serves it
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    # stateful streams start a Python process beside the driver that does not get shipped files
    paths = [str(root.parent), context.environment.get("PYTHONPATH", "")]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    context._bandwise_shipped = True


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitions by key, as many as the session's shuffles have.

    For rows that get many times wider or longer after the exchange: the adaptive planner would
    merge partitions by what it sees before that.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *columns)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, a temporary one in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="bandwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
