"""Session settings the library expects, and where its working files go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Off, so that base64() gives one unbroken line, as stored payloads need.
    "spark.sql.chunkBase64String.enabled": "false",
}


def local_session(app: str = "quireflow", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settle(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    For results that several plans use: they are computed once, and a lost executor costs a
    read, not the whole lineage.
    """
    folder = work_dir(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can see.

    It lies under the cluster's shared ``spark.checkpoint.dir``. Only a local
    session without that setting falls back to the machine's own temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="quireflow-")
    return f"{shared.rstrip('/')}/quireflow/{purpose}-{uuid.uuid4().hex}"
