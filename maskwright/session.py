"""Session defaults and the folder used for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job of this library wants; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # documents can be megabytes each: keep the rows waiting for Python few
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of this session, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="maskwright-"), "maskwright.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _shipped.add(app)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A machine-local folder is used only when the session names none, which is
    the case in tests; on a cluster the setting has to name a shared folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives executor loss.

    Used where several outputs share one expensive input, above all detection.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
