"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # expressions on label text cost more than its bytes suggest: keep small stages parallel
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
    # long column expressions are built faster without call-site tracking
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # label XML can reach megabytes: small Arrow batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


_SCRATCH: list[str] = []


def build_session(master: str | None = None, app: str = "labelmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, wherever they and the driver run."""
    context = spark.sparkContext
    if getattr(context, "_labelmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="labelmill-package-"), "labelmill_package.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._labelmill_shipped = True


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``.  Only where that
    is unset and driver and executors are one process (tests, a single
    machine) a temporary folder is made; on a cluster its absence is an error,
    as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="labelmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of any file system that Spark knows."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders of this process, once nothing reads them any more."""
    delete(spark, *_SCRATCH)
    _SCRATCH.clear()


def stage(df: DataFrame, purpose: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage, survives lost executors, and lets the readers prune columns
    and partitions where they would otherwise compute ``df`` several times.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        delete(df.sparkSession, df._staged_at)
        _SCRATCH.remove(df._staged_at)
