"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "labelflow",
              shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session with AQE on and the UI off; settings already given win.

    ``driver_memory`` only takes effect when this call starts the JVM; in
    local mode the driver heap is the executors' memory."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set, to shared storage. A session on a ``local``
    master that has none (a single machine: all tasks see its disk) gets a
    folder of its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="labelflow-ckpt-")
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/labelflow/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this library's tables below the shared folder, when no frame that reads them is used any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark).rstrip('/')}/labelflow")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where one small derived table feeds several passes (counts): a lost
    executor then recomputes from the checkpoint, not from the scans.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a derived table below the shared folder and read it back.

    Unlike a checkpoint its columns and partitions are pruned by later reads,
    and its measured size lets Spark choose a broadcast join by itself."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table with fewer partitions than the cluster has cores.

    For a file scan only (asking a shuffled plan for its partitions would run
    it). A small file with one row group scans as one partition, which would
    put all the per-row text work of that table into one task; such an input
    has its text shuffled once. A table with a partition per core or more is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    What ``--py-files`` does, for a session that was started without it: a zip
    of the package's sources, sent once per Spark context by ``addPyFile``."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_labelflow_shipped", False) or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="labelflow-"), "labelflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._labelflow_shipped = True


def set_local_checkpoint_dir_if_unset(spark: SparkSession, path: str) -> None:
    """For tests and local benches only: set a checkpoint folder if none is set."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        os.makedirs(path, exist_ok=True)
        sc.setCheckpointDir(path)
    checkpoint_root(spark)
