"""Session defaults for tests and local runs; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", name: str = "tickloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a scratch folder only for a local session without one.

    On several machines each would write to its own disk, and later reads would miss
    rows without an error, so a session of a cluster has to name the folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to apply to any session.

    Window pipelines cost far more CPU per byte than AQE assumes, so let it keep
    one partition per core on small shuffles (large ones still follow the
    advisory size).
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16KB")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` removes what was written there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this library wrote to the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this process, once the frames that read them are done with."""
    for path in list(_WRITTEN):
        delete_path(spark, path)


def materialise(df, name: str = "table"):
    """Write a frame that several branches read to the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of any executor, and the
    branches still prune columns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
