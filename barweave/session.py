"""Session helpers: local test session, shared workspace, durable cut points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, one machine) gets a fresh temporary folder. Any other
    master raises: executors of a cluster do not see each other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    require_local(spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barweave-"))
    return spark.sparkContext.getCheckpointDir()


def require_local(master: str) -> None:
    """Raise unless all tasks run on this machine (``local`` or ``local[..]``)."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that every executor of {master} can reach")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/barweave/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    For tables that several later branches use. The copy survives the loss of an executor.
    """
    spark = df.sparkSession
    path = workspace(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
