"""Session construction and the shared working folder.

Library code never creates its own session; it takes the caller's. ``get_spark``
exists for tests, the bench and the command line.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Texts and records are stored between steps; this codec takes less room than the default one.
CODEC = "zstd"
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Defaults for a local run; on a cluster these come from the job's own config.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "stmtflow") -> SparkSession:
    master = master or os.environ.get("STMTFLOW_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STMTFLOW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to shared storage; without it nothing
    can be stored between stages, so it is an error there. Only a local master, whose
    tasks share the driver's disk, gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="stmtflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder (optionally made unique per call)."""
    root = checkpoint_root(spark).rstrip("/")
    tail = "/".join(p.strip("/") for p in parts if p)
    if unique:
        tail = f"{tail}/{uuid.uuid4().hex}" if tail else uuid.uuid4().hex
    return f"{root}/stmtflow/{tail}" if tail else f"{root}/stmtflow"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint folder.

    For plans that branch: every branch then reads the stored rows, also after executors
    are lost. Spark owns the files and removes them with the frame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that begin within remove their shuffle files when they end: what they wrote is stored, nothing reads the shuffles again."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def materialize(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` (shared storage, the caller's to remove) and read it back."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as columns in the shared folder (the caller's to remove), for rows that hold texts or records.

    Like ``cut`` it ends the lineage; it takes less room, and a reader takes only the columns that it asks for.
    """
    path = shared_path(df.sparkSession, "stages", unique=True)
    materialize(df, path, CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``; if a complete write is already there, that one, without computing ``df``.

    Complete means that the writer's ``_SUCCESS`` mark is there; without it (also where the mark is switched off)
    the rows are computed and written anew.
    """
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
