"""Session settings and the shared scratch location."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many small shuffle partitions to begin with; AQE merges them to this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rule packs make long expressions. Above this size the JIT gives up on a fused
    # method, so Spark should fall back to its split per-operator code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Do not record the Python call site of every Column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "loghelm", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect. ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(CLUSTER_SETTINGS)
    settings.update({key.replace("__", "."): value for key, value in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Those that results or speed depend on and that a running session can still take.
RUNTIME_SETTINGS = ["spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"]


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set what the operators need on a session that someone else built."""
    for key in RUNTIME_SETTINGS:
        spark.conf.set(key, CLUSTER_SETTINGS[key])
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the cluster's shared checkpoint folder.

    A session in local mode that names no such folder gets a temporary one. On a cluster that
    would be a different disk for each executor, so there the folder has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loghelm-")
    return f"{base.rstrip('/')}/loghelm/{purpose}-{uuid.uuid4().hex}"


def materialized(frame: DataFrame, purpose: str) -> DataFrame:
    """A frame written to the shared scratch folder and read back, so it is computed once."""
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
