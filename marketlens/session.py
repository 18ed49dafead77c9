"""Session construction and shared-storage helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are still unset, so cluster-level choices (shuffle
partitions, checkpoint directory, AQE knobs) always win.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults applied only when the running session has no value yet.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("marketlens")
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("MARKETLENS_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (pandas UDFs), as
    ``--py-files`` would: zip it once per application and ``addPyFile`` it, so
    Spark distributes it to every executor whatever their working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marketlens-pyfiles-"), "marketlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(pkg)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def apply_defaults(spark: SparkSession) -> None:
    ship_package(spark)
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    # Reports compare timestamps without zones; pin UTC for local runs.
    spark.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone", "UTC"))


# What one task takes in.  Narrow sorted keys are a sixtieth of their size in
# memory once they lie compressed in a file or a shuffle, so Spark's sizes (128 MB
# of files, 64 MB of a shuffle) are gigabytes of hash maps and sorts.
_TASK_INPUT = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def bound_tasks(spark: SparkSession) -> None:
    """Sizes of file splits and shuffle reads for the marketplace tables, where the
    cluster sets none."""
    for key, value in _TASK_INPUT.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    Uses ``spark.checkpoint.dir`` as configured by the cluster.  Only when it is
    unset on a ``local`` master (tests, bench) a fresh scratch folder is created
    and registered; on a cluster an unset folder is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local"):
        # A machine-local folder is not visible to the other executors.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) for this cluster")
    local = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder.  What is written there
    may be read until the application calls ``remove_scratch`` or ends."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_scratch(spark: SparkSession, path: str) -> bool:
    """Whether a scratch path of this application is still there."""
    return path in _SCRATCH.get(spark.sparkContext.applicationId, [])


def remove_scratch_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table; frames that read it are void from then on."""
    paths = _SCRATCH.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; frames that read them are
    void from then on.  Returns how many there were."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        remove_scratch(spark)
