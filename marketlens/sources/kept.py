"""Results of the offline pipeline, kept for the reports that serve them.

A result lives below the cluster's shared checkpoint folder, under its name and
a version: a fingerprint of the source's files (path, length, modification time),
of the parameters and of the code.  Reports that find the version read it; otherwise it is
built, written beside others that may be under way, and found by its _SUCCESS
marker, so an interrupted build is never read.  A changed source has another
version, and publishing one removes the versions before it.

Kept results outlive the application.  Stars without a source (made by hand)
keep nothing: their results are built for the call.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path
from .adapter import RAW_TABLES, Star


def fingerprint(spark: SparkSession, source: str) -> str:
    """Digest of path, length and time of every file of the source's tables; the
    files' contents are not read."""
    files = spark.read.format("binaryFile").load([f"{source}/{t}.parquet" for t in RAW_TABLES])
    mark = F.xxhash64("path", "length", F.col("modificationTime").cast("timestamp")).cast("decimal(38,0)")
    n, total = files.agg(F.count("path"), F.sum(mark)).first()
    return hashlib.md5(f"{n}:{total}".encode()).hexdigest()[:16]


@cache
def code() -> str:
    """Digest of what builds the results: the package without what nothing of it
    imports."""
    package = Path(__file__).resolve().parent.parent
    files = sorted(f for f in package.rglob("*.py") if "llm" not in f.relative_to(package).parts)
    return hashlib.md5(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(st: Star, name: str, parameters: object, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The kept result ``name`` of the star's source, built if there is none for
    the source as it is now, or if ``fresh``."""
    spark = st.spark
    if st.source is None:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        return spark.read.parquet(path)
    folder = f"{checkpoint_root(spark).rstrip('/')}/kept/{name}-{hashlib.md5(st.source.encode()).hexdigest()[:12]}"
    version = hashlib.md5(f"{fingerprint(spark, st.source)}:{parameters}:{code()}".encode()).hexdigest()[:16]
    there = _listed(spark, f"{folder}/{version}-*/_SUCCESS")
    if there and not fresh:
        return spark.read.parquet(there[-1].rsplit("/", 1)[0])
    before = _listed(spark, f"{folder}/*/_SUCCESS")
    path = f"{folder}/{version}-{len(there):06d}-{uuid.uuid4().hex[:12]}"
    build().write.parquet(path)
    for other in before:
        if f"/{version}-" not in other:
            _removed(spark, other.rsplit("/", 1)[0])
    return spark.read.parquet(path)


def forget(st: Star, name: str) -> int:
    """Remove all versions of a kept result; returns how many there were."""
    folder = f"{checkpoint_root(st.spark).rstrip('/')}/kept/{name}-{hashlib.md5((st.source or '').encode()).hexdigest()[:12]}"
    found = _listed(st.spark, f"{folder}/*")
    for f in found:
        _removed(st.spark, f)
    return len(found)
