"""Sinks: write the star schema (or any report) as parquet to shared storage.

Paths come from ``spark.checkpoint.dir`` (the cluster's shared folder) unless
the caller passes one.

Two layouts:

* ``write_star`` — plain parquet, orders partitioned by ``year_month``
  (the overwrite-load of p18);
* ``write_star_bucketed`` — every table bucketed and sorted on its join key
  (the four order-grain facts on ``order_id`` with the same bucket count), so
  orders ⋈ payments / items / reviews and their per-order aggregations run
  without a shuffle of the big side (bucketed scans report their
  partitioning to the planner).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import uuid

from ..session import scratch_path
from .adapter import Star

LOAD_ORDER = ("customers", "products", "sellers", "orders", "order_items", "payments", "reviews")


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_star(spark: SparkSession, st: Star, root: str | None = None) -> dict[str, DataFrame]:
    """Overwrite-load the seven tables in FK order; return the re-read frames."""
    base = root or scratch_path(spark, "star")
    out = {}
    for name in LOAD_ORDER:
        part = "year_month" if name == "orders" else None
        out[name] = write_table(getattr(st, name), f"{base}/{name}", part)
    return out


def star_from_parquet(spark: SparkSession, root: str) -> Star:
    return Star(**{name: spark.read.parquet(f"{root}/{name}") for name in LOAD_ORDER})


BUCKET_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "sellers": "seller_id",
    "orders": "order_id",
    "order_items": "order_id",
    "payments": "order_id",
    "reviews": "order_id",
}


def write_star_bucketed(spark: SparkSession, st: Star, root: str | None = None, buckets: int | None = None) -> Star:
    """Write the star as external bucketed tables under ``root``; return the table-backed Star."""
    base = root or scratch_path(spark, "star-bucketed")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tag = uuid.uuid4().hex[:8]
    frames = {}
    for name in LOAD_ORDER:
        key = BUCKET_KEYS[name]
        table = f"ml_{tag}_{name}"
        (
            getattr(st, name)
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(n, key)
            .sortBy(key)
            .option("path", f"{base}/{name}")
            .saveAsTable(table)
        )
        frames[name] = spark.table(table)
    return Star(**frames)
