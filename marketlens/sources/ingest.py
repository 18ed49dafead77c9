"""CSV ingest and cleaning (p01–p06).

The raw marketplace exports are CSV files: header row, RFC-4180 quoting
(quotes doubled), comments that span lines, '' for missing values,
'True'/'False' booleans, zip prefixes that lost their leading zeros, a
Portuguese-only product file plus a category translation file, duplicate
reviews per order and a raw geolocation file with several points per zip.

``export_raw_csv`` writes such a file, derived from the star schema, to the
shared checkpoint folder (never a machine-local path), once per source and only
when a report reads it; the ``clean_*`` functions read it back with ``spark.read.csv`` and rebuild typed tables.
Each p0x report is checked against the star table it must reproduce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..oracle.adapter_sql import with_star
from ..plans.registry import report
from ..session import is_scratch, scratch_path
from .adapter import Star

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
# Only this file has line breaks inside fields; the others stay splittable.
MULTI_LINE = {"reviews"}
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
RAW_FILES = ("customers", "products", "category_translation", "sellers", "orders", "order_items", "payments",
             "reviews", "geolocation")

_EXPORTS: dict[tuple[str, str, str], str] = {}


def _as_text(df: DataFrame) -> DataFrame:
    """Render every column the way the raw exports do ('' for missing)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            s = F.date_format(c, TS_FORMAT)
        elif isinstance(f.dataType, T.BooleanType):
            s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        else:
            s = c.cast("string")
        cols.append(F.coalesce(s, F.lit("")).alias(f.name))
    return df.select(*cols)


def raw_reviews(st: Star) -> DataFrame:
    """Reviews plus an older, superseded review for every 50th order."""
    k = F.col("order_id").cast("bigint")
    older = st.reviews.filter(k % 50 == 0).select(
        F.concat(F.col("review_id"), F.lit("_old")).alias("review_id"),
        "order_id",
        (F.col("review_score") % 5 + 1).alias("review_score"),
        "review_comment_title",
        "review_comment_message",
        (F.col("review_creation_date") - F.make_dt_interval(F.lit(30))).alias("review_creation_date"),
        (F.col("review_answer_timestamp") - F.make_dt_interval(F.lit(30))).alias("review_answer_timestamp"),
    )
    return st.reviews.unionByName(older)


def raw_geolocation(st: Star) -> DataFrame:
    """Three points per customer zip prefix (dyadic coordinates: exact sums)."""
    z = st.customers.groupBy("customer_zip_code_prefix").agg(
        F.min("customer_city").alias("customer_city"), F.min("customer_state").alias("customer_state")
    )
    zi = F.col("customer_zip_code_prefix").cast("int")
    pts = z.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    return pts.select(
        F.col("customer_zip_code_prefix").cast("int").cast("string").alias("geolocation_zip_code_prefix"),
        (F.lit(-30.0) + (zi % 1000) / 64.0 + F.col("j") / 256.0).alias("geolocation_lat"),
        (F.lit(-50.0) + (zi % 700) / 128.0 - F.col("j") / 512.0).alias("geolocation_lng"),
        F.col("customer_city").alias("geolocation_city"),
        F.col("customer_state").alias("geolocation_state"),
    )


def _raw_frame(st: Star, name: str) -> DataFrame:
    """The rows of one raw export."""
    if name == "customers":
        return st.customers.withColumn("customer_zip_code_prefix", F.col("customer_zip_code_prefix").cast("int").cast("string"))
    if name == "products":
        return st.products.drop("product_category_name_english", "is_incomplete")
    if name == "category_translation":
        named = st.products.filter(F.col("product_category_name_english").isNotNull())
        return named.select("product_category_name", "product_category_name_english").distinct()
    if name == "reviews":
        return raw_reviews(st)
    if name == "geolocation":
        return raw_geolocation(st)
    return getattr(st, name)


def export_raw_csv(spark: SparkSession, st: Star, name: str) -> str:
    """Write one raw CSV export, once per application and source, and return
    its folder.  A star without a source is written anew each time."""
    key = (spark.sparkContext.applicationId, st.source or "", name)
    if st.source is None or not is_scratch(spark, _EXPORTS.get(key, "")):
        path = scratch_path(spark, f"raw-{name}")
        _as_text(_raw_frame(st, name)).write.options(**CSV_OPTIONS).csv(path)
        if st.source is None:
            return path
        _EXPORTS[key] = path
    return _EXPORTS[key]


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """p01: header CSV, quoted fields (over several lines in reviews), every
    column read as text."""
    multi = str(name in MULTI_LINE).lower()
    return spark.read.options(**CSV_OPTIONS, multiLine=multi, inferSchema="false").csv(path)


def raw_csv(st: Star, name: str) -> DataFrame:
    """One raw export, written and read back."""
    spark = st.orders.sparkSession
    return read_csv(spark, export_raw_csv(spark, st, name), name)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """p05: '' → NULL, then cast to the declared type ('True'/'False' → boolean)."""
    cols = []
    for f in schema.fields:
        c = F.nullif(F.col(f.name), F.lit(""))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def clean_customers(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """p02: typed customers with the 5-character zip prefix restored."""
    t = typed(raw, schema)
    return t.withColumn("customer_zip_code_prefix", F.lpad("customer_zip_code_prefix", 5, "0"))


def clean_products(raw: DataFrame, translation: DataFrame, schema: T.StructType) -> DataFrame:
    """p03: English category via the translation file; incomplete = all descriptive columns missing."""
    base = typed(raw, T.StructType([f for f in schema.fields if f.name not in ("product_category_name_english", "is_incomplete")]))
    tr = translation.select(
        F.nullif(F.col("product_category_name"), F.lit("")).alias("_pt"),
        F.nullif(F.col("product_category_name_english"), F.lit("")).alias("product_category_name_english"),
    )
    j = base.join(tr, base["product_category_name"] == tr["_pt"], "left").drop("_pt")
    descriptive = [f.name for f in base.schema.fields if f.name != "product_id"]
    incomplete = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in descriptive])
    return j.withColumn("is_incomplete", incomplete).select(*[f.name for f in schema.fields])


def dedup_reviews(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """p04: keep the latest review per order (answer time, then review_id)."""
    t = typed(raw, schema)
    latest = t.groupBy("order_id").agg(
        F.max(F.struct("review_answer_timestamp", "review_id", *[c for c in t.columns if c not in ("order_id", "review_answer_timestamp", "review_id")])).alias("r")
    )
    return latest.select("order_id", "r.*").select(*[f.name for f in schema.fields])


def geolocation_by_zip(raw: DataFrame) -> DataFrame:
    """p06: one point per zip prefix (mean of the raw points)."""
    g = raw.select(
        F.lpad("geolocation_zip_code_prefix", 5, "0").alias("zip_code_prefix"),
        F.col("geolocation_lat").cast("double").alias("lat"),
        F.col("geolocation_lng").cast("double").alias("lng"),
        "geolocation_city",
        "geolocation_state",
    )
    return g.groupBy("zip_code_prefix").agg(
        F.avg("lat").alias("geolocation_lat"),
        F.avg("lng").alias("geolocation_lng"),
        F.min("geolocation_city").alias("geolocation_city"),
        F.min("geolocation_state").alias("geolocation_state"),
        F.count(F.lit(1)).alias("raw_points"),
    )


@report(
    "p01_csv_ingest",
    with_star(
        """SELECT 'customers' AS file_name, count(*) AS row_count FROM customers
        UNION ALL SELECT 'products', count(*) FROM products
        UNION ALL SELECT 'category_translation', count(DISTINCT product_category_name) FROM products
            WHERE product_category_name_english IS NOT NULL
        UNION ALL SELECT 'sellers', count(*) FROM sellers
        UNION ALL SELECT 'orders', count(*) FROM orders_en
        UNION ALL SELECT 'order_items', count(*) FROM order_items
        UNION ALL SELECT 'payments', count(*) FROM payments
        UNION ALL SELECT 'reviews', count(*) + count(CASE WHEN CAST(order_id AS BIGINT) % 50 = 0 THEN 1 END) FROM reviews
        UNION ALL SELECT 'geolocation', 3 * count(DISTINCT customer_zip_code_prefix) FROM customers"""
    ),
    note="row counts of the nine raw CSV files as read back (multi-line quoted fields intact)",
)
def p01(st: Star) -> DataFrame:
    counts = [raw_csv(st, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("file_name"), "row_count") for name in RAW_FILES]
    return reduce(DataFrame.unionByName, counts)


@report("p02_clean_customers", with_star("SELECT * FROM customers"))
def p02(st: Star) -> DataFrame:
    return clean_customers(raw_csv(st, "customers"), st.customers.schema)


@report("p03_clean_products", with_star("SELECT * FROM products"))
def p03(st: Star) -> DataFrame:
    return clean_products(raw_csv(st, "products"), raw_csv(st, "category_translation"), st.products.schema)


@report("p04_dedup_reviews", with_star("SELECT * FROM reviews"))
def p04(st: Star) -> DataFrame:
    return dedup_reviews(raw_csv(st, "reviews"), st.reviews.schema)


@report("p05_empty_to_null", with_star("SELECT * FROM orders_en"))
def p05(st: Star) -> DataFrame:
    return typed(raw_csv(st, "orders"), st.orders.schema)


@report("p05b_typed_order_items", with_star("SELECT * FROM order_items"))
def p05b(st: Star) -> DataFrame:
    return typed(raw_csv(st, "order_items"), st.order_items.schema)


@report("p05c_typed_payments", with_star("SELECT * FROM payments"))
def p05c(st: Star) -> DataFrame:
    return typed(raw_csv(st, "payments"), st.payments.schema)


@report("p05d_typed_sellers", with_star("SELECT * FROM sellers"))
def p05d(st: Star) -> DataFrame:
    sellers = typed(raw_csv(st, "sellers"), st.sellers.schema)
    return sellers.withColumn("seller_zip_code_prefix", F.lpad("seller_zip_code_prefix", 5, "0"))


@report(
    "p06_geolocation_agg",
    with_star(
        """SELECT zip AS zip_code_prefix, avg(lat) AS geolocation_lat, avg(lng) AS geolocation_lng,
            min(city) AS geolocation_city, min(state) AS geolocation_state, count(*) AS raw_points
        FROM (SELECT customer_zip_code_prefix AS zip, customer_city AS city, customer_state AS state,
                -30.0 + (CAST(customer_zip_code_prefix AS INTEGER) % 1000) / 64.0 + j / 256.0 AS lat,
                -50.0 + (CAST(customer_zip_code_prefix AS INTEGER) % 700) / 128.0 - j / 512.0 AS lng
              FROM (SELECT customer_zip_code_prefix, min(customer_city) AS customer_city,
                        min(customer_state) AS customer_state
                    FROM customers GROUP BY customer_zip_code_prefix) z, range(0, 3) r(j)) g
        GROUP BY zip"""
    ),
)
def p06(st: Star) -> DataFrame:
    return geolocation_by_zip(raw_csv(st, "geolocation"))
