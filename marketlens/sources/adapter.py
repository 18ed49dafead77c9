"""Star schema derived from the driver's TPC-H-like parquet tables.

The marketplace model (customers, products, sellers, orders, order items,
payments, reviews) is derived with integer arithmetic and DECIMAL casts only,
so the SQL oracle can derive exactly the same rows.  The mapping is the one
specified in FIXTURES.md §3; ``k`` below is ``o_orderkey`` / ``l_orderkey``.

Scale notes
-----------
* Everything is lazy: tables are derived when a report asks for them, each
  report prunes them down to the columns it needs, and Catalyst pushes filters
  into the parquet scans.
* ``order_items.order_item_id`` is a row number inside the order, computed per
  (order, salt) plus offsets of the lower salt groups, so a huge order is
  numbered by many tasks; reports that do not read it prune both steps.
* No broadcast is asked for: small sides such as ``nation`` are broadcast by the
  planner's and AQE's size statistics, which grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exact import cents
from ..session import bound_tasks

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed mapping values (must equal the oracle's): order status for open
# orders by k % 5, payment method by order priority, unmapped categories.
DELIVERED = ["F", "P"]
OPEN_STATUS_BY_MOD5 = ["shipped", "canceled", "invoiced", "processing", "unavailable"]
PRIORITY_PAYMENT = {"3-MEDIUM": "boleto", "5-LOW": "debit_card"}
UNTRANSLATED_PARTS = ["red bolt", "cold ring"]


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Its files are listed anew each time, its schema is read
    from them once per application."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n, F.lit(0), F.lit(0))


def _days_hours(d: Column, h: Column) -> Column:
    return F.make_dt_interval(d, h, F.lit(0), F.lit(0))


def day_tenths(start: Column, end: Column) -> Column:
    """(end - start) in days, rounded half away from zero to 0.1, DECIMAL(6,1)."""
    s = F.timestamp_diff("SECOND", start, end)
    t = F.signum(s).cast("bigint") * F.call_function("div", F.abs(s) * 20 + 86400, F.lit(172800))
    return (t * F.lit(0.1).cast("decimal(1,1)")).cast("decimal(6,1)")


#: A table, or what derives it when it is first asked for.
Table = DataFrame | Callable[[], DataFrame]


@dataclass
class Star:
    customers: Table
    products: Table
    sellers: Table
    orders: Table
    order_items: Table
    payments: Table
    reviews: Table

    # the delivered orders, where they can be told before the status is derived
    delivered_orders: Table | None = None
    # the same with the buyer's key, and each buyer's state by that key
    delivered_keys: Table | None = None
    buyer_states: Table | None = None
    # where the tables come from; results kept per source use it as their key
    source: str | None = None
    session: SparkSession | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if callable(value) and name in Star.__dataclass_fields__:
            value = value()
            object.__setattr__(self, name, value)
        return value

    @property
    def spark(self) -> SparkSession:
        return self.session or self.orders.sparkSession

    def delivered(self) -> DataFrame:
        if self.delivered_orders is not None:
            return self.delivered_orders
        return self.orders.filter(F.col("order_status") == "delivered")

    def delivered_buyers(self, *buyer: str) -> DataFrame:
        """Delivered orders with the buyer's ``customer_unique_id`` and/or
        ``customer_state``: by the key that the order holds, if it is known, else
        by the order-scoped customer table."""
        if self.delivered_keys is None:
            return self.delivered().join(self.customers.select("customer_id", *buyer), "customer_id")
        d = self.delivered_keys.withColumn("customer_unique_id", F.col("o_custkey").cast("string"))
        if "customer_state" in buyer:
            d = d.join(self.buyer_states, "o_custkey")
        return d.drop("o_custkey")


def build_orders(raw_orders: DataFrame, buyer_key: bool = False) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus").isin(*DELIVERED), F.lit("delivered"))
    for i, name in enumerate(OPEN_STATUS_BY_MOD5):
        status = status.when(k % 5 == i, F.lit(name))
    pts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), ((k * 7) % 60).cast("int"), F.lit(0))
    base = raw_orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey"),
        status.alias("order_status"),
        pts.alias("order_purchase_timestamp"),
    )
    k = F.col("k")
    pts = F.col("order_purchase_timestamp")
    delivered = F.col("order_status") == "delivered"
    carrier = F.when(
        delivered | (F.col("order_status") == "shipped"),
        pts + _days_hours((1 + k % 5).cast("int"), (k % 7).cast("int")),
    )
    customer_days = 3 + (k * 13) % 29 + F.when(k % 97 == 0, F.lit(30)).otherwise(F.lit(0))
    delivered_at = F.when(
        delivered & (k % 1201 != 0),
        pts + _days_hours(customer_days.cast("int"), (k % 11).cast("int")),
    )
    estimated = F.to_date(pts).cast("timestamp_ntz") + F.make_dt_interval((20 + k % 13).cast("int"))
    out = base.select(
        *(["o_custkey"] if buyer_key else []),
        F.col("k").cast("string").alias("order_id"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("customer_id"),
        "order_status",
        "order_purchase_timestamp",
        (pts + _hours((k % 3).cast("int"))).alias("order_approved_at"),
        carrier.alias("order_delivered_carrier_date"),
        delivered_at.alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
        F.year(pts).alias("purchase_year"),
        F.month(pts).alias("purchase_month"),
        F.dayofmonth(pts).alias("purchase_day"),
        F.weekday(pts).alias("purchase_weekday"),
        F.hour(pts).alias("purchase_hour"),
        F.date_format(pts, "yyyy-MM").alias("year_month"),
    )
    dts = F.col("order_delivered_customer_date")
    est = F.col("order_estimated_delivery_date")
    pts = F.col("order_purchase_timestamp")
    return out.select(
        "*",
        day_tenths(pts, dts).alias("delivery_duration_days"),
        day_tenths(pts, est).alias("estimated_delivery_days"),
        day_tenths(est, dts).alias("delivery_delay_days"),
        (dts > est).alias("is_late"),
        day_tenths(pts, F.col("order_delivered_carrier_date")).alias("carrier_handling_days"),
    )


def build_customers(raw_orders: DataFrame, raw_customer: DataFrame, nation: DataFrame) -> DataFrame:
    # One customer row per order (customer_id is order-scoped, as in the model);
    # the buyer identity is customer_unique_id.
    states = raw_customer.select("c_custkey", "c_nationkey").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    )
    ck = F.col("o_custkey")
    return raw_orders.select("o_orderkey", "o_custkey").join(
        states, F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("customer_id"),
        ck.cast("string").alias("customer_unique_id"),
        F.lpad((ck % 99991).cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.concat(F.lit("city_"), (ck % 40).cast("string")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def build_products(raw_part: DataFrame) -> DataFrame:
    pk = F.col("p_partkey")
    incomplete = pk % 54 == 0

    def opt(c: Column) -> Column:
        return F.when(~incomplete, c)

    return raw_part.select(
        pk.cast("string").alias("product_id"),
        opt(F.col("p_name")).alias("product_category_name"),
        F.when(~incomplete & ~F.col("p_name").isin(*UNTRANSLATED_PARTS), F.regexp_replace("p_name", " ", "_")).alias(
            "product_category_name_english"
        ),
        opt((20 + pk % 40).cast("short")).alias("product_name_lenght"),
        opt((100 + (pk * 7) % 900).cast("int")).alias("product_description_lenght"),
        opt((1 + pk % 6).cast("tinyint")).alias("product_photos_qty"),
        opt((F.col("p_size") * 25).cast("decimal(8,2)")).alias("product_weight_g"),
        opt((10 + pk % 50).cast("decimal(6,2)")).alias("product_length_cm"),
        opt((2 + pk % 30).cast("decimal(6,2)")).alias("product_height_cm"),
        opt((8 + pk % 40).cast("decimal(6,2)")).alias("product_width_cm"),
        incomplete.alias("is_incomplete"),
    )


def build_sellers(raw_supplier: DataFrame, nation: DataFrame) -> DataFrame:
    sk = F.col("s_suppkey")
    return raw_supplier.join(
        nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"
    ).select(
        sk.cast("string").alias("seller_id"),
        F.lpad(sk.cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.concat(F.lit("city_"), (sk % 40).cast("string")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


ITEM_SALTS = 1024
ITEM_TIEBREAK = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                 "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def item_salt() -> Column:
    """Salt of a line item: integer arithmetic, reproduced by the SQL oracle."""
    return (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % ITEM_SALTS


def build_order_items(raw_lineitem: DataFrame) -> DataFrame:
    price_dec = F.col("l_extendedprice").cast("decimal(12,2)")
    items = raw_lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        (price_dec * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(10,2)").alias("price"),
        (price_dec * F.lit(0.01).cast("decimal(2,2)") * F.col("l_tax").cast("decimal(3,2)"))
        .cast("decimal(10,2)")
        .alias("freight_value"),
        *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                             "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")],
    )
    # Line numbers repeat inside an order, so the item number is a fully
    # tie-broken row number inside the order.  It is computed in two levels so
    # that no single task numbers a whole order, however large: rows are
    # salted by an arithmetic hash of their own columns, numbered inside
    # (order, salt), and each salt group is offset by the sizes of the lower
    # salt groups of its order (at most ITEM_SALTS rows per order).  The
    # numbering order is therefore (salt, line number, tie-breaks).  Reports
    # that do not read order_item_id lose both the window and the join
    # (column pruning; left join to a table unique on its keys).
    items = items.withColumn("_salt", item_salt())
    w = Window.partitionBy("order_id", "_salt").orderBy(*ITEM_TIEBREAK)
    numbered = items.withColumn("_rn", F.row_number().over(w))
    sizes = items.groupBy("order_id", "_salt").agg(F.count(F.lit(1)).alias("_cnt"))
    lower = Window.partitionBy("order_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("order_id", "_salt", F.coalesce(F.sum("_cnt").over(lower), F.lit(0)).alias("_off"))
    return numbered.join(offsets, ["order_id", "_salt"], "left").select(
        "order_id",
        (F.col("_off") + F.col("_rn")).cast("int").alias("order_item_id"),
        "product_id",
        "seller_id",
        "shipping_limit_date",
        "price",
        "freight_value",
    )


def build_payments(raw_orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    tot = (F.col("o_totalprice").cast("decimal(12,2)") * F.lit(0.002).cast("decimal(3,3)")).cast("decimal(10,2)")
    voucher = (tot * F.lit(0.3).cast("decimal(1,1)")).cast("decimal(10,2)")
    split = k % 20 == 0
    ptype = F.when(k % 5000 == 7, F.lit("not_defined"))
    for prio, name in PRIORITY_PAYMENT.items():
        ptype = ptype.when(F.col("o_orderpriority") == prio, F.lit(name))
    ptype = ptype.otherwise(F.lit("credit_card"))
    base = raw_orders.select(
        k.alias("k"), ptype.alias("ptype"), tot.alias("tot"), voucher.alias("voucher"), split.alias("split")
    )
    # seq 1 for every paid order, seq 2 (voucher) for split orders: an explode
    # over a literal array keeps this a narrow, shuffle-free transformation.
    seq = F.explode(F.when(F.col("split"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = base.select("*", seq.alias("payment_sequential"))
    first = F.col("payment_sequential") == 1
    ptype_final = F.when(first, F.col("ptype")).otherwise(F.lit("voucher"))
    return rows.select(
        F.col("k").cast("string").alias("order_id"),
        F.col("payment_sequential").cast("int").alias("payment_sequential"),
        ptype_final.alias("payment_type"),
        F.when(first & (F.col("ptype") == "credit_card"), 1 + F.col("k") % 10).otherwise(F.lit(1)).cast("int").alias(
            "payment_installments"
        ),
        F.when(first & F.col("split"), (F.col("tot") - F.col("voucher")).cast("decimal(10,2)"))
        .when(first, F.col("tot"))
        .otherwise(F.col("voucher"))
        .alias("payment_value"),
    )


def build_reviews(orders: DataFrame) -> DataFrame:
    k = F.col("order_id").cast("bigint")
    late = F.coalesce(F.col("is_late"), F.lit(False))
    created = F.coalesce(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date"))
    # Some comments span two lines and carry quotes (exercises multi-line CSV ingest).
    text = (
        F.when(k % 3 == 0, F.lit(""))
        .when(k % 7 == 0, F.concat(F.lit("comment "), F.col("order_id"), F.lit('\n"quoted"')))
        .otherwise(F.concat(F.lit("comment "), F.col("order_id")))
    )
    comment = F.nullif(text, F.lit(""))
    return orders.select(
        F.concat(F.lit("r"), F.col("order_id")).alias("review_id"),
        "order_id",
        F.when(late, 1 + k % 3).otherwise(3 + k % 3).cast("int").alias("review_score"),
        F.when(k % 4 == 0, F.concat(F.lit("title "), F.col("order_id"))).alias("review_comment_title"),
        comment.alias("review_comment_message"),
        (F.to_date(created).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))).alias("review_creation_date"),
        (F.to_date(created).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), (k % 48).cast("int"))).alias(
            "review_answer_timestamp"
        ),
    )


def load_star(spark: SparkSession, sf_dir: str) -> Star:
    """The seven marketplace tables of the driver's tables.  Each is derived when
    a report first asks for it, so a report opens and analyses only the files
    that it reads."""
    bound_tasks(spark)
    frames: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = read_raw(spark, sf_dir, name)
        return frames[name]

    def delivered() -> DataFrame:
        return raw("orders").filter(F.col("o_orderstatus").isin(*DELIVERED))

    def buyer_states() -> DataFrame:
        states = raw("customer").join(raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return states.select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("customer_state"))

    star = Star(
        source=sf_dir.rstrip("/"),
        session=spark,
        delivered_orders=lambda: build_orders(delivered()),
        delivered_keys=lambda: build_orders(delivered(), buyer_key=True),
        buyer_states=buyer_states,
        customers=lambda: build_customers(raw("orders"), raw("customer"), raw("nation")),
        products=lambda: build_products(raw("part")),
        sellers=lambda: build_sellers(raw("supplier"), raw("nation")),
        orders=lambda: build_orders(raw("orders")),
        order_items=lambda: build_order_items(raw("lineitem")),
        payments=lambda: build_payments(raw("orders")),
        reviews=lambda: build_reviews(star.orders),
    )
    return star


def category(products_alias: str | None = None) -> Column:
    """coalesce(english, portuguese, 'unknown') — the report category key."""
    p = f"{products_alias}." if products_alias else ""
    return F.coalesce(
        F.col(f"{p}product_category_name_english"), F.col(f"{p}product_category_name"), F.lit("unknown")
    )


__all__ = ["Star", "load_star", "category", "read_raw", "RAW_TABLES", "cents"]
