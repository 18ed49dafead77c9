"""Customer segmentation: K-Means on log-transformed, standardised RFM (p11, s08).

The clusters are those of ``kmeans``: whole numbers, quantile starts and exact
rounds, so they are the same on any cluster and SQL finds them, too.  Cluster
ids are arbitrary, so segment names are assigned from the cluster profiles (K
rows) by combined RFM rank: each cluster's places by mean recency (lowest
first), frequency and monetary (highest first) are added up, and the names go
from the best sum to the worst (ties: the higher monetary, then the lower
cluster id).

p11 clusters the buyers anew; what it returns is kept for the source, and s08
serves from that.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import pct, ratio_round, sql_pct, sql_ratio_round
from ..oracle.adapter_sql import with_star
from ..plans.pipeline import CUSTOMER_FEATURES_SQL, customer_features
from ..plans.registry import report
from ..session import scratch_path
from ..sources.adapter import Star
from ..sources.kept import keep
from . import kmeans
from .scalars import with_group_totals

K = 4
K_CANDIDATES = [2, 3, 4, 5, 6]

# Fixed segment names (must equal the report's labels).
CHAMPIONS = "High-Value Champions"
LOYAL = "Loyal Regulars"
RECENT = "Recent Light Buyers"
INACTIVE = "Inactive Low-Spend"
BEST_FIRST = [CHAMPIONS, LOYAL, RECENT, INACTIVE]
METHOD = "K-Means clustering on log-transformed, scaled RFM features (K=4)"


#: Recency is better when low.
TURNED = (True, False, False)


def rfm_vectors(st: Star) -> DataFrame:
    """The buyers with z0, z1, z2: log1p of recency, frequency and monetary,
    standardised.  Logarithms count in millionths."""
    spark = st.spark
    log = lambda c: F.rint(F.log(c.cast("double") + 1.0) * 1e6).cast("long")
    money = F.col("monetary_cents") / 100.0
    buyers = customer_features(st).select("*", log(F.col("recency_days")).alias("lr"), log(F.col("frequency")).alias("lf"), log(money).alias("lm"))
    path = scratch_path(spark, "rfm")
    buyers.write.parquet(path)
    z = kmeans.standardised(spark.read.parquet(path), {c: F.col(c) for c in ("lr", "lf", "lm")})
    path = scratch_path(spark, "rfm-z")
    z.drop("lr", "lf", "lm").write.parquet(path)
    return spark.read.parquet(path)


def name_clusters(profile_rows: list) -> dict[int, str]:
    """profile_rows: (cluster, mean recency, mean frequency, mean monetary)."""
    place = {r[0]: 0 for r in profile_rows}
    for key in (lambda r: r[1], lambda r: -r[2], lambda r: -r[3]):
        for r in profile_rows:
            place[r[0]] += sum(key(other) < key(r) for other in profile_rows)
    best_first = sorted(profile_rows, key=lambda r: (place[r[0]], -r[3], r[0]))
    return {r[0]: BEST_FIRST[i] if i < len(BEST_FIRST) else f"{INACTIVE} {i + 1}" for i, r in enumerate(best_first)}


def segment_customers(st: Star, k: int = K) -> DataFrame:
    data = rfm_vectors(st)
    assigned = data.withColumn("cluster", kmeans.nearest(kmeans.fit(data, k, TURNED)))
    mean = lambda c: F.sum(c).cast("double") / F.count(F.lit(1))
    prof = assigned.groupBy("cluster").agg(mean("recency_days"), mean("frequency"), mean("monetary_cents")).orderBy("cluster").collect()  # a row per cluster
    names = name_clusters([(int(r[0]), float(r[1]), float(r[2]), float(r[3])) for r in prof])
    name = F.create_map(*[x for c, n in names.items() for x in (F.lit(c), F.lit(n))])[F.col("cluster")] if names else F.lit(None).cast("string")
    return assigned.select("customer_unique_id", "recency_days", "frequency", "monetary", "monetary_cents", "is_repeat_customer", "cluster", name.alias("segment"))


def kept_segments(st: Star, fresh: bool = False) -> DataFrame:
    """``segment_customers`` as kept for the star's source."""
    return keep(st, "customer-segments", (K, kmeans.UNIT, kmeans.ROUNDS), lambda: segment_customers(st), fresh)


_WORSE = " + ".join(f"(SELECT count(*) FROM profile o WHERE o.{c} {op} p.{c})" for c, op in (("r", "<"), ("f", ">"), ("m", ">")))
SEGMENTS_SQL = f"""{CUSTOMER_FEATURES_SQL},
rfm_logs AS MATERIALIZED (
    SELECT *, CAST(round_even(ln(CAST(recency_days AS DOUBLE) + 1) * CAST(1000000 AS DOUBLE), 0) AS BIGINT) AS lr,
        CAST(round_even(ln(CAST(frequency AS DOUBLE) + 1) * CAST(1000000 AS DOUBLE), 0) AS BIGINT) AS lf,
        CAST(round_even(ln(CAST(monetary_cents AS DOUBLE) / CAST(100 AS DOUBLE) + 1) * CAST(1000000 AS DOUBLE), 0) AS BIGINT) AS lm
    FROM customer_features
),
{kmeans.sql_kmeans("rfm_logs", ["lr", "lf", "lm"], K, TURNED)},
profile AS MATERIALIZED (
    SELECT cluster, CAST(sum(recency_days) AS DOUBLE) / count(*) AS r, CAST(sum(frequency) AS DOUBLE) / count(*) AS f,
        CAST(sum(monetary_cents) AS DOUBLE) / count(*) AS m
    FROM clustered GROUP BY cluster
),
placed AS (SELECT cluster, row_number() OVER (ORDER BY {_WORSE}, m DESC, cluster) AS place FROM profile p),
segments AS MATERIALIZED (
    SELECT c.*, CASE place {' '.join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(BEST_FIRST))} END AS segment
    FROM clustered c JOIN placed USING (cluster)
)"""


@report(
    "p11_kmeans_segments",
    with_star("SELECT customer_unique_id, recency_days, frequency, monetary, is_repeat_customer, cluster, segment FROM segments", SEGMENTS_SQL),
    note="K-Means (K=4) on log1p + standardised RFM, clustered anew and kept for the source",
)
def p11(st: Star) -> DataFrame:
    return kept_segments(st, fresh=True).drop("monetary_cents")


@report("p11b_k_selection", None, note="rows-only: silhouette of K-Means for K = 2..6 on the same features")
def p11b(st: Star) -> DataFrame:
    data = rfm_vectors(st)
    fitted = kmeans.fit_all(data, K_CANDIDATES, TURNED)
    z = data.select(*[(F.col(f"z{i}") / float(kmeans.UNIT)).alias(f"z{i}") for i in range(3)])
    clusters = [kmeans.nearest([tuple(v / kmeans.UNIT for v in c) for c in fitted[k]]).alias(f"cluster{k}") for k in K_CANDIDATES]
    # the evaluator reads its rows several times for each k
    vectors = VectorAssembler(inputCols=["z0", "z1", "z2"], outputCol="features").transform(z.select("*", *clusters)).drop("z0", "z1", "z2").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for k in K_CANDIDATES:
        ev = ClusteringEvaluator(featuresCol="features", predictionCol=f"cluster{k}", metricName="silhouette")
        rows.append((k, float(ev.evaluate(vectors))))
    vectors.unpersist()
    return st.spark.createDataFrame(rows, "k int, silhouette double").orderBy("k")


def segmentation_summary(st: Star) -> DataFrame:
    g = kept_segments(st).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("recency_days").alias("_r"),
        F.sum("frequency").alias("_f"),
        F.sum("monetary_cents").alias("_m"),
    )
    return (
        with_group_totals(g, _n=F.sum("customer_count"))  # K rows
        .select(
            "segment",
            "customer_count",
            ratio_round("_r", "customer_count", 2).alias("avg_recency_days"),
            ratio_round("_f", "customer_count", 2).alias("avg_frequency"),
            ratio_round("_m", F.col("customer_count") * 100, 2).alias("avg_monetary"),
            pct("customer_count", "_n").alias("pct_of_total"),
            F.col("_n").alias("total_customers"),
            F.lit(METHOD).alias("method"),
        )
        .orderBy(F.desc("avg_monetary"), "segment")
    )


@report(
    "s08_segmentation",
    with_star(
        f"""SELECT segment, count(*) AS customer_count,
            {sql_ratio_round('sum(recency_days)', 'count(*)', 2)} AS avg_recency_days,
            {sql_ratio_round('sum(frequency)', 'count(*)', 2)} AS avg_frequency,
            {sql_ratio_round('sum(monetary_cents)', 'count(*) * 100', 2)} AS avg_monetary,
            {sql_pct('count(*)', '(SELECT count(*) FROM segments)')} AS pct_of_total,
            (SELECT count(*) FROM segments) AS total_customers, '{METHOD}' AS method
        FROM segments GROUP BY segment""",
        SEGMENTS_SQL,
    ),
    note="per-segment counts and mean R/F/M over the kept K-Means output",
)
def s08(st: Star) -> DataFrame:
    return segmentation_summary(st)
