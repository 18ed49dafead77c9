"""Sharding by sampled splitters (operator 11), in DataFrame functions only.

Law `bytes`: shards of near equal size, each a range of the records' order.
The order is (group of equal texts, doc_id), a group's place being a hash of
its text, so copies lie beside each other.

* A sample, drawn with probability in proportion to size, is cut at its
  weighted quantiles; those splitters deal the records over ranges by binary
  search.  Ranges that hold too many records after all (rows of little size,
  sampling errors, more ranges than one set of splitters gives) are sampled and
  split again, each by splitters of its own.
* Ranges sort independently; their exact totals, summed in order, turn places
  inside a range into places in the whole.  A record goes to the shard in which
  the middle of its bytes lies, so the sample decides the work's division only,
  never the result.
* A group of equal texts goes by the middle of the group and stays whole, unless
  it exceeds a hundredth of a shard in bytes or rows.  Such groups are split by
  record like everything else: splitters may lie inside them, so a group of a
  third of all rows is spread over many ranges, exact repeats of a row too (by a
  number that tells them apart for the splitting only).

Cases: a null text has size 8 and is a group of its own, apart from the empty
text; a null doc_id comes first in its group; repeated rows get a slot each,
which of them is which can't be seen; fewer records than shards: some shards
stay empty; empty table: no rows; a text of more than a shard's bytes is one
record all the same, and its neighbours' shards hold less; extra columns are
not read, and ``shards`` can carry whole rows along under one name of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import materialise, prepared, read_table, whole_row

SHARDS = 24
#: Bytes of a record beside its text.
HEAD = 8
#: A group stays whole up to this part of a shard's bytes and of its rows.
PART = 100
#: Rows that a range is meant for; most ranges of one set of splitters; most
#: ranges in all, beyond which they get larger.
ROWS, PIECES, RANGES = 2048, 1024, 1 << 20
#: Sampled records for each splitter.
OVER = 32
KEY = ("grp", "doc_id", "uid")


def _records(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """doc_id, size, crc, grp (60 bits of the text), uid and, if asked for, the
    whole row."""
    text = docs[text_col]
    grp = F.when(text.isNull(), F.lit(-1)).otherwise(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10)).cast("long")
    cols = [
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + HEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        grp.alias("grp"),
        F.monotonically_increasing_id().alias("uid"),
    ]
    return docs.select(*cols, *([whole_row(docs).alias("row")] if keep else []))


def _below(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.element_at(bounds, mid + 1) <= key
        step = F.when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        return F.when(s["lo"] < s["hi"], step).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), start, halve, lambda s: s["lo"])


def _splitters(records: DataFrame, within: str, weight: Column, pieces: Column) -> DataFrame:
    """(within, bounds): quantile boundaries of a weighted sample of each value
    of ``within``.  ``weight`` sums to about one over the value's records.  A
    record is drawn with probability weight * pieces * OVER; drawn ones stand
    for the inverse of that."""
    draw = (F.xxhash64("grp", "doc_id", "uid", F.lit(within)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    chance = F.least(weight * pieces * OVER, F.lit(1.0))
    sample = records.select(within, "key", pieces.alias("pieces"), chance.alias("chance"), weight.alias("weight"), draw.alias("draw"))
    sample = sample.where("draw < chance").withColumn("stands", F.col("weight") / F.col("chance"))
    upto = Window.partitionBy(within).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sample.withColumns({"at": F.sum("stands").over(upto), "all": F.sum("stands").over(Window.partitionBy(within))})
    cut = cut.withColumn("piece", F.floor(F.col("at") * F.col("pieces") / F.col("all")).cast("int"))
    cut = cut.where("piece between 1 and pieces - 1").groupBy(within, "piece").agg(F.min("key").alias("key"))
    return cut.groupBy(within).agg(F.array_sort(F.collect_set("key")).alias("bounds"))


def _ranged(records: DataFrame, rows: int, total: int) -> DataFrame:
    """Adds cell and sub: the range of each record, in the order of ``key``."""
    size = max(ROWS, -(-rows // RANGES))
    pieces = min(PIECES, -(-rows // size))
    first = materialise(_splitters(records.withColumn("cell", F.lit(0)), "cell", F.col("size") / float(total), F.lit(pieces)), "sharding-splitters")
    bounds = [tuple(b) for r in first.collect() for b in r["bounds"]]  # PIECES - 1 splitters at most
    fixed = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, b)]) for b in bounds])
    found = records.withColumn("cell", _below(fixed, F.col("key"), PIECES) if bounds else F.lit(0))
    counts = materialise(found.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "sharding-cells")
    overfull = counts.where(F.col("n") > 2 * size).withColumn("parts", F.ceil(F.col("n") / size).cast("int"))  # PIECES rows at most
    if overfull.isEmpty():
        return found.withColumn("sub", F.lit(0))
    # what is too much there is rows, so they count as well as bytes
    inside = found.join(F.broadcast(overfull), "cell")
    weight = (F.col("size") / F.col("bytes") + 1 / F.col("n")) / 2
    second = materialise(_splitters(inside, "cell", weight, F.col("parts")), "sharding-subdivided")
    most = overfull.agg(F.max("parts")).first()[0]
    # RANGES splitters at most
    found = found.join(F.broadcast(second), "cell", "left")
    return found.withColumn("sub", F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(_below(F.col("bounds"), F.col("key"), most))).drop("bounds")


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot
    (gapless within the shard) and, with ``keep``, the whole row as ``row``."""
    prepared(docs)
    records = materialise(_records(docs, id_col, text_col, keep), "sharding-records")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # fewer than 2 * PART * n_shards groups
    sizes = records.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = materialise(sizes.where(f"n > 1 and (bytes * {PART * n_shards} > {total} or n * {PART * n_shards} > {rows})").select("grp", F.lit(True).alias("heavy")), "sharding-heavy")
    records = records.join(F.broadcast(heavy), "grp", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    inner = lambda c: F.when(F.col("heavy"), F.col(c)).alias(c)
    records = records.withColumn("key", F.struct("grp", inner("doc_id"), inner("uid")))

    ranged = _ranged(records, rows, max(total, 1)).drop("key")
    order = Window.partitionBy("cell", "sub").orderBy("grp", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("cell", "sub", "grp")
    placed = ranged.withColumns({"upto": F.sum("size").over(order), "nth": F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = placed.withColumns({"g_from": F.min(F.col("upto") - F.col("size")).over(group), "g_bytes": F.sum("size").over(group)})
    placed = materialise(placed.withColumn("mid2", F.expr("if(heavy, 2 * upto - size, 2 * g_from + g_bytes)")).drop("heavy", "grp", "uid", "g_from", "g_bytes", "upto"), "sharding-placed")

    # totals of the ranges, summed in order: within a cell, then over the cells (PIECES rows at most)
    ends = placed.groupBy("cell", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = ends.groupBy("cell").agg(F.sum("bytes").alias("c_bytes"), F.sum("n").alias("c_n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cells = cells.select("cell", zero("c_bytes", before).alias("c_bytes"), zero("c_n", before).alias("c_n"))
    ends = ends.select("cell", "sub", zero("bytes", earlier).alias("bytes"), zero("n", earlier).alias("n")).join(cells, "cell")
    ends = materialise(ends.selectExpr("cell", "sub", "bytes + c_bytes as bytes", "n + c_n as n"), "sharding-totals")

    whole = placed.join(F.broadcast(ends), ["cell", "sub"])  # RANGES rows at most
    shard = F.expr(f"cast(least({n_shards - 1}, ((mid2 + 2 * bytes) * {n_shards}L) div {2 * max(total, 1)}L) as int)")
    whole = whole.select("doc_id", "size", F.col("crc").alias("text_crc32"), shard.alias("shard"), (F.col("n") + F.col("nth") - 1).alias("at"), *(["row"] if keep else []))
    starts = materialise(whole.groupBy("shard").agg(F.min("at").alias("first")), "sharding-starts")  # a row for each shard
    return whole.join(F.broadcast(starts), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first")


def write(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """The rows of ``docs`` below ``path``, a folder ``shard=N`` for each shard
    (``_shard=N`` where ``docs`` has that column itself) with files in the order
    of their slots, however large a shard is."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    rows = shards(docs, n_shards, keep=True).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = f"""
WITH RECURSIVE crc_bits(i, k, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS steps FROM crc_bits WHERE k = 8
), texts AS (
  SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
), sums AS (
  SELECT text, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS c
  FROM texts, crc_table
), records AS (
  SELECT d.doc_id, coalesce(octet_length(encode(d.text)), 0) + {HEAD} AS size, CASE WHEN s.text IS NULL THEN 0 ELSE xor(s.c, 4294967295) END AS crc,
         CASE WHEN d.text IS NULL THEN -1 ELSE CAST('0x' || substr(md5(d.text), 1, 15) AS BIGINT) END AS grp
  FROM documents d LEFT JOIN sums s ON d.text = s.text
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY grp, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY grp, doc_id NULLS FIRST) AS nth,
         sum(size) OVER (PARTITION BY grp) AS g_bytes, count(*) OVER (PARTITION BY grp) AS g_rows,
         sum(size) OVER () AS total, count(*) OVER () AS n
  FROM records
), groups AS (
  SELECT *, min(upto - size) OVER (PARTITION BY grp) AS g_from FROM placed
), sharded AS (
  SELECT *, CAST(least({SHARDS - 1}, CASE WHEN g_rows > 1 AND (g_bytes * {PART * SHARDS} > total OR g_rows * {PART * SHARDS} > n) THEN 2 * upto - size ELSE 2 * g_from + g_bytes END * {SHARDS} // (2 * total)) AS INTEGER) AS shard
  FROM groups
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""
